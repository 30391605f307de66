"""Constant false alarm rate detection over long rows (key, position, value), in window functions.

Frames are clipped at a signal's ends and the count shrinks with them, while the threshold's factor keeps
the full count. One shuffle by key serves all steps, as every window partitions by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Sonar
from . import scan


def _frames(key: list[str], order: list[str], train: int, guard: int):
    w = Window.partitionBy(*key).orderBy(*order)
    return w.rowsBetween(-(guard + train), -(guard + 1)), w.rowsBetween(guard + 1, guard + train)


def ca_noise(value: str, key: list[str], order: list[str], train: int, guard: int) -> Column:
    """Mean power of the training cells on both sides; 0 without any."""
    lo, hi = _frames(key, order, train, guard)
    power = F.col(value) * F.col(value)
    sums = [F.coalesce(F.sum(power).over(x), F.lit(0.0)) for x in (lo, hi)]
    counts = [F.count(power).over(x) for x in (lo, hi)]
    return F.when(counts[0] + counts[1] > 0, (sums[0] + sums[1]) / (counts[0] + counts[1])).otherwise(0.0)


def os_noise(value: str, key: list[str], order: list[str], train: int, guard: int, rank: float) -> Column:
    """The power of the training cell of this rank (nearest)."""
    lo, hi = _frames(key, order, train, guard)
    power = F.col(value) * F.col(value)
    cells = F.array_sort(F.concat(F.collect_list(power).over(lo), F.collect_list(power).over(hi)))
    return F.when(F.size(cells) > 0, F.element_at(cells, F.floor((F.size(cells) - 1) * rank + 0.5).cast("int") + 1)).otherwise(0.0)


def threshold(rows: DataFrame, value: str, key: list[str], order: list[str], cfg: Sonar) -> DataFrame:
    """Add ``threshold``, and ``i``, the position within the key."""
    noise = os_noise(value, key, order, cfg.cfar_train, cfg.cfar_guard, cfg.cfar_os_rank) if cfg.cfar_kind == "os" else ca_noise(value, key, order, cfg.cfar_train, cfg.cfar_guard)
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("i", F.row_number().over(w) - 1).withColumn("threshold", F.greatest(F.sqrt(cfg.alpha * noise), F.lit(cfg.cfar_min_threshold)))


def spans(rows: DataFrame, value: str, key: list[str], gap: int) -> DataFrame:
    """Runs above the threshold, joined where at most ``gap`` cells lie between: key, span, first, last (exclusive), peak, peak_i.

    A NaN is above nothing.
    """
    above = rows.where((F.col(value) > F.col("threshold")) & ~F.isnan(F.col(value)))
    w = Window.partitionBy(*key).orderBy("i")
    # consecutive cells are a gap of 0, so runs and merged spans are one island rule
    new = F.coalesce((F.col("i") - F.lag("i").over(w) - 1 > gap).cast("int"), F.lit(1))
    marked = above.withColumn("span", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("i", value, "threshold"), F.struct(F.col(value), -F.col("i")))
    out = marked.groupBy(*key, "span").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("last"), F.count(F.lit(1)).alias("cells"), best.alias("p"))
    return out.select(*key, "span", "first", "last", "cells", F.col("p.i").alias("peak_i"), F.col(f"p.{value}").alias("peak"), F.col("p.threshold").alias("threshold"))


def span_cells(rows: DataFrame, value: str, key: list[str], gap: int) -> DataFrame:
    """The rows that lie in a span of ``spans``, gaps inside it included, each with its ``span``.

    A row is in one if the last cell above the threshold before it and the next one after it are of the same span.
    """
    w = Window.partitionBy(*key).orderBy("i")
    above = (F.col(value) > F.col("threshold")) & ~F.isnan(F.col(value))
    at = F.when(above, F.col("i"))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = above & F.coalesce(F.col("i") - F.col("_before") - 1 > gap, F.lit(True))
    numbered = rows.withColumn("_before", before).withColumn("_new", new).withColumn("_span", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = numbered.where(above | (F.col("i") - F.col("_before") <= gap))
    # a gap's cells are kept for a moment; those without a cell of the same span after them go
    last = F.max(F.when(above, F.col("i"))).over(Window.partitionBy(*key, "_span"))
    return near.withColumn("_last", last).where(F.col("i") <= F.col("_last")).withColumnRenamed("_span", "span").drop("_before", "_new", "_last")


def snr_db(amplitude: Column, threshold: Column) -> Column:
    return F.when(threshold > 0, 20 * F.log10(amplitude / threshold)).otherwise(0.0)


def parabolic(value: str, key: list[str], order: list[str]) -> Column:
    """Offset of the vertex through a cell and its neighbours, 0 at ends, on flats and where it would leave the cell's neighbourhood."""
    w = Window.partitionBy(*key).orderBy(*order)
    a, b, c = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    bend = a - 2 * b + c
    shift = F.when(F.abs(bend) >= 1e-12, 0.5 * (a - c) / bend)
    return F.when(F.abs(shift) <= 1, shift).otherwise(0.0)


def unwrap(phase: str, key: list[str], order: list[str]) -> Column:
    """Phase without jumps: whole turns are taken off as a running sum. Needs a column ``turn`` from ``turns``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return F.col(phase) + F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))


def turns(rows: DataFrame, phase: str, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    import math

    step = F.coalesce(F.col(phase) - F.lag(phase).over(w), F.lit(0.0))
    return rows.withColumn("turn", -2 * math.pi * F.floor(step / (2 * math.pi) + 0.5))


def nearest_rank(values: Column, q: float) -> Column:
    """The element of nearest rank, without interpolation, of an array."""
    return F.element_at(F.array_sort(values), F.floor((F.size(values) - 1) * q + 0.5).cast("int") + 1)


#: groups up to which their ranges are broadcast
MOST_GROUPS = 10_000


def grouped_ranks(rows: DataFrame, key: list[str], value: str, ranks: dict, buckets: int = 1024) -> DataFrame:
    """(key, a column for each name in ``ranks``): values by rank from 0, given as a function of the group's number of rows.

    Values are counted by equal ranges between a group's least and greatest, so that windows run over at most ``buckets`` rows of a
    group. The range that holds a rank is divided the same way between its own least and greatest value, and only the
    values of the part that holds it are told apart and ranked by counts of equal ones.
    """
    named = rows.select(*key, F.col(value).alias("_v")).where("_v is not null")
    whole = scan.checkpointed(named.groupBy(*key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    small = F.broadcast if whole.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS else lambda x: x  # else a shuffle
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))).otherwise(0).cast("int")
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), f(F.col("_total")).cast("long").alias("rank")) for n, f in ranks.items()])

    def narrowed(within: DataFrame, by: list[str], part: str, first: bool) -> DataFrame:
        """Of ranges (by, _lo, _hi; after the first time also _before and the ranks _w) the parts that hold a rank; at most as many as ranks."""
        placed = named.join(small(within), key).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).withColumn(part, cell)
        w = Window.partitionBy(*by)
        upto = w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        held = [] if first else [F.first("_before").alias("_before"), F.first("_w").alias("_w")]
        sums = placed.groupBy(*by, part).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), *held)
        before = F.coalesce(F.sum("_m").over(upto), F.lit(0))
        sums = sums.withColumn("_total", F.sum("_m").over(w)).withColumn("_before", before if first else before + F.col("_before"))
        hit = sums.withColumn("_x", F.explode(wanted if first else F.col("_w"))).where((F.col("_x.rank") >= F.col("_before")) & (F.col("_x.rank") < F.col("_before") + F.col("_m")))
        return hit.groupBy(*by, part, "_before", F.col("_least").alias("_lo"), F.col("_most").alias("_hi")).agg(F.collect_list("_x").alias("_w"))

    chosen = narrowed(narrowed(whole, key, "_b", True), [*key, "_b"], "_c", False)
    part = [*key, "_b", "_c"]
    inside = named.join(small(chosen), key).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*part, "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_w").alias("_w"))
    upto = F.sum("_n").over(Window.partitionBy(*part).orderBy("_v")) + F.col("_before")
    hits = inside.withColumn("_upto", upto).withColumn("_x", F.explode("_w")).where(F.col("_upto") > F.col("_x.rank"))
    return hits.groupBy(*key).agg(*[F.min(F.when(F.col("_x.name") == n, F.col("_v"))).alias(n) for n in ranks])


def gap_clusters(rows: DataFrame, value: str, key: list[str], order: list[str], gap: float) -> DataFrame:
    """Add ``cluster``: values in order belong together while the step to the one before is at most ``gap``."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def streaks(rows: DataFrame, flag: str, key: list[str], order: list[str]) -> DataFrame:
    """Add ``streak``: how many rows in a row have had the flag, this one included."""
    w = Window.partitionBy(*key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_group", F.sum((~F.col(flag)).cast("int")).over(run))
    within = Window.partitionBy(*key, "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.col(flag).cast("int")).over(within)).drop("_group")
