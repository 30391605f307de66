"""The occupancy map: a sparse frame (session, voxel, log_odds); a voxel that isn't there is unknown.

A ping meets the voxels of its cone only through the cone's own bounding box, so nothing is joined with
all voxels. Within a ping a voxel takes its first writer's evidence; across pings the clamped sum is a
fold in ping order. Evidence is reduced to a row for each (session, ping, voxel), and blocks of a voxel's pings are composed
on their own (``clamped``), so a voxel that every ping hits is no hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Grid
from ..functions import geometry as G
from ..functions.numbers import cell_hash, finite, hex_signature
from . import clamped

SESSION = "session_id"


def usable(detections: Column, saturated: Column) -> Column:
    """Detections that may write: none of a saturated ping, else those with a finite positive range and SNR."""
    good = lambda d: finite(d["range_m"]) & (d["range_m"] > 0) & finite(d["snr_db"]) & (d["snr_db"] > 0)
    return F.when(saturated, F.filter(detections, lambda d: F.lit(False))).otherwise(F.filter(detections, good))


def shells(pings: DataFrame, min_range_m: float, max_range_m: float, grid: Grid = Grid()) -> DataFrame:
    """What each ping writes, in order: (session, ping, origin, beam, order, lo, hi, delta); free space comes last."""
    d = usable(F.col("detections"), F.col("saturated"))

    def shell(x, i):
        thick = F.greatest(F.lit(grid.voxel_m * math.sqrt(2) * 1.23), x["width_m"], 2 * F.col("range_step_m"))
        weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x["snr_db"] / grid.snr_reference_db))
        return F.struct(i.alias("order"), F.greatest(F.lit(0.0), x["range_m"] - thick / 2).alias("lo"), (x["range_m"] + thick / 2).alias("hi"), (grid.hit * weight).alias("delta"))

    nearest = F.coalesce(F.array_min(F.transform(d, lambda x: x["range_m"])) - grid.free_margin_m, F.lit(max_range_m))
    free = F.struct(F.size(d).alias("order"), F.lit(min_range_m).alias("lo"), F.greatest(F.lit(min_range_m), nearest).alias("hi"), F.lit(-grid.miss).alias("delta"))
    parts = F.concat(F.transform(d, shell), F.array(free))
    rows = pings.select(SESSION, "ping", "origin", G.normalize(F.col("beam")).alias("beam"), F.explode(parts).alias("p"))
    return rows.select(SESSION, "ping", "origin", "beam", "p.*").where((F.col("hi") > F.col("lo")) & (F.col("delta") != 0))


def cone_voxels(rows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Voxels in each row's truncated cone: adds ``voxel``, by the cone's exact bounding box and a test without roots."""
    half = math.radians(grid.beam_half_angle_deg)
    cos2 = math.cos(min(math.pi, max(0.0, half))) ** 2
    span = {}
    for a in "xyz":
        up = F.col("origin")[a] + G.cone_reach(F.col("beam")[a], half, F.col("lo"), F.col("hi"))
        down = F.col("origin")[a] - G.cone_reach(-F.col("beam")[a], half, F.col("lo"), F.col("hi"))
        first = F.greatest(F.lit(0), F.floor((down + grid.extent_m) / grid.voxel_m)).cast("int")
        last = F.least(F.lit(grid.dim - 1), F.floor((up + grid.extent_m) / grid.voxel_m)).cast("int")
        span[a] = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    out = rows
    for a in "zyx":
        out = out.withColumn(f"i{a}", F.explode(span[a]))
    d = {a: (F.col(f"i{a}") + 0.5) * grid.voxel_m - grid.extent_m - F.col("origin")[a] for a in "xyz"}
    r2 = sum((d[a] * d[a] for a in "xyz"), F.lit(0.0))
    along = sum((d[a] * F.col("beam")[a] for a in "xyz"), F.lit(0.0))
    hit = (r2 >= F.col("lo") * F.col("lo")) & (r2 <= F.col("hi") * F.col("hi")) & (along > 0) & (along * along >= cos2 * r2)
    return out.where(hit).withColumn("voxel", (F.col("iz") * grid.dim + F.col("iy")) * grid.dim + F.col("ix")).drop("ix", "iy", "iz")


def evidence(pings: DataFrame, min_range_m: float, max_range_m: float, grid: Grid = Grid()) -> DataFrame:
    """One row for each (session, ping, voxel): the delta of its first writer."""
    rows = cone_voxels(shells(pings, min_range_m, max_range_m, grid), grid)
    return rows.groupBy(SESSION, "ping", "voxel").agg(F.min_by("delta", "order").alias("delta"))


def fold(deltas: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """The map: voxels whose log-odds aren't 0 (evidence that cancels makes a voxel unknown again)."""
    return clamped.fold(deltas, [SESSION, "voxel"], F.col("ping"), F.col("delta"), grid.low, grid.high, "log_odds").where("log_odds <> 0")


def integrate(pings: DataFrame, min_range_m: float = 0.6, max_range_m: float = 6.0, grid: Grid = Grid()) -> DataFrame:
    return fold(evidence(pings, min_range_m, max_range_m, grid), grid)


def probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def entropy(log_odds: Column) -> Column:
    p = probability(log_odds)
    return F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)


def summary(grid_rows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Per session: occupied, known, mean_entropy and the order-independent signature of the map."""
    lo = F.col("log_odds")
    total = F.pmod(F.sum(cell_hash(F.col("voxel"), lo)), F.lit(1 << 32))
    return grid_rows.groupBy(SESSION).agg(F.count_if(lo >= grid.occupied).alias("occupied"), F.count_if(lo != 0).alias("known"), F.avg(F.when(lo != 0, entropy(lo))).alias("mean_entropy"), hex_signature(total).alias("signature"))


def occupied_points(grid_rows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    return grid_rows.where(F.col("log_odds") >= grid.occupied).select(SESSION, "voxel", G.centre_of(F.col("voxel"), grid.extent_m, grid.voxel_m, grid.dim).alias("p"))


def lookup(points: DataFrame, grid_rows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """log_odds, probability and occupied of each (session, p); outside or unknown is 0."""
    at = points.withColumn("voxel", G.voxel_of(F.col("p"), grid.extent_m, grid.voxel_m, grid.dim))
    j = at.join(grid_rows, [SESSION, "voxel"], "left")
    lo = F.coalesce("log_odds", F.lit(0.0))
    return j.select(*points.columns, lo.alias("log_odds"), probability(lo).alias("probability"), (lo >= grid.occupied).alias("is_occupied"))


def iou(pairs: DataFrame, predicted: str, actual: str, by: list[str]) -> DataFrame:
    both, either = F.count_if(F.col(predicted) & F.col(actual)), F.count_if(F.col(predicted) | F.col(actual))
    return pairs.groupBy(*by).agg(F.coalesce(F.try_divide(both, either), F.lit(1.0)).alias("iou"))


def angular_coverage(directions: DataFrame, d: Column, by: list[str], az_bins: int = 36, el_bins: int = 18) -> DataFrame:
    return directions.groupBy(*by).agg((F.count_distinct(G.spherical_bin(d, az_bins, el_bins)) / (az_bins * el_bins)).alias("coverage"))


def failure(pings: DataFrame, silent_after: int = 5) -> DataFrame:
    """Add ``failure`` for each ping: saturated, non-finite, no-direct-path, silent after so many pings without detections, or null."""
    w = Window.partitionBy(SESSION).orderBy("ping")
    heard = F.size("detections") > 0
    group = F.sum(heard.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = pings.withColumn("_g", group)
    quiet = F.sum((F.size("detections") == 0).cast("int")).over(Window.partitionBy(SESSION, "_g").orderBy("ping").rowsBetween(Window.unboundedPreceding, 0))
    why = F.when(F.col("saturated"), "saturated").when(F.col("sanitized") > 0, "non-finite").when(F.col("blast_amplitude") <= 0, "no-direct-path").when(F.col("_quiet") >= silent_after, "silent")
    return rows.withColumn("_quiet", quiet).withColumn("failure", why).drop("_g", "_quiet")
