"""Periodic motion in a dwell: rows (dwell_id, ping, bin, re, im), tested per range bin.

The test looks for one strong Fourier ordinate in a band (Fisher's g); its p-value is exact. Steps are
windows and aggregations by dwell; the band's transform runs on Arrow batches of whole series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def fisher_p(g: float, k: int, terms: int = 11) -> float:
    """P(the largest of k ordinates' share is at least g)."""
    if not g > 0 or k < 2:
        return 1.0
    if g >= 1:
        return 0.0
    total = 0.0
    for j in range(1, min(k, int(1 / g), terms) + 1):
        log = math.lgamma(k + 1) - math.lgamma(j + 1) - math.lgamma(k - j + 1) + (k - 1) * math.log(max(1e-300, 1 - j * g))
        total += (-1) ** (j - 1) * math.exp(log)
    return min(1.0, max(0.0, total))


def fisher_threshold(alpha: float, k: int) -> float:
    """The share whose p-value is alpha, by bisection."""
    lo, hi = 1 / k, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fisher_p(mid, k) > alpha else (lo, mid)
    return (lo + hi) / 2


def fisher_p_column(g: Column, k: Column | int, terms: int = 11) -> Column:
    k = F.lit(k)
    total, c = F.lit(0.0), F.lit(1.0)
    for j in range(1, terms + 1):
        c = c * (k - (j - 1)) / j
        total = total + F.when((F.lit(j) * g < 1) & (k >= j), (-1) ** (j - 1) * c * F.pow(F.greatest(1 - j * g, F.lit(0.0)), k - 1)).otherwise(0.0)
    return F.when(g >= 1, 0.0).when(~(g > 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def noise_floor(rows: DataFrame) -> DataFrame:
    """Per dwell: the root of the median over bins of the mean power (the mean of the middle two for an even number)."""
    power = rows.groupBy("dwell_id", "bin").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    return power.groupBy("dwell_id").agg(F.sqrt(F.percentile("p", F.lit(0.5))).alias("noise_floor"))


def band_bins(pings: int, prf_hz: float, low_hz: float, high_hz: float) -> list[int]:
    """Fourier bins within the band, without the mean and the Nyquist bin."""
    df = prf_hz / pings
    first, last = math.ceil(low_hz / df - 1e-9), math.floor(high_hz / df + 1e-9)
    return [k for k in range(max(1, first), last + 1) if 2 * k < pings]


def _elements(lists: pa.Array) -> tuple[np.ndarray, ...]:
    """Of lists of structs the row of each element, and the elements' fields."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths), *(x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())


def strongest(phases: tuple, shared: tuple, n: int, take: int, ks: list[int], metres: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n series the power of all bins ``ks``, that of the strongest and which this is (the first of equal ones).

    ``phases`` are (series, ping, phase); what ``shared`` says of a series' ping in the same way comes off, then the mean.
    """
    off = np.zeros((n, take))
    off[shared[0], shared[1] % take] = shared[2]
    series, ping, phase = phases
    place = ping % take
    x = (phase - off[series, place]) * metres
    x = x - (np.bincount(series, x, n) / np.maximum(np.bincount(series, minlength=n), 1))[series]
    whole = np.bincount(series * take + place, x, n * take).reshape(n, take)
    angle = -2 * np.pi * np.outer(np.arange(take), ks) / take
    power = (whole @ np.cos(angle)) ** 2 + (whole @ np.sin(angle)) ** 2
    return power.sum(1), power.max(1), np.asarray(ks)[power.argmax(1)]


def _spectra(bands: dict[int, tuple[int, tuple[int, ...]]], metres: float, schema: StructType) -> Callable:
    """Batches of series (form, then their key, ``phases`` and ``shared``) to their strongest bins; ``bands`` has (take, bins) of each form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form, lists = b.column("form").to_numpy(), [_elements(b.column(c)) for c in ("phases", "shared")]
            found = [np.zeros(b.num_rows), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)]
            for f in np.unique(form).tolist():
                mine = form == f
                place = np.cumsum(mine) - 1
                phases, shared = ((place[row[mine[row]]], ping[mine[row]], value[mine[row]]) for row, ping, value in lists)
                for whole, part in zip(found, strongest(phases, shared, int(mine.sum()), *bands[f], metres)):
                    whole[mine] = part
            keys = [b.column(c) for c in schema.names[:3]]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, found)], names=schema.names)

    return run


#: what one detector policy says of an analysis
SETTINGS = ("take", "low_hz", "high_hz", "min_snr_db", "min_cycles", "common_mode")


def analyze_all(rows: DataFrame, policies: dict[str, dict], prf_hz: float, lambda_m: float, floor: DataFrame | None = None) -> DataFrame:
    """What ``analyze`` says, for every policy (by name, with SETTINGS) in one plan: the policy is a column beside dwell_id.

    No step is repeated for policies that agree on what it depends on. Unwrapped phases and pulse pairs depend on none of the
    settings; power on how many pings are taken; which bins are usable, and with them the common motion, on that and the SNR
    gate (a ``cut``); a spectrum on the band and on the cut whose common motion comes off, if any (a ``form``). Policies meet
    these at the end, where a bin is one row.

    Once phases are known a bin is one row of arrays, dealt out by dwell, so that pings are shuffled once, however many cuts and forms there are.
    """
    cell = ["policy", "dwell_id", "bin"]
    listed = [(n, int(p["take"]), band_bins(int(p["take"]), prf_hz, p["low_hz"], p["high_hz"]), float(10 ** (p["min_snr_db"] / 10)), bool(p["common_mode"])) for n, p in policies.items()]
    short = {n for (n, take, ks, *_), p in zip(listed, policies.values()) if take / prf_hz * p["low_hz"] < p["min_cycles"] or len(ks) < 2}
    long = [x for x in listed if x[0] not in short]
    cuts, forms = {}, {}
    for _, take, ks, gate, common in long:
        cut = cuts.setdefault((take, gate), len(cuts))
        forms.setdefault((take, cut if common else None, tuple(ks)), len(forms))
    named = [(n, cuts[take, gate], forms[take, cuts[take, gate] if common else None, tuple(ks)], len(ks)) for n, take, ks, gate, common in long]
    small = lambda data, schema: F.broadcast(rows.sparkSession.createDataFrame(data, schema))
    # at most one row for each policy
    facts = small(named, "policy string, cut int, form int, n int")
    gates = small([(cut, take, gate) for (take, gate), cut in cuts.items()], "cut int, take int, gate double")
    bands = {form: (take, ks) for (take, _, ks), form in forms.items()}
    links = small(sorted({(cut, form, {f: c for (_, c, _), f in forms.items()}[form]) for _, cut, form, _ in named}, key=str), "cut int, form int, off int")
    null = F.lit(None).cast("double")
    columns = [*cell, "status", "p_value", "micromotion_band", "statistic", "rate_hz", "displacement_m", "noise_m", "snr_db", "common_mode_peak_m"]
    refused = rows.select("dwell_id", "bin").distinct().withColumn("policy", F.explode(F.array(*[F.lit(n) for n in sorted(short)]).cast("array<string>")))
    refused = refused.select(*cell, F.lit("insufficient_dwell").alias("status"), *[null.alias(c) for c in columns[4:]])
    if not long:
        return refused.select(*columns)
    takes = F.array(*[F.lit(t) for t in sorted({take for take, _ in cuts})])
    taken = rows.withColumn("take", F.explode(F.filter(takes, lambda t: F.col("ping") < t)))
    if floor is None:
        floor = noise_floor(taken.withColumn("dwell_id", F.struct("take", "dwell_id"))).select("dwell_id.*", "noise_floor")
        on = ["take", "dwell_id"]
    else:
        on = ["dwell_id"]
    good = F.min(~F.isnan("re") & ~F.isnan("im") & (F.abs("re") < float("inf")) & (F.abs("im") < float("inf")))
    power = taken.groupBy("take", "dwell_id", "bin").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mean_power"), good.alias("finite"))
    f2 = F.col("noise_floor") * F.col("noise_floor")
    signal = F.col("mean_power") - f2
    levels = power.join(floor, on).join(gates, "take").withColumn("floor_ok", ~F.isnan("noise_floor") & (F.col("noise_floor") > 0) & (F.col("noise_floor") < float("inf")))
    levels = levels.withColumn("usable", F.col("finite") & F.col("floor_ok") & (signal > 0) & (signal > F.col("gate") * f2)).withColumn("snr_db", F.when(signal > 0, 10 * F.log10(F.try_divide(signal, f2))).otherwise(float("-inf")))
    asked = levels.where("usable").join(links, "cut").groupBy("dwell_id", "bin").agg(F.collect_set(F.struct("cut", "take")).alias("cuts"), F.collect_set(F.struct("form", "take", "off")).alias("forms"))
    mine = rows.join(asked, ["dwell_id", "bin"])
    w = Window.partitionBy("dwell_id", "bin").orderBy("ping")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    pr, pi = F.lag("re").over(w), F.lag("im").over(w)
    steps = mine.withColumn("cr", F.col("re") * pr + F.col("im") * pi).withColumn("ci", F.col("im") * pr - F.col("re") * pi).withColumn("phase", F.atan2("im", "re"))
    turn = -2 * math.pi * F.floor(F.coalesce(F.col("phase") - F.lag("phase").over(w), F.lit(0.0)) / (2 * math.pi) + 0.5)
    steps = steps.withColumn("turn", turn).withColumn("phase", F.col("phase") + F.sum("turn").over(run)).drop("turn")
    lines = steps.groupBy("dwell_id", "bin").agg(F.collect_list(F.struct("ping", "phase", "cr", "ci")).alias("cells"), F.first("cuts").alias("cuts"), F.first("forms").alias("forms")).repartition("dwell_id")
    # all bins of a dwell move together where the device moves: pulse pairs summed over bins
    heard = lines.select("dwell_id", "cells", F.explode("cuts").alias("of")).select("dwell_id", "of", F.explode("cells").alias("x")).where("x.ping < of.take")
    pairs = heard.groupBy("dwell_id", F.col("of.cut").alias("cut"), F.col("x.ping").alias("ping")).agg(F.sum("x.cr").alias("cr"), F.sum("x.ci").alias("ci"))
    wd = Window.partitionBy("cut", "dwell_id").orderBy("ping").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.when((F.coalesce("cr", F.lit(0.0)) == 0) & (F.coalesce("ci", F.lit(0.0)) == 0), 0.0).otherwise(F.atan2("ci", "cr"))
    common = pairs.select("cut", "dwell_id", "ping", F.sum(moved).over(wd).alias("common"))
    metres = lambda_m / (4 * math.pi)
    motion = common.groupBy("dwell_id", "cut").agg((F.max(F.abs("common")) * metres).alias("common_mode_peak_m"), F.collect_list(F.struct("ping", "common")).alias("line"))
    peak = motion.select("dwell_id", "cut", "common_mode_peak_m")
    off = motion.groupBy("dwell_id").agg(F.map_from_entries(F.collect_list(F.struct("cut", "line"))).alias("lines"))
    series = lines.join(off, "dwell_id").select("dwell_id", "bin", "cells", "lines", F.explode("forms").alias("of"))
    phases = F.transform(F.filter("cells", lambda x: (x["ping"] < F.col("of.take")) & x["phase"].isNotNull()), lambda x: F.struct(x["ping"].alias("ping"), x["phase"].alias("phase")))
    series = series.select(F.col("of.form").alias("form"), "dwell_id", "bin", phases.alias("phases"), F.try_element_at("lines", F.col("of.off")).alias("shared"))
    top = StructType(series.schema.fields[:3]).add("total", "double").add("power", "double").add("k", "integer")
    best = series.mapInArrow(_spectra(bands, metres, top), top)
    j = levels.join(facts, "cut").join(best, ["form", "dwell_id", "bin"], "left").join(peak, ["cut", "dwell_id"], "left")
    j = j.withColumn("g", F.when(F.col("total") > 0, F.col("power") / F.col("total")).otherwise(1 / F.col("n")))
    j = j.withColumn("p", fisher_p_column(F.col("g"), F.col("n")))
    ok = F.col("usable")
    status = F.when(~F.col("floor_ok"), "no_noise_floor").when(ok, "ok").otherwise("no_return")
    when = lambda x, other: F.when(ok, x).otherwise(F.lit(other).cast("double"))
    out = j.select(*cell, status.alias("status"), when(F.col("p"), 1.0).alias("p_value"), when(1 - F.col("p"), 0.0).alias("micromotion_band"), when(F.col("g"), 0.0).alias("statistic"), F.when(ok & (F.col("total") > 0), F.col("k") * (prf_hz / F.col("take"))).alias("rate_hz"), F.when(ok, F.when(F.col("total") > 0, 2 * F.sqrt("power") / F.col("take")).otherwise(0.0)).alias("displacement_m"), F.when(ok, metres / F.sqrt(2 * F.pow(F.lit(10.0), F.col("snr_db") / 10))).alias("noise_m"), "snr_db", F.coalesce("common_mode_peak_m", F.lit(0.0)).alias("common_mode_peak_m"))
    return out.unionByName(refused) if short else out


def analyze(rows: DataFrame, pings: int, prf_hz: float, lambda_m: float, low_hz: float = 0.1, high_hz: float = 0.6, min_snr_db: float = 6.0, min_cycles: float = 3.0, common_mode: bool = True, floor: DataFrame | None = None, start_range_m: float | None = None, range_step_m: float | None = None) -> DataFrame:
    """Per (dwell_id, bin): status, p_value, band feature, statistic g, rate_hz, displacement_m, noise_m, snr_db, common_mode_peak_m.

    Refusals are typed: insufficient_dwell, no_noise_floor (for the dwell), no_return (for a bin).
    """
    one = {"one": dict(zip(SETTINGS, (pings, low_hz, high_hz, min_snr_db, min_cycles, common_mode)))}
    return _ranged(analyze_all(rows, one, prf_hz, lambda_m, floor).drop("policy"), start_range_m, range_step_m)


def _ranged(out: DataFrame, start: float | None, step: float | None) -> DataFrame:
    return out.withColumn("range_m", F.lit(None).cast("double") if start is None or step is None else start + F.col("bin") * step)


def feature(out: DataFrame) -> DataFrame:
    """The one feature a dwell's bin may publish, or null."""
    return out.withColumn("feature", F.when(F.col("status") == "ok", F.struct("micromotion_band")))
