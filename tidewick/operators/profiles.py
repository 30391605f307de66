"""From envelopes to echoes: the time origin, blast cancelling and the analysis window on arrays, detection by windows over (ping, bin) rows."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Sonar
from ..functions.geometry import let
from . import cfar, kernels

DETECTIONS = "array<struct<range_m:double,amplitude:double,snr_db:double,width_m:double>>"


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once for each row, however often later expressions use them."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def first_place(values: Column, value: Column) -> Column:
    """The first index of a value, from 0."""
    return F.array_position(values, value).cast("int") - 1


def arrival(env: Column, cfg: Sonar) -> Column:
    """The lag that time runs from: the strongest one within the search span, then on as long as emissions follow at the repetition interval.

    One reduction over the intervals: each looks around the place where the next emission is due, and the
    first one that is missing, or that leaves no room for a whole window, ends it.
    """
    size = F.size(env)
    search = F.greatest(F.lit(1), F.least(size, F.lit(int(cfg.direct_search_s * cfg.fs))))
    span = F.slice(env, 1, search)
    start = first_place(span, F.array_max(span))
    if not (cfg.sync_to_direct_path and cfg.pri_samples > 0):
        return start
    room, reach, pri = max(0, math.ceil(cfg.lag_for(cfg.max_range_m))), 4 * max(1, math.ceil(cfg.mainlobe)), cfg.pri_samples
    due = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(search / max(1, pri - reach)).cast("int") + 1))

    def step(s, _):
        at = s["at"] + pri
        lo = F.greatest(F.lit(0), at - reach)
        near = F.slice(env, lo + 1, F.greatest(F.lit(0), F.least(search, at + reach) - lo))
        top = F.array_max(near)
        there = s["on"] & (at < search) & (at + room <= size) & (top >= 0.25 * s["level"])
        return F.struct(F.when(there, lo + first_place(near, top)).otherwise(s["at"]).alias("at"), s["level"].alias("level"), F.coalesce(there, F.lit(False)).alias("on"))

    def reduced(t):
        level = F.get(env, t).cast("double")
        return F.aggregate(due, F.struct(t.alias("at"), level.alias("level"), (level > 0).alias("on")), step, lambda s: s["at"])

    return let(start, reduced)


def vertex(values: Column, i: Column) -> Column:
    """Where the parabola through a value and its neighbours peaks; the place itself at ends, on flats and where it would leave the neighbourhood."""

    def fitted(t):
        bend = t["a"] - 2 * t["b"] + t["c"]
        shift = F.when(F.abs(bend) >= 1e-12, 0.5 * (t["a"] - t["c"]) / bend)
        return t["i"] + F.when(F.abs(shift) <= 1, shift).otherwise(0.0)

    side = lambda k: F.when((i + k >= 0) & (i + k < F.size(values)), F.get(values, (i + k).cast("int")))
    return let(F.struct(i.cast("double").alias("i"), side(-1).alias("a"), side(0).alias("b"), side(1).alias("c")), fitted)


def nearest_rank(values: Column, q: float) -> Column:
    """The element of nearest rank, 0 if there is none."""
    return F.when(F.size(values) > 0, cfar.nearest_rank(values, q)).otherwise(0.0)


def timed(pings: DataFrame, cfg: Sonar, record_len: int | None = None) -> DataFrame:
    """Compressed pings with t0, blast_amplitude, start_range_m, range_step_m, noise_floor and ``envelope`` cut to the analysis window, the blast taken off.

    The blast's own response, scaled, is subtracted from where it arrives on; nothing goes below 0.
    """
    length = record_len or cfg.record_len
    c = kernels.compress(pings, cfg, length)
    names = [x for x in c.columns if x != "envelope"]
    rows = once(c, _at=arrival(F.col("envelope"), cfg))
    env, at, level = F.col("envelope"), F.col("_at"), F.get("envelope", F.col("_at"))
    if cfg.blast_cancellation:
        own = F.split(F.lit(",".join(map(repr, kernels.matched_filter(cfg, length).acf.tolist()))), ",").cast("array<double>")
        less = lambda t: F.transform(t["e"], lambda x, i: F.when((i >= t["at"]) & (t["level"] > 0), F.greatest(F.lit(0.0), x - t["level"] * F.coalesce(F.get(own, i - t["at"]), F.lit(0.0)))).otherwise(x))
        env = let(F.struct(env.alias("e"), at.alias("at"), level.alias("level")), less)
    rows = once(rows, blast_amplitude=level, t0=vertex(F.col("envelope"), at) if cfg.sync_to_direct_path else F.lit(0.0), _env=env)
    edge = lambda r, f: F.least(F.lit(length), F.greatest(F.lit(0), f(F.col("t0") + cfg.lag_for(r)).cast("int")))
    rows = once(rows, _lo=edge(cfg.min_range_m, F.floor), _hi=edge(cfg.max_range_m, F.ceil))
    start = (cfg.c * (F.col("_lo") - F.col("t0")) / cfg.fs + cfg.speaker_mic_sep_m) / 2
    rows = once(rows.drop("envelope"), start_range_m=start, envelope=F.slice("_env", F.col("_lo") + 1, F.greatest(F.lit(0), F.col("_hi") - F.col("_lo"))))
    return rows.select(*names, "t0", "blast_amplitude", "start_range_m", F.lit(cfg.range_step).alias("range_step_m"), nearest_rank(F.col("envelope"), 0.5).alias("noise_floor"), "envelope")


def _dips(x: np.ndarray, peaks: list[int]) -> list[int]:
    """The first place of the least value between each two neighbouring peaks."""
    return [a + int(np.argmin(x[a : b + 1])) for a, b in zip(peaks, peaks[1:])]


def _kept(x: np.ndarray, maxima: np.ndarray, depth: float, apart: int) -> list[int]:
    """Maxima that are echoes, in order of place.

    The strongest comes first. Each next one needs looking at the nearest kept one to either side only: what is farther has at least as
    much distance, and the values between hold those of the nearer one. Least values are taken over the stretches between neighbouring maxima,
    in a table of powers of two.
    """
    table = [np.minimum.reduceat(x, maxima)[:-1]] if len(maxima) > 1 else [np.empty(0)]
    while len(table[-1]) > 1 << (len(table) - 1):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))

    def least(a, b):  # between the a-th and the b-th maximum, both included
        k = (b - a).bit_length() - 1
        return min(table[k][a], table[k][b - (1 << k)], x[maxima[b]])

    kept: list[int] = []
    for m in np.lexsort((maxima, -x[maxima])).tolist():
        at = bisect.bisect(kept, m)
        sides = [(kept[at - 1], m)] if at else []
        sides += [(m, kept[at])] if at < len(kept) else []
        if all(maxima[b] - maxima[a] >= apart and least(a, b) <= x[maxima[m]] * depth for a, b in sides):
            kept.insert(at, m)
    return maxima[kept].tolist()


def separate(values: np.ndarray, starts: np.ndarray, prominence_db: float, separation: int) -> list[tuple[int, int, int, int]]:
    """The separate echoes (span, peak, first, last) of spans that lie one after another in ``values``; places count from a span's first cell.

    A local maximum is an echo if each echo that is stronger lies at least ``separation`` away and the least
    value between them is lower than it by ``prominence_db``. Spans are cut at the least value between echoes.
    """
    depth, apart = 10 ** (-max(0.0, prominence_db) / 20), max(1, separation)
    ends = np.append(starts[1:], len(values))
    head, tail = np.zeros(len(values), bool), np.zeros(len(values), bool)
    head[starts], tail[ends - 1] = True, True
    rising = head | (values >= np.r_[0.0, values[:-1]])
    falling = tail | (values > np.r_[values[1:], 0.0])
    maxima = np.flatnonzero(rising & falling)
    cuts = np.searchsorted(maxima, np.append(starts, len(values)))
    out = []
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        x, found = values[s:e], maxima[cuts[k] : cuts[k + 1]] - s
        peaks = _kept(x, found, depth, apart) if len(found) > 1 else found.tolist()
        edges = [0, *_dips(x, peaks), e - s]
        out += [(k, p, edges[j], max(edges[j + 1], edges[j] + 1)) for j, p in enumerate(peaks)]
    return out


def _separated(prominence_db: float, separation: int):
    """For each list of a span's values the list of its echoes."""

    def run(cells: pd.Series) -> pd.Series:
        lengths = np.array([len(c) for c in cells])
        out: list[list] = [[] for _ in lengths]
        if lengths.sum():
            filled = np.flatnonzero(lengths)
            starts = np.cumsum(lengths[filled]) - lengths[filled]
            for k, *echo in separate(np.concatenate([np.asarray(c, float) for c in cells]), starts, prominence_db, separation):
                out[filled[k]].append(dict(zip(("peak", "first", "last"), echo)))
        return pd.Series(out)

    return F.pandas_udf(run, "array<struct<peak:int,first:int,last:int>>")


def echoes(rows: DataFrame, value: str, key: list[str], order: list[str], cfg: Sonar) -> DataFrame:
    """All echoes of each key's signal: key, peak, first, last, index (with the vertex), amplitude, threshold, snr_db.

    Thresholds, vertices and the span that a cell lies in are window functions over the rows. Only a span's own
    cells are brought together to be taken apart; those outside spans, most of a signal, go no further.
    """
    x = F.col(value).cast("double")
    limits = cfar.threshold(rows, value, key, order, cfg).withColumn("_shift", cfar.parabolic(value, key, order))
    inside = cfar.span_cells(limits, value, key, cfg.cfar_merge_gap)
    cells = inside.groupBy(*key, "span").agg(F.array_sort(F.collect_list(F.struct("i", x.alias("v"), F.col("threshold").alias("t"), F.col("_shift").alias("s")))).alias("_cells"))
    parts = _separated(cfg.cfar_min_prominence_db, cfg.cfar_merge_gap)(F.transform("_cells", lambda c: c["v"]))
    e = cells.withColumn("_e", F.explode(parts)).select(*key, F.get("_cells", F.lit(0))["i"].alias("_at"), "_e", F.get("_cells", F.col("_e.peak")).alias("_c"))
    place = lambda c: (F.col("_at") + F.col(f"_e.{c}")).alias(c)
    amplitude, limit = F.col("_c.v"), F.col("_c.t")
    return e.select(*key, place("peak"), place("first"), place("last"), (F.col("_c.i") + F.col("_c.s")).alias("index"), amplitude.alias("amplitude"), limit.alias("threshold"), F.when(amplitude > 0, cfar.snr_db(amplitude, limit)).otherwise(0.0).alias("snr_db"))


def profiles(pings: DataFrame, cfg: Sonar, key: list[str], record_len: int | None = None) -> DataFrame:
    """Pings with ``detections`` by range, and all that ``timed`` adds. ``key`` tells pings apart."""
    rows = timed(pings, cfg, record_len)
    cells = rows.select(*key, F.posexplode("envelope").alias("bin", "v"))
    range_m = (cfg.c * F.col("index") / cfg.fs) / 2
    found = echoes(cells, "v", key, ["bin"], cfg).where(F.col("snr_db") >= cfg.min_snr_db)
    d = F.struct(range_m.alias("range_m"), "amplitude", "snr_db", ((F.col("last") - F.col("first")) * cfg.range_step).alias("width_m"))
    lists = found.groupBy(*key).agg(F.array_sort(F.collect_list(d)).alias("_d"))
    moved = F.transform("_d", lambda x: F.struct((x["range_m"] + F.col("start_range_m")).alias("range_m"), x["amplitude"].alias("amplitude"), x["snr_db"].alias("snr_db"), x["width_m"].alias("width_m")))
    return rows.join(lists, key, "left").withColumn("detections", F.coalesce(moved, F.array().cast(DETECTIONS))).drop("_d")


def db_below_peak(env: Column, floor_db: float = -60.0) -> Column:
    top = F.greatest(F.array_max(env), F.lit(1e-20))
    return F.transform(env, lambda x: F.when(x > 0, F.greatest(20 * F.log10(x / top), F.lit(floor_db))).otherwise(floor_db))
