"""Queries over recordings: each row of ``embeddings`` is read as a short recording, each user's events as a signal.

Compression runs on Arrow batches; everything after it is windows, joins and array expressions. The SQL
states the same from the formulas, with the matched filter as the correlation it amounts to.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Grid, Sonar
from ..functions import geometry as G
from ..functions import numbers as N
from ..functions import waveform as Wf
from ..operators import kernels, memory, micromotion, occupancy, profiles, scoring
from ..sources import wire
from .catalog import CFAR, _THRESHOLD, query, r
from .tables import events, rounded, table

#: a sounding whose record has 256 samples
SOUNDING = Sonar(fs=4800.0, f0=300.0, f1=2100.0, duration_s=0.0025, tx_window="hann", rx_taper="hann", amplitude=1.0, cfar_train=8, cfar_guard=5, cfar_pfa=0.2, cfar_merge_gap=1, cfar_min_prominence_db=3.0, min_range_m=0.1, max_range_m=2.8, direct_search_s=160 / 4800, min_snr_db=1.0, pri_samples=40)
LENGTH = 256


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label and samples: the vector, there and back, twice."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", F.concat(e, F.reverse(e), e, F.reverse(e)).alias("samples"))


# The SQL has its own numbers: a hann sweep of 12 samples from 300 to 2100 Hz at 4800 Hz, a hann taper over that band, spectra of 512
# places, air at 20 degrees, a microphone at 0.1 m, eight training cells to a side and a false alarm rate of 0.2.
_C = "(331.3e0 * sqrt(1 + 20 / 273.15e0))"
_STEP_M = f"({_C} / 9600)"
_ALPHA = "(16 * (pow(0.2e0, -1e0 / 16) - 1))"
#: half a main lobe: sample rate over bandwidth, wider by the taper
_LOBE = "(4800 / 1800e0 * 1.67e0)"


def _lag_sql(range_m: float) -> str:
    return f"((2 * {range_m!r}::DOUBLE - 0.1e0) * 4800 / {_C})"


_RESPONSE = """sweep AS (SELECT n, 0.5e0 - 0.5e0 * cos(2 * pi() * n / 12) AS w, 2 * pi() * (300 * (n / 4800e0) + 1800 / 0.0025e0 * pow(n / 4800e0, 2) / 2) AS angle FROM (SELECT unnest(range(12)) AS n)),
band AS (SELECT k, 0.5e0 - 0.5e0 * cos(2 * pi() * (k * 9.375e0 - 300) / 1800) AS w FROM (SELECT unnest(range(256)) AS k) WHERE k * 9.375e0 BETWEEN 300 AND 2100),
filter AS (SELECT k, sum(s.w * cos(angle - 2 * pi() * k * n / 512)) * any_value(b.w) AS re, -sum(s.w * sin(angle - 2 * pi() * k * n / 512)) * any_value(b.w) AS im FROM band b, sweep s GROUP BY k),
level AS (SELECT sum(re * re + im * im) / 512 AS energy FROM filter),
tap AS (SELECT l, sum(re * cos(2 * pi() * k * l / 512) - im * sin(2 * pi() * k * l / 512)) / 512 / any_value(energy) AS gr, sum(re * sin(2 * pi() * k * l / 512) + im * cos(2 * pi() * k * l / 512)) / 512 / any_value(energy) AS gi FROM filter, level, (SELECT unnest(range(512)) AS l) GROUP BY l),
resp AS (SELECT list(gr ORDER BY j) AS hr, list(gi ORDER BY j) AS hi FROM (SELECT (512 - l) % 512 + 512 * turn AS j, gr, gi FROM tap, (SELECT unnest([0, 1]) AS turn))),
heard AS (SELECT q.l, sqrt(pow(sum(w * sin(angle) * gr), 2) + pow(sum(w * sin(angle) * gi), 2)) AS v FROM (SELECT unnest(range(192)) AS l) q, sweep JOIN tap ON tap.l = (q.l - n + 512) % 512 GROUP BY q.l),
acf AS (SELECT list(v / top ORDER BY l) AS own FROM heard, (SELECT max(v) AS top FROM heard))"""


def _envelope_sql() -> str:
    """CTE env(vec_id, label, env): magnitudes of the circular correlation with the sweep's response, twice unrolled."""
    at = f"[512 - lag + 1:512 - lag + {LENGTH}]"
    return f"""{_RESPONSE},
rec AS (SELECT vec_id, label, list_concat(list_concat(e, list_reverse(e)), list_concat(e, list_reverse(e))) AS x FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)),
env AS (SELECT vec_id, label, [sqrt(pow(list_dot_product(x, hr{at}), 2) + pow(list_dot_product(x, hi{at}), 2)) FOR lag IN range({LENGTH})] AS env FROM rec, resp)"""


def _vertex_sql(x: str, i: str) -> str:
    """The vertex through places i - 1, i, i + 1 (from 0) of a list."""
    a, b, c = f"{x}[{i}]", f"{x}[{i} + 1]", f"{x}[{i} + 2]"
    s = f"0.5 * ({a} - {c}) / ({a} - 2 * {b} + {c})"
    return f"({i} + CASE WHEN {i} > 0 AND {i} < len({x}) - 1 AND abs({a} - 2 * {b} + {c}) >= 1e-12 AND abs({s}) <= 1 THEN {s} ELSE 0 END)"


def _timed_sql() -> str:
    """CTEs up to timed(vec_id, label, t0, blast, lo, part, start_m). Emissions are 40 samples apart and looked for in the first 160."""
    room, reach = f"ceil({_lag_sql(2.8)})", f"(4 * CAST(ceil({_LOBE}) AS BIGINT))"
    return f"""{_envelope_sql()},
start AS (SELECT vec_id, env, list_position(env[1:160], list_max(env[1:160])) - 1 AS pos, list_max(env[1:160]) AS level FROM env),
walk AS (SELECT vec_id, env, pos, level, level > 0 AS onward, 0 AS k FROM start
  UNION ALL SELECT vec_id, env, CASE WHEN there THEN lo + list_position(near, list_max(near)) - 1 ELSE pos END, level, there, k + 1 FROM (
    SELECT *, coalesce(onward AND pos + 40 < 160 AND pos + 40 + {room} <= {LENGTH} AND list_max(near) >= 0.25 * level, false) AS there FROM (
      SELECT *, greatest(0, pos + 40 - {reach}) AS lo, env[greatest(0, pos + 40 - {reach}) + 1:least(160, pos + 40 + {reach})] AS near FROM walk WHERE onward AND k < 1 + floor(160 / (40 - {reach}))))),
origin AS (SELECT vec_id, env, arg_max(pos, k) AS pos FROM walk GROUP BY vec_id, env),
cancelled AS (SELECT vec_id, env[pos + 1] AS blast, {_vertex_sql("env", "pos")} AS t0, [CASE WHEN i >= pos AND env[pos + 1] > 0 THEN greatest(0, env[i + 1] - env[pos + 1] * coalesce(own[i - pos + 1], 0)) ELSE env[i + 1] END FOR i IN range({LENGTH})] AS env FROM origin, acf),
cut AS (SELECT *, CAST(least({LENGTH}, greatest(0, floor(t0 + {_lag_sql(0.1)}))) AS BIGINT) AS lo, CAST(least({LENGTH}, greatest(0, ceil(t0 + {_lag_sql(2.8)}))) AS BIGINT) AS hi FROM cancelled),
timed AS (SELECT vec_id, t0, blast, lo, env[lo + 1:hi] AS part, ({_C} * (lo - t0) / 4800 + 0.1e0) / 2 AS start_m FROM cut)"""


def _echo_sql(key: str, s: Sonar) -> str:
    """CTEs from limits(key, i, value, threshold) to echo(key, peak, first, last, index, amplitude, threshold, snr_db)."""
    depth, apart = 10 ** (-s.cfar_min_prominence_db / 20), max(1, s.cfar_merge_gap)
    dip = lambda a, b: f"({a} + list_position(x[{a} + 1:{b} + 1], list_min(x[{a} + 1:{b} + 1])) - 1)"
    return f"""above AS (SELECT *, CASE WHEN lag(i) OVER w IS NULL OR i - lag(i) OVER w - 1 > {s.cfar_merge_gap} THEN 1 ELSE 0 END AS new FROM limits WHERE value > threshold WINDOW w AS (PARTITION BY {key} ORDER BY i)),
marked AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY i) AS span FROM above),
spans AS (SELECT {key}, span, min(i) AS f, max(i) + 1 AS l FROM marked GROUP BY {key}, span),
signal AS (SELECT {key}, list(value ORDER BY i) AS v, list(threshold ORDER BY i) AS t FROM limits GROUP BY {key}),
cuts AS (SELECT {key}, span, f, v, t, v[f + 1:l] AS x FROM spans JOIN signal USING ({key})),
maxima AS (SELECT *, row_number() OVER (PARTITION BY {key}, span ORDER BY x[p + 1] DESC, p) AS k FROM (SELECT {key}, span, x, unnest(range(len(x))) AS p FROM cuts) WHERE (p = 0 OR x[p + 1] >= x[p]) AND (p = len(x) - 1 OR x[p + 1] > x[p + 2])),
keep AS (SELECT {key}, span, 0 AS k, []::BIGINT[] AS kept FROM cuts
  UNION ALL SELECT q.{key}, q.span, m.k, CASE WHEN len([z FOR z IN q.kept IF NOT (abs(z - m.p) >= {apart} AND list_min(m.x[least(z, m.p) + 1:greatest(z, m.p) + 1]) <= m.x[m.p + 1] * {depth!r})]) = 0 THEN list_append(q.kept, m.p) ELSE q.kept END FROM keep q JOIN maxima m ON m.{key} = q.{key} AND m.span = q.span AND m.k = q.k + 1),
chosen AS (SELECT {key}, span, list_sort(arg_max(kept, k)) AS kept FROM keep GROUP BY {key}, span),
parts AS (SELECT {key}, span, f, v, t, x, kept, unnest(kept) AS p, generate_subscripts(kept, 1) AS j FROM chosen JOIN cuts USING ({key}, span)),
edges AS (SELECT *, CASE WHEN j = 1 THEN 0 ELSE {dip("kept[j - 1]", "p")} END AS a, CASE WHEN j = len(kept) THEN len(x) ELSE {dip("p", "kept[j + 1]")} END AS b FROM parts),
echo AS (SELECT {key}, f + p AS peak, f + a AS first, f + greatest(b, a + 1) AS last, {_vertex_sql("v", "(f + p)")} AS index, v[f + p + 1] AS amplitude, t[f + p + 1] AS threshold, CASE WHEN v[f + p + 1] > 0 AND t[f + p + 1] > 0 THEN 20 * log10(v[f + p + 1] / t[f + p + 1]) ELSE 0 END AS snr_db FROM edges)"""


def _limits_sql(s: Sonar = SOUNDING) -> str:
    """CTE limits(vec_id, i, value, threshold) of timed parts."""
    w = "(PARTITION BY vec_id ORDER BY i"
    lo = f"{w} ROWS BETWEEN {s.cfar_guard + s.cfar_train} PRECEDING AND {s.cfar_guard + 1} PRECEDING)"
    hi = f"{w} ROWS BETWEEN {s.cfar_guard + 1} FOLLOWING AND {s.cfar_guard + s.cfar_train} FOLLOWING)"
    n = f"(count(value) OVER {lo} + count(value) OVER {hi})"
    return f"""cells AS (SELECT vec_id, unnest(part) AS value, generate_subscripts(part, 1) - 1 AS i FROM timed),
limits AS (SELECT vec_id, i, value, greatest(sqrt({_ALPHA} * CASE WHEN {n} > 0 THEN (coalesce(sum(value * value) OVER {lo}, 0) + coalesce(sum(value * value) OVER {hi}, 0)) / {n} ELSE 0 END), {s.cfar_min_threshold!r}) AS threshold FROM cells)"""


#: CTEs up to ping(vec_id, label, start_m, detections)
_PINGS = f"""{_timed_sql()}, {_limits_sql()}, {_echo_sql("vec_id", SOUNDING)},
found AS (SELECT vec_id, list({{'range_m': start_m + {_C} * index / 4800 / 2, 'amplitude': amplitude, 'snr_db': snr_db, 'width_m': (last - first) * {_STEP_M}}} ORDER BY index) AS detections FROM echo JOIN timed USING (vec_id) WHERE snr_db >= {SOUNDING.min_snr_db!r} GROUP BY vec_id),
ping AS (SELECT e.vec_id, e.label, t.start_m, t.part, t.t0, t.blast, coalesce(f.detections, []) AS detections FROM embeddings e JOIN timed t USING (vec_id) LEFT JOIN found f USING (vec_id))"""


def _echoes(spark, d):
    return profiles.echoes(events(spark, d), "value", ["user_id"], ["ts", "event_id"], CFAR)


@query(f"""
WITH RECURSIVE limits AS (SELECT user_id, i, value, threshold FROM ({_THRESHOLD})), {_echo_sql("user_id", CFAR)}
SELECT user_id, CAST(peak AS BIGINT) AS peak, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, {r("index")} AS index, amplitude, {r("snr_db")} AS snr_db FROM echo""")
def separated_echoes(spark: SparkSession, d: str) -> DataFrame:
    whole = [F.col(c).cast("long").alias(c) for c in ("peak", "first", "last")]
    return _echoes(spark, d).select("user_id", *whole, rounded(F.col("index")).alias("index"), "amplitude", rounded(F.col("snr_db")).alias("snr_db"))


@query(f"WITH {_envelope_sql()} SELECT vec_id, [{r('x')} FOR x IN env] AS envelope FROM env")
def compressed_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return kernels.compress(recordings(spark, d), SOUNDING, LENGTH).select("vec_id", F.transform("envelope", lambda x: rounded(x)).alias("envelope"))


def pings(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of all recordings, as pings of the session that their label names, each with a beam of its own."""
    e = lambda i: F.col("samples")[i]
    rows = recordings(spark, d).withColumn("beam", G.normalize(G.vec(e(0), e(1), e(2)))).withColumn("origin", G.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    return profiles.profiles(rows.withColumnRenamed("label", "session_id").withColumnRenamed("vec_id", "ping"), SOUNDING, ["ping"], LENGTH)


@query(f"""
WITH RECURSIVE {_PINGS}
SELECT vec_id AS ping, {r("t0")} AS t0, {r("blast")} AS blast_amplitude, {r("start_m")} AS start_range_m, {r(f"list_sort(part)[CAST(floor((len(part) - 1) * 0.5 + 0.5) AS BIGINT) + 1]")} AS noise_floor, len(detections) AS n_detections, [{r("x.range_m")} FOR x IN detections] AS ranges_m, [{r("x.snr_db")} FOR x IN detections] AS snr_db FROM ping""")
def recorded_pings(spark: SparkSession, d: str) -> DataFrame:
    p = pings(spark, d)
    listed = lambda c: F.transform("detections", lambda x: rounded(x[c]))
    return p.select("ping", *[rounded(F.col(c)).alias(c) for c in ("t0", "blast_amplitude", "start_range_m", "noise_floor")], F.size("detections").cast("long").alias("n_detections"), listed("range_m").alias("ranges_m"), listed("snr_db").alias("snr_db"))


# ---- maps ------------------------------------------------------------------------------------------

GRID = Grid(extent_m=2.8, voxel_m=0.4, beam_half_angle_deg=25.0, snr_reference_db=6.0, occupied=0.8)
_CELLS = GRID.dim**3


def _map_sql(g: Grid = GRID) -> str:
    """CTE cell(session_id, voxel, log_odds): every voxel against every shell, first writers, then the clamped fold in order."""
    near, far = SOUNDING.min_range_m, SOUNDING.max_range_m
    cos2 = math.cos(math.radians(g.beam_half_angle_deg)) ** 2
    centre = lambda e: f"(({e}) % {g.dim} + 0.5) * {g.voxel_m!r} - {g.extent_m!r}"
    return f"""{_PINGS},
ray AS (SELECT vec_id AS ping, label AS session_id, detections, e1 / n AS bx, e2 / n AS by_, e3 / n AS bz FROM (SELECT p.*, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2) AS n FROM ping p JOIN embeddings USING (vec_id))),
usable AS (SELECT *, [x FOR x IN detections IF x.range_m > 0 AND x.snr_db > 0] AS good FROM ray),
shells AS (
  SELECT ping, session_id, bx, by_, bz, j AS ord, greatest(0, x.range_m - thick / 2) AS lo, x.range_m + thick / 2 AS hi, {g.hit!r} * least(1, greatest(0, x.snr_db / {g.snr_reference_db!r})) AS delta FROM (
    SELECT *, greatest({g.voxel_m * math.sqrt(2) * 1.23!r}, x.width_m, 2 * {_STEP_M}) AS thick FROM (SELECT ping, session_id, bx, by_, bz, unnest(good) AS x, generate_subscripts(good, 1) - 1 AS j FROM usable))
  UNION ALL SELECT ping, session_id, bx, by_, bz, len(good), {near!r}, greatest({near!r}, coalesce(list_min([x.range_m FOR x IN good]) - {g.free_margin_m!r}, {far!r})), {-g.miss!r} FROM usable),
grid AS (SELECT v AS voxel, {centre("v")} AS x, {centre(f"floor(v / {g.dim})")} AS y, {centre(f"floor(v / {g.dim * g.dim})")} AS z FROM (SELECT unnest(range({_CELLS})) AS v)),
hit AS (SELECT session_id, ping, voxel, arg_min(delta, ord) AS delta FROM (SELECT s.*, voxel, x * x + y * y + z * z AS r2, x * bx + y * by_ + z * bz AS along FROM shells s, grid WHERE hi > lo AND delta <> 0) WHERE r2 >= lo * lo AND r2 <= hi * hi AND along > 0 AND along * along >= {cos2!r} * r2 GROUP BY session_id, ping, voxel),
cell AS (SELECT * FROM (SELECT session_id, voxel, list_reduce(list_prepend(0.0::DOUBLE, list(delta ORDER BY ping)), lambda a, x: greatest({g.low!r}, least({g.high!r}, a + x))) AS log_odds FROM hit GROUP BY session_id, voxel) WHERE log_odds <> 0)"""


def _map(spark, d):
    return occupancy.integrate(pings(spark, d), SOUNDING.min_range_m, SOUNDING.max_range_m, GRID)


@query(f"WITH RECURSIVE {_map_sql()} SELECT session_id, CAST(voxel AS BIGINT) AS voxel, {r('log_odds')} AS log_odds FROM cell")
def occupancy_maps(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d).select("session_id", F.col("voxel").cast("long").alias("voxel"), rounded(F.col("log_odds")).alias("log_odds"))


@query(f"WITH RECURSIVE {_map_sql()} SELECT session_id, CAST(voxel AS BIGINT) AS voxel, {r('(voxel % ' + str(GRID.dim) + ' + 0.5) * ' + repr(GRID.voxel_m) + ' - ' + repr(GRID.extent_m))} AS x FROM cell WHERE log_odds >= {GRID.occupied!r}")
def occupied_points(spark: SparkSession, d: str) -> DataFrame:
    return occupancy.occupied_points(_map(spark, d), GRID).select("session_id", F.col("voxel").cast("long").alias("voxel"), rounded(F.col("p.x")).alias("x"))


_RADIUS = 1.6


@query(f"""
WITH RECURSIVE {_map_sql()},
truth AS (SELECT session_id, voxel, sqrt(x * x + y * y + z * z) AS d FROM grid, (SELECT DISTINCT label AS session_id FROM embeddings) WHERE sqrt(x * x + y * y + z * z) <= {SOUNDING.max_range_m!r}),
j AS (SELECT t.session_id, coalesce(log_odds, 0) AS l, d >= {_RADIUS!r} AS solid, abs(d - {_RADIUS!r}) <= {GRID.voxel_m!r} AS surface FROM truth t LEFT JOIN cell USING (session_id, voxel)),
n AS (SELECT session_id, count(*) FILTER (l <= -k AND NOT solid) AS fb, count(*) FILTER (l <= -k OR NOT solid) AS fe, count(*) FILTER (l >= k) AS occ, count(*) FILTER (surface AND l >= k) AS sf, count(*) FILTER (surface) AS st, count(*) FILTER (solid) AS so, count(*) FILTER (solid AND l <= -k) AS ff, count(*) FILTER (l <> 0) AS known, count(*) FILTER (l <> 0 AND l < k AND l > -k) AS un FROM j, (SELECT ln(0.7 / 0.3) AS k) GROUP BY session_id),
q AS (SELECT session_id, coalesce(fb / nullif(fe, 0), 0) AS free_iou, coalesce(sf / nullif(st, 0), 1) AS recall, coalesce(sf / nullif(occ, 0), CASE WHEN st = 0 THEN 1 ELSE 0 END) AS precision, coalesce(ff / nullif(so, 0), 0) AS false_free, coalesce(un / nullif(known, 0), 1) AS uncommitted FROM n)
SELECT session_id, {", ".join(f"{r(c)} AS {c}" for c in ("free_iou", "precision", "recall", "false_free", "uncommitted"))}, {r("0.5 * free_iou + 0.5 * coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)")} AS "primary" FROM q""")
def map_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each session's map against a round room: solid from a radius on, a surface a voxel to either side of it."""
    every = table(spark, d, "embeddings").select(F.col("label").alias("session_id")).distinct().withColumn("voxel", F.explode(F.sequence(F.lit(0), F.lit(_CELLS - 1))))
    p = every.withColumn("d", G.norm(G.centre_of(F.col("voxel"), GRID.extent_m, GRID.voxel_m, GRID.dim))).where(F.col("d") <= SOUNDING.max_range_m)
    truth = p.select("session_id", "voxel", (F.col("d") >= _RADIUS).alias("solid"), (F.abs(F.col("d") - _RADIUS) <= GRID.voxel_m).alias("surface"))
    s = scoring.score_map(truth, _map(spark, d), ["session_id"])
    return s.select("session_id", *[rounded(F.col(c)).alias(c) for c in ("free_iou", "precision", "recall", "false_free", "uncommitted", "primary")])


@query(f"""
WITH RECURSIVE {_map_sql()},
p AS (SELECT session_id, log_odds, x, y, z, sqrt(x * x + y * y + z * z) AS d FROM cell JOIN grid USING (voxel)),
o AS (SELECT session_id, d, 1 / (1 + exp(-log_odds)) AS m, CAST(least(greatest(floor((atan2(x, y) + pi()) / (2 * pi()) * 64 + 1e-9), 0), 63) AS INT) AS a, CAST(least(greatest(floor((asin(greatest(-1, least(1, z / d))) + pi() / 2) / pi() * 8 + 1e-9), 0), 7) AS INT) AS e, CAST(least(greatest(floor((d - 0.3) / 5.7 * 24 + 1e-9), 0), 23) AS INT) AS q FROM p WHERE log_odds >= {GRID.occupied!r} AND d BETWEEN 0.3 AND 6.0),
c AS (SELECT session_id, e, a, sum(m) AS mass, sum(m * d) AS mass_r FROM o GROUP BY ALL),
c2 AS (SELECT *, mass / count(*) OVER (PARTITION BY session_id, e) AS even, mass_r / mass AS mean_r FROM c),
f AS (SELECT session_id, e, k, sqrt(pow(sum(even * cos(-2 * pi() * k * a / 64)), 2) + pow(sum(even * sin(-2 * pi() * k * a / 64)), 2)) AS v0, sqrt(pow(sum(mean_r * cos(-2 * pi() * k * a / 64)), 2) + pow(sum(mean_r * sin(-2 * pi() * k * a / 64)), 2)) AS v1 FROM c2, (SELECT unnest(range(6))::INT AS k) GROUP BY session_id, e, k),
every AS (SELECT session_id, 0 AS block, e * 6 + k AS i, v0 AS v FROM f UNION ALL SELECT session_id, 1, 48 + e * 6 + k, v1 FROM f UNION ALL SELECT session_id, 2, 96 + q, sum(m) FROM o GROUP BY session_id, q UNION ALL SELECT session_id, 3, 120 + e, sum(mass_r) / sum(mass) FROM c GROUP BY session_id, e),
u AS (SELECT session_id, i, CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY session_id, block)) > 1e-12 THEN v / sqrt(sum(v * v) OVER (PARTITION BY session_id, block)) ELSE 0 END AS v FROM every)
SELECT session_id, CAST(i AS BIGINT) AS i, {r("v / sqrt(sum(v * v) OVER (PARTITION BY session_id))", 4)} AS v FROM u""")
def room_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Every place of each session's signature that holds anything."""
    s = memory.signatures(_map(spark, d), GRID).select("session_id", F.posexplode("vector").alias("i", "v")).where("v <> 0")
    return s.select("session_id", F.col("i").cast("long").alias("i"), rounded(F.col("v").cast("double"), 4).alias("v"))


@query(f"""
WITH RECURSIVE {_PINGS},
truth AS (SELECT vec_id, detections, [0.4 + (vec_id % 7) * 0.3, 1.0 + (vec_id % 5) * 0.35]::DOUBLE[] AS truth FROM ping),
d AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x.snr_db DESC, j) AS k FROM (SELECT vec_id, unnest(detections) AS x, generate_subscripts(detections, 1) AS j FROM truth)),
claims AS (SELECT vec_id, 0 AS k, truth AS left_, []::DOUBLE[] AS errors FROM truth
  UNION ALL SELECT vec_id, k, CASE WHEN e <= 0.2 THEN list_concat(left_[:n - 1], left_[n + 1:]) ELSE left_ END, CASE WHEN e <= 0.2 THEN list_append(errors, e) ELSE errors END FROM (
    SELECT w.vec_id, d.k, left_, errors, list_min([abs(t - d.x.range_m) FOR t IN left_]) AS e, list_position([abs(t - d.x.range_m) FOR t IN left_], list_min([abs(t - d.x.range_m) FOR t IN left_])) AS n FROM claims w JOIN d ON d.vec_id = w.vec_id AND d.k = w.k + 1)),
last AS (SELECT vec_id, arg_max(errors, k) AS errors FROM claims GROUP BY vec_id),
c AS (SELECT vec_id, errors, len(errors) AS tp, len(detections) - len(errors) AS fp, len(truth) - len(errors) AS fn FROM truth JOIN last USING (vec_id)),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS rc FROM c)
SELECT vec_id AS ping, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {r("coalesce(2 * p * rc / nullif(p + rc, 0), 0)")} AS f1, {r("coalesce(sqrt(list_sum([e * e FOR e IN errors]) / nullif(tp, 0)), 0)")} AS rmse, {r("coalesce(list_max(errors), 0)")} AS max_error FROM q""")
def range_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("ping")
    truth = F.array(0.4 + (k % 7) * 0.3, 1.0 + (k % 5) * 0.35)
    s = scoring.score_ranges(pings(spark, d).select("ping", "detections", truth.alias("truth_ranges_m")), 0.2)
    return s.select("ping", "tp", "fp", "fn", *[rounded(F.col(c)).alias(c) for c in ("f1", "rmse", "max_error")])


_STEP = (2.4 - 0.3) / 32


@query(f"""
WITH RECURSIVE {_PINGS},
b AS (SELECT vec_id, start_m, part, unnest(range(32)) AS b FROM ping),
e AS (SELECT *, greatest(0, least(len(part), ceil((0.3 + b * {_STEP!r} - start_m) / {_STEP_M}))) AS lo, greatest(0, least(len(part), ceil((0.3 + (b + 1) * {_STEP!r} - start_m) / {_STEP_M}))) AS hi FROM b)
SELECT vec_id AS seq, list({r(r("coalesce(list_max(part[CAST(lo AS BIGINT) + 1:CAST(hi AS BIGINT)]), 0)", 7), 5)} ORDER BY b) AS profile FROM e GROUP BY vec_id""")
def field_recording(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of recordings as lines, written as JSON and parsed again."""
    p = pings(spark, d).withColumn("timestamp", 1.7e9 + F.col("ping") / 15).withColumn("source", F.lit("device_capture")).withColumn("device_id", F.col("ping").cast("string"))
    back = wire.parse(wire.to_lines(wire.encode(p, 32, 0.3, 2.4)))
    return back.select(F.col("device_id").cast("long").alias("seq"), F.transform("profile", lambda x: rounded(x, 5)).alias("profile"))


@query("""
WITH f AS (SELECT user_id, ts, event_id, event_type = 'error' AS saturated, CAST(event_id % 5 = 0 AS INT) AS bad, event_type = 'click' AS heard FROM events),
g AS (SELECT *, sum(CASE WHEN heard THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM f),
q AS (SELECT *, sum(CASE WHEN heard THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, grp ORDER BY event_id) AS quiet FROM g)
SELECT user_id, event_id, CASE WHEN saturated THEN 'saturated' WHEN bad > 0 THEN 'non-finite' WHEN quiet >= 5 THEN 'silent' END AS failure FROM q""")
def ranked_failures(spark: SparkSession, d: str) -> DataFrame:
    heard = F.when(F.col("event_type") == "click", F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    rows = events(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ping"), (F.col("event_type") == "error").alias("saturated"), (F.col("event_id") % 5 == 0).cast("int").alias("sanitized"), F.lit(1.0).alias("blast_amplitude"), heard.alias("detections"))
    return occupancy.failure(rows).select(F.col("session_id").alias("user_id"), F.col("ping").alias("event_id"), "failure")


# ---- dwells ----------------------------------------------------------------------------------------

_PINGS_A_DWELL, _PRF, _LAMBDA, _FLOOR = 64, 8.0, 2.0, 0.02
_KS = micromotion.band_bins(_PINGS_A_DWELL, _PRF, 0.3, 2.0)


def dwells(spark: SparkSession, d: str) -> DataFrame:
    """Each vector is a range bin of the dwell of eight: its values are the real parts, those of the next place the imaginary ones."""
    rows = table(spark, d, "embeddings").select((F.floor(F.col("vec_id") / 8)).cast("long").alias("dwell_id"), (F.col("vec_id") % 8).cast("int").alias("bin"), F.posexplode("embedding").alias("ping", "re"), "embedding")
    return rows.select("dwell_id", "bin", "ping", F.col("re").cast("double").alias("re"), F.element_at("embedding", (F.col("ping") + 1) % 64 + 1).cast("double").alias("im"))


_P = " + ".join(f"CASE WHEN {j} * g < 1 THEN {(-1) ** (j - 1) * math.comb(len(_KS), j)} * pow(greatest(1 - {j} * g, 0), {len(_KS) - 1}) ELSE 0 END" for j in range(1, min(len(_KS), 11) + 1))
_TWO_PI, _METRES = 2 * math.pi, _LAMBDA / (4 * math.pi)
#: CTEs up to motion(dwell_id, bin, status, p_value, g, rate_hz, displacement_m, peak_m)
_MOTION = f"""dwell AS (SELECT CAST(floor(vec_id / 8) AS BIGINT) AS dwell_id, CAST(vec_id % 8 AS INT) AS bin, CAST(i - 1 AS INT) AS ping, embedding[i]::DOUBLE AS re, embedding[i % 64 + 1]::DOUBLE AS im FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
power AS (SELECT dwell_id, bin, avg(re * re + im * im) - {_FLOOR**2!r} AS signal FROM dwell GROUP BY ALL),
okay AS (SELECT dwell_id, bin, signal, signal > 0 AND signal > {10**0.6!r} * {_FLOOR**2!r} AS usable FROM power),
stepped AS (SELECT d.*, atan2(im, re) AS phase, re * lag(re) OVER w + im * lag(im) OVER w AS cr, im * lag(re) OVER w - re * lag(im) OVER w AS ci FROM dwell d JOIN okay USING (dwell_id, bin) WHERE usable WINDOW w AS (PARTITION BY dwell_id, bin ORDER BY ping)),
turned AS (SELECT *, -{_TWO_PI!r} * floor(coalesce(phase - lag(phase) OVER (PARTITION BY dwell_id, bin ORDER BY ping), 0) / {_TWO_PI!r} + 0.5) AS turn FROM stepped),
flat AS (SELECT *, phase + sum(turn) OVER (PARTITION BY dwell_id, bin ORDER BY ping ROWS UNBOUNDED PRECEDING) AS whole FROM turned),
shared AS (SELECT dwell_id, ping, sum(CASE WHEN coalesce(cr, 0) = 0 AND coalesce(ci, 0) = 0 THEN 0 ELSE atan2(ci, cr) END) OVER (PARTITION BY dwell_id ORDER BY ping ROWS UNBOUNDED PRECEDING) AS common FROM (SELECT dwell_id, ping, sum(cr) AS cr, sum(ci) AS ci FROM stepped GROUP BY ALL)),
peak AS (SELECT dwell_id, max(abs(common)) * {_METRES!r} AS peak_m FROM shared GROUP BY dwell_id),
series AS (SELECT dwell_id, bin, ping, x - avg(x) OVER (PARTITION BY dwell_id, bin) AS x FROM (SELECT f.dwell_id, f.bin, f.ping, (whole - common) * {_METRES!r} AS x FROM flat f JOIN shared USING (dwell_id, ping))),
spectrum AS (SELECT dwell_id, bin, k, pow(sum(x * cos(-2 * pi() * k * ping / {_PINGS_A_DWELL})), 2) + pow(sum(x * sin(-2 * pi() * k * ping / {_PINGS_A_DWELL})), 2) AS power FROM series, (SELECT unnest({_KS}) AS k) GROUP BY ALL),
best AS (SELECT dwell_id, bin, sum(power) AS total, max(power) AS top, arg_max(k, power) AS k FROM spectrum GROUP BY ALL),
motion AS (SELECT dwell_id, bin, CASE WHEN usable THEN 'ok' ELSE 'no_return' END AS status, CASE WHEN usable THEN CASE WHEN g >= 1 THEN 0 ELSE least(1, greatest(0, {_P})) END ELSE 1 END AS p_value, CASE WHEN usable THEN k * {_PRF / _PINGS_A_DWELL!r} END AS rate_hz, CASE WHEN usable THEN 2 * sqrt(top) / {_PINGS_A_DWELL} END AS displacement_m, coalesce(peak_m, 0) AS peak_m FROM (SELECT o.*, b.top, b.k, p.peak_m, CASE WHEN total > 0 THEN top / total ELSE {1 / len(_KS)!r} END AS g FROM okay o LEFT JOIN best b USING (dwell_id, bin) LEFT JOIN peak p USING (dwell_id)))"""


def motion(spark: SparkSession, d: str) -> DataFrame:
    rows = dwells(spark, d)
    floor = rows.select("dwell_id").distinct().withColumn("noise_floor", F.lit(_FLOOR))
    return micromotion.analyze(rows, _PINGS_A_DWELL, _PRF, _LAMBDA, 0.3, 2.0, min_cycles=2.0, floor=floor)


@query(f"WITH {_MOTION} SELECT dwell_id, bin, status, {r('p_value')} AS p_value, {r('rate_hz')} AS rate_hz, {r('displacement_m')} AS displacement_m, {r('peak_m')} AS common_mode_peak_m FROM motion")
def micro_motion(spark: SparkSession, d: str) -> DataFrame:
    return motion(spark, d).select("dwell_id", "bin", "status", *[rounded(F.col(c)).alias(c) for c in ("p_value", "rate_hz", "displacement_m", "common_mode_peak_m")])


@query(f"""
WITH {_MOTION}, cap AS (SELECT DISTINCT dwell_id, dwell_id % 3 <> 0 AS body, 0.5 + (dwell_id % 8) * 0.2 AS at_m FROM motion),
f AS (SELECT c.*, usable, fires, near_ok, near_fires, moved FROM cap c JOIN (SELECT m.dwell_id, count(*) FILTER (status = 'ok') AS usable, bool_or(status = 'ok' AND p_value <= 0.3) AS fires, bool_or(status = 'ok' AND abs(bin - n) <= 1) AS near_ok, bool_or(status = 'ok' AND p_value <= 0.3 AND abs(bin - n) <= 1) AS near_fires, max(peak_m) AS moved FROM motion m JOIN (SELECT dwell_id, floor((at_m - 0.5) / 0.2 + 0.5) AS n FROM cap) USING (dwell_id) GROUP BY m.dwell_id) USING (dwell_id)),
o AS (SELECT dwell_id, usable, CASE WHEN moved > 3.0 THEN 'sensor_motion' WHEN NOT body AND usable = 0 THEN 'no_return' WHEN body AND NOT near_ok THEN 'no_return' END AS reason, body, fires, near_fires FROM f)
SELECT dwell_id, CASE WHEN reason IS NOT NULL THEN 'abstain' WHEN body THEN CASE WHEN near_fires THEN 'hit' ELSE 'miss' END ELSE CASE WHEN fires THEN 'false_alarm' ELSE 'correct_rejection' END END AS outcome, reason AS abstain_reason, CAST(usable AS BIGINT) AS usable_bins FROM o""")
def capture_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("dwell_id")
    caps = dwells(spark, d).select("dwell_id").distinct().select("dwell_id", F.lit(True).alias("consent"), (k % 3 != 0).alias("body_in_scene"), (0.5 + (k % 8) * 0.2).alias("body_range_m"), F.lit(8).alias("bins"))
    return scoring.outcomes(caps, motion(spark, d), 0.3, _PRF / 2, 2.0, 3.0, 0.5, 0.2).select("dwell_id", "outcome", "abstain_reason", F.col("usable_bins").cast("long").alias("usable_bins"))



# ---- single operators ------------------------------------------------------------------------------


@query(f"SELECT vec_id, {r('list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))')} AS similarity FROM embeddings")
def signature_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", rounded(memory.similarity(e, F.reverse(e))).alias("similarity"))


@query(f"""
SELECT event_id, {r("least(greatest(value / 50 - 0.5, 0), 1)")} AS clamped, {r("greatest(value - 25, 0)")} AS held, {r("(343 * value / 48000 + 0.1) / 2")} AS range_m, {r("(2 * value - 0.1) * 48000 / 343", 4)} AS lag, {r("2 * (4 + user_id % 60) * (pow(0.001, -1.0 / (2 * (4 + user_id % 60))) - 1)")} AS alpha, CAST(octet_length(encode(props)) + 1 AS BIGINT) AS bytes FROM events""")
def number_guards(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    out = {"clamped": N.clamp01(v / 50 - 0.5), "held": N.non_negative(v - 25), "range_m": Wf.range_at(v, F.lit(48000.0), F.lit(343.0), F.lit(0.1)), "alpha": Wf.cfar_alpha(4 + F.col("user_id") % 60, F.lit(0.001))}
    lag = rounded(Wf.lag_for(v, F.lit(48000.0), F.lit(343.0), F.lit(0.1)), 4)
    sizes = wire.byte_length(events(spark, d).select("event_id", F.col("props").alias("value")), ["event_id"])
    return events(spark, d).select("event_id", *[rounded(x).alias(k) for k, x in out.items()], lag.alias("lag")).join(sizes, "event_id")


_AT = " + ".join(f"CAST(floor((embedding[{i}]::DOUBLE * 2 + {GRID.extent_m!r}) / {GRID.voxel_m!r}) AS BIGINT) * {GRID.dim ** (i - 1)}" for i in (1, 2, 3))
_IN = " AND ".join(f"floor((embedding[{i}]::DOUBLE * 2 + {GRID.extent_m!r}) / {GRID.voxel_m!r}) BETWEEN 0 AND {GRID.dim - 1}" for i in (1, 2, 3))


@query(f"""
WITH RECURSIVE {_map_sql()}, q AS (SELECT vec_id, label AS session_id, CASE WHEN {_IN} THEN {_AT} ELSE -1 END AS voxel FROM embeddings)
SELECT vec_id, {r("coalesce(log_odds, 0)")} AS log_odds, {r("1 / (1 + exp(-coalesce(log_odds, 0)))")} AS probability, coalesce(log_odds, 0) >= {GRID.occupied!r} AS is_occupied FROM q LEFT JOIN cell USING (session_id, voxel)""")
def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double") * 2
    at = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("session_id"), G.vec(e(0), e(1), e(2)).alias("p"))
    return occupancy.lookup(at, _map(spark, d), GRID).select("vec_id", rounded(F.col("log_odds")).alias("log_odds"), rounded(F.col("probability")).alias("probability"), "is_occupied")


@query(f"""
WITH RECURSIVE {_map_sql()}, p AS (SELECT session_id, log_odds >= {GRID.occupied!r} AS occ, sqrt(x * x + y * y + z * z) >= {_RADIUS!r} AS solid FROM cell JOIN grid USING (voxel))
SELECT session_id, {r("coalesce(count(*) FILTER (occ AND solid) / nullif(count(*) FILTER (occ OR solid), 0), 1)")} AS iou FROM p GROUP BY session_id""")
def map_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = G.centre_of(F.col("voxel"), GRID.extent_m, GRID.voxel_m, GRID.dim)
    pairs = _map(spark, d).select("session_id", (F.col("log_odds") >= GRID.occupied).alias("occ"), (G.norm(p) >= _RADIUS).alias("solid"))
    return occupancy.iou(pairs, "occ", "solid", ["session_id"]).select("session_id", rounded(F.col("iou")).alias("iou"))


@query(f"""
WITH RECURSIVE {_PINGS}, d AS (SELECT vec_id, [x FOR x IN detections IF x.range_m BETWEEN 0.3 AND 2.4] AS dets FROM ping)
SELECT vec_id AS seq, vec_id || '-' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS event_id, CASE WHEN len(dets) > 0 THEN 'surface_echo' ELSE 'clear_path' END AS label, {r(f"CASE WHEN len(dets) > 0 THEN least(1, greatest(0, {r('list_max([x.snr_db FOR x IN dets])', 4)} / 20)) ELSE 0.5 END", 5)} AS confidence, {r(r("list_min([x.range_m FOR x IN dets])", 6), 5)} AS nearest_m, false AS synthetic FROM d""")
def field_events(spark: SparkSession, d: str) -> DataFrame:
    p = pings(spark, d).withColumn("timestamp", 1.7e9 + F.col("ping") / 15).withColumn("source", F.lit("device_capture")).withColumn("device_id", F.col("ping").cast("string"))
    lines = wire.parse(wire.to_lines(wire.encode(p, 32, 0.3, 2.4))).withColumn("seq", F.col("device_id").cast("long"))
    return wire.field_events(lines).select("seq", "event_id", "label", rounded(F.col("confidence"), 5).alias("confidence"), rounded(F.col("nearest_m"), 5).alias("nearest_m"), "synthetic")
