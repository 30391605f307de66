"""Single operators over the standard tables, each against the formula in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import waveform as Wf
from ..operators import kernels, memory, micromotion, profiles, scoring
from ..sources import wire
from .catalog import _CONFIG, _configs
from .recordings import _MOTION, GRID, LENGTH, SOUNDING, _envelope_sql, _map, dwells, motion, recordings
from .registry import ORACLES, query, r
from .tables import rounded, table

RAYS, SPREAD_RAD, GOLDEN = 8, 0.6, math.pi * (3 - math.sqrt(5))

_AXIS = "radians((p_partkey % 360)::DOUBLE)", "radians((p_size * 3 - 75)::DOUBLE)"


@query(f"""
WITH a AS (SELECT p_partkey AS id, sin({_AXIS[0]}) * cos({_AXIS[1]}) AS zx, -cos({_AXIS[0]}) * cos({_AXIS[1]}) AS zy, -sin({_AXIS[1]}) AS zz FROM part),
o AS (SELECT *, CASE WHEN abs(zz) < 0.9 THEN 0 ELSE 1 END::DOUBLE AS ox, CASE WHEN abs(zz) < 0.9 THEN 1 ELSE 0 END::DOUBLE AS oz FROM a),
c AS (SELECT *, -oz * zy AS cx, oz * zx - ox * zz AS cy, ox * zy AS cz FROM o), u AS (SELECT *, cx / n AS ux, cy / n AS uy, cz / n AS uz FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS n FROM c)),
v AS (SELECT *, zy * uz - zz * uy AS vx, zz * ux - zx * uz AS vy, zx * uy - zy * ux AS vz FROM u),
g AS (SELECT *, sqrt(greatest(0, 1 - c * c)) AS s, ray * {GOLDEN!r} AS t FROM (SELECT *, 1 - (ray + 0.5::DOUBLE) / {RAYS} * (1 - cos({SPREAD_RAD!r}::DOUBLE)) AS c FROM (SELECT unnest(range({RAYS}))::INT AS ray))),
d AS (SELECT id, ray, zx * c + ux * s * cos(t) + vx * s * sin(t) AS x, zy * c + uy * s * cos(t) + vy * s * sin(t) AS y, zz * c + uz * s * cos(t) + vz * s * sin(t) AS z FROM v, g)
SELECT id, ray, {r("1 + 2.5 * x")} AS x, {r("2.5 * y - 1")} AS y, {r("2.5 * z + 0.5")} AS z, {r("atan2(x, y)", 5)} AS azimuth, {r("asin(greatest(-1, least(1, z)))", 5)} AS elevation, 0.0::DOUBLE AS apart FROM d""")
def cone_directions(spark: SparkSession, d: str) -> DataFrame:
    """Rays of a cone around each device's beam: where they are after 2.5 m, and there and back through angles."""
    k, s = F.col("p_partkey"), F.col("p_size")
    axis = G.beam_direction((k % 360).cast("double"), (s * 3 - 75).cast("double"), F.lit(0.0))
    rows = table(spark, d, "part").select(k.alias("id"), F.posexplode(G.cone_rays(axis, SPREAD_RAD, RAYS)).alias("ray", "v"))
    rows = rows.withColumn("p", G.add(G.vec(F.lit(1.0), F.lit(-1.0), F.lit(0.5)), G.scale(F.col("v"), F.lit(2.5)))).withColumn("az", G.azimuth(F.col("v"))).withColumn("el", G.elevation(F.col("v")))
    apart = G.distance(F.col("v"), G.from_spherical(F.col("az"), F.col("el")))
    return rows.select("id", "ray", *[rounded(F.col(f"p.{x}")).alias(x) for x in "xyz"], rounded(F.col("az"), 5).alias("azimuth"), rounded(F.col("el"), 5).alias("elevation"), rounded(apart, 5).alias("apart"))


@query(f"""
WITH a AS (SELECT p_partkey AS id, radians(-180 + (p_partkey % 24) * (360 / 23::DOUBLE)) AS az FROM part)
SELECT id, {r("cos(radians(10::DOUBLE)) * sin(az)")} AS x, {r("cos(radians(10::DOUBLE)) * cos(az)")} AS y, {r("sin(radians(10::DOUBLE))")} AS z, CAST(least(35, floor((CASE WHEN az < -1e-12 THEN az + 2 * pi() ELSE greatest(az, 0) END + 0.01) / (2 * pi()) * 36)) AS BIGINT) AS bearing FROM a""")
def sweep_directions(spark: SparkSession, d: str) -> DataFrame:
    """Directions of a level sweep of 24 steps, and the bearing bin of each."""
    i = F.col("p_partkey") % 24
    v = G.horizontal_sweep(i, 24, 10.0)
    az = F.radians(-180 + i * (360 / 23))
    at = F.when(az < -1e-12, az + 2 * math.pi).otherwise(F.greatest(az, F.lit(0.0))) + 0.01
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[rounded(v[x]).alias(x) for x in "xyz"], wire.bearing_bin(at, 36).cast("long").alias("bearing"))


@query(f"""
WITH e AS (SELECT event_id, 100 - event_id % 130 AS age, value / 10 AS range_m, (user_id % 90) * pi() / 180 AS elevation, value - 3 AS snr_db FROM events)
SELECT event_id, {r("range_m * cos(elevation)")} AS plan_range, {r("1 - age / 60::DOUBLE")} AS fade, {r("least(greatest(snr_db / 30, 0.05), 1)")} AS strength FROM e WHERE age <= 60 AND range_m * cos(elevation) > 0""")
def plan_view(spark: SparkSession, d: str) -> DataFrame:
    """Echoes as a plan view shows them: fading with age, strength by level."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 130).alias("ping"), (F.col("value") / 10).alias("range_m"), ((F.col("user_id") % 90) * math.pi / 180).alias("elevation"), (F.col("value") - 3).alias("snr_db"))
    return wire.ppi(e, F.lit(100)).select("event_id", *[rounded(F.col(c)).alias(c) for c in ("plan_range", "fade", "strength")])


@query(f"""
WITH c AS (SELECT *, 331.3::DOUBLE * sqrt(1 + temperature_c / 273.15::DOUBLE) AS c, CASE id % 3 WHEN 0 THEN 48000 WHEN 1 THEN 44100 ELSE 32000 END::DOUBLE AS rate FROM ({_CONFIG})),
m AS (SELECT *, least(greatest(f0, f1), 0.45::DOUBLE * rate) AS top FROM c), f AS (SELECT *, greatest(1, top - abs(f1 - f0)) AS low FROM m),
n AS (SELECT *, CAST(ceil(2 * 6 / c * fs + 0.25::DOUBLE * fs + duration_s * fs) AS BIGINT) AS length FROM f)
SELECT id, {r("CASE WHEN f0 <= f1 THEN low ELSE top END")} AS f0, {r("CASE WHEN f0 <= f1 THEN top ELSE low END")} AS f1, {r("2 * 6 / c + duration_s")} AS least_interval_s, length, CAST(pow(2, ceil(log2(length))) AS BIGINT) AS padded, {r("c / (2 * fs)")} AS step_m FROM n""")
def fitted_designs(spark: SparkSession, d: str) -> DataFrame:
    """Each device's sweep fitted to its sample rate, and the records that it takes."""
    c = F.col
    rows = _configs(spark, d).withColumn("c", 331.3 * F.sqrt(1 + c("temperature_c") / 273.15)).withColumn("rate", F.element_at(F.array(*[F.lit(x) for x in (48000.0, 44100.0, 32000.0)]), (c("id") % 3 + 1).cast("int")))
    f0, f1 = Wf.fit_to_rate(c("f0"), c("f1"), c("rate"))
    length = Wf.record_length(F.lit(6.0), c("c"), c("fs"), F.lit(0.25), c("duration_s"))
    return rows.select("id", rounded(f0).alias("f0"), rounded(f1).alias("f1"), rounded(Wf.min_interval_s(F.lit(6.0), c("c"), c("duration_s"))).alias("least_interval_s"), length.cast("long").alias("length"), Wf.next_pow2(length).cast("long").alias("padded"), rounded(c("c") / (2 * c("fs"))).alias("step_m"))


LO_HZ, CUTOFF_HZ = 900.0, 400.0
_KEEP = f"exp(-2 * pi() * {CUTOFF_HZ!r} / {SOUNDING.fs!r})"


@query(f"""
WITH rec AS (SELECT vec_id, list_concat(list_concat(e, list_reverse(e)), list_concat(e, list_reverse(e))) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
p AS (SELECT [(1 - {_KEEP}) * pow({_KEEP}, {LENGTH} - i) FOR i IN range(1, {LENGTH + 1})] AS tail),
m AS (SELECT vec_id, [x[i] * cos(2 * pi() * {LO_HZ!r} / {SOUNDING.fs!r} * (i - 1)) FOR i IN range(1, {LENGTH + 1})] AS mixed FROM rec)
SELECT vec_id, [{r("list_dot_product(mixed[1:i], tail[" + str(LENGTH + 1) + " - i:" + str(LENGTH) + "])")} FOR i IN range(1, {LENGTH + 1})] AS baseband FROM m, p""")
def heterodyned(spark: SparkSession, d: str) -> DataFrame:
    """Recordings mixed down and smoothed."""
    rows = kernels.heterodyned(recordings(spark, d), SOUNDING.fs, LO_HZ, CUTOFF_HZ, LENGTH)
    return rows.select("vec_id", F.transform("baseband", lambda x: rounded(x)).alias("baseband"))


@query(f"""
WITH {_envelope_sql()} SELECT vec_id, [CASE WHEN x > 0 THEN {r("greatest(-60, 20 * log10(x / greatest(list_max(env), 1e-20)))", 4)} ELSE -60 END FOR x IN env] AS level_db FROM env""")
def envelope_levels(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes in decibels below their peak."""
    env = kernels.compress(recordings(spark, d), SOUNDING, LENGTH)
    return env.select("vec_id", F.transform(profiles.db_below_peak(F.col("envelope")), lambda x: rounded(x, 4)).alias("level_db"))


@query(f"""
WITH w AS (SELECT CAST(floor(vec_id / 8) AS BIGINT) AS dwell_id, vec_id % 8 AS bin, list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]) * 2 / 64 AS p FROM embeddings)
SELECT dwell_id, {r("sqrt(quantile_cont(p, 0.5))")} AS noise_floor FROM w GROUP BY dwell_id""")
def dwell_noise(spark: SparkSession, d: str) -> DataFrame:
    """The noise floor of each dwell, from the median of its bins."""
    return micromotion.noise_floor(dwells(spark, d)).select("dwell_id", rounded(F.col("noise_floor")).alias("noise_floor"))


@query(f"""
WITH {_MOTION} SELECT dwell_id, bin, CASE WHEN status = 'ok' THEN {r("1 - p_value")} END AS micromotion_band FROM motion""")
def motion_features(spark: SparkSession, d: str) -> DataFrame:
    """The one feature that a dwell's bin may publish."""
    f = micromotion.feature(motion(spark, d))
    return f.select("dwell_id", "bin", rounded(F.col("feature.micromotion_band")).alias("micromotion_band"))


# ---- suites and signatures -----------------------------------------------------------------------------


@query("""
WITH RECURSIVE c AS (SELECT s_suppkey AS id, s_suppkey * 7 % 40 AS room, s_suppkey % 3 <> 0 AS named FROM supplier),
k AS (SELECT room, bool_or(named) AS linked FROM c GROUP BY room),
g AS (SELECT room, min('a:r' || room) OVER (PARTITION BY CASE WHEN linked THEN floor(room / 4) ELSE 100 + room END) AS label FROM k),
n AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS place FROM c JOIN g USING (room) GROUP BY label),
d AS (SELECT 0 AS place, 0 AS h, 0 AS a, '' AS label, '' AS suite
  UNION ALL SELECT n.place, CASE WHEN h <= a THEN h + n.n ELSE h END, CASE WHEN h <= a THEN a ELSE a + n.n END, n.label, CASE WHEN h <= a THEN 'holdout' ELSE 'anchor' END FROM d JOIN n ON n.place = d.place + 1)
SELECT c.id, d.suite FROM c JOIN g USING (room) JOIN d USING (label)""")
def corpus_split(spark: SparkSession, d: str) -> DataFrame:
    """Captures dealt into two suites that share no room and no subject, each of which passes the gates of a corpus."""
    k = F.col("s_suppkey")
    room = k * 7 % 40
    body = k % 2 == 0
    rows = table(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("r"), room.cast("string")).alias("room_id"), F.when(k % 3 != 0, F.concat(F.lit("s"), F.floor(room / 4).cast("string"))).alias("subject_id"), F.lit(True).alias("consent"), body.alias("body_in_scene"), F.when(body, 1.5).alias("body_range_m"))
    return scoring.split_by_component(rows).select("id", "suite")


@query(f"""
SELECT session_id, 'ultrasonic' AS modality, 'P3' AS privacy_class, 'scan-' || session_id AS source_event_id, CAST({memory.DIM} AS INT) AS size, count(*) AS filled, {r("sum(v)", 2)} AS total FROM ({ORACLES["room_signatures"]}) GROUP BY session_id""")
def published_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Each session's signature as the field endpoint takes it."""
    s = memory.signatures(_map(spark, d), GRID)
    out = memory.field_embeddings(s.withColumn("event", F.concat(F.lit("scan-"), F.col("session_id").cast("string"))), F.col("event"))
    kept = F.filter(F.transform("vector", lambda x: rounded(x.cast("double"), 4)), lambda x: x != 0)
    filled = F.size(F.filter("vector", lambda x: x != 0)).cast("long")
    return out.select(F.substring("source_event_id", 6, 40).cast("long").alias("session_id"), "modality", "privacy_class", "source_event_id", F.size("vector").alias("size"), filled.alias("filled"), rounded(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), 2).alias("total"))
