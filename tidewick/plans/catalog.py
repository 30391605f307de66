"""Queries of the engine's operators over the standard tables, each with SQL where SQL can say the same."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import WINDOWS, Grid, Sonar
from ..functions import geometry as G
from ..functions import numbers as N
from ..functions import waveform as Wf
from ..operators import cfar, clamped, memory, occupancy, policy, scoring
from ..sources import wire
from .registry import query, r
from .tables import events, rounded, table

CFAR = Sonar(cfar_train=8, cfar_guard=2, cfar_pfa=0.2, cfar_merge_gap=2)
_KEY, _ORDER = ["user_id"], ["ts", "event_id"]
_W = "(PARTITION BY user_id ORDER BY ts, event_id"
_LO, _HI = f"{_W} ROWS BETWEEN 10 PRECEDING AND 3 PRECEDING)", f"{_W} ROWS BETWEEN 3 FOLLOWING AND 10 FOLLOWING)"
_THRESHOLD = f"""
  SELECT user_id, event_id, value, row_number() OVER {_W}) - 1 AS i,
    greatest(sqrt({CFAR.alpha!r} * CASE WHEN count(value) OVER {_LO} + count(value) OVER {_HI} > 0
      THEN (coalesce(sum(value * value) OVER {_LO}, 0) + coalesce(sum(value * value) OVER {_HI}, 0)) / (count(value) OVER {_LO} + count(value) OVER {_HI}) ELSE 0 END), 1e-6) AS threshold
  FROM events"""


@query(f"SELECT user_id, event_id, i, {r('threshold')} AS threshold FROM ({_THRESHOLD})")
def ca_cfar_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = cfar.threshold(events(spark, d), "value", _KEY, _ORDER, CFAR)
    return rows.select("user_id", "event_id", F.col("i").cast("long").alias("i"), rounded(F.col("threshold")).alias("threshold"))


@query(f"""
WITH t AS ({_THRESHOLD}), a AS (SELECT *, CASE WHEN lag(i) OVER w IS NULL OR i - lag(i) OVER w - 1 > 2 THEN 1 ELSE 0 END AS new FROM t WHERE value > threshold WINDOW w AS (PARTITION BY user_id ORDER BY i)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS span FROM a),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, span ORDER BY value DESC, i) AS rn FROM s)
SELECT user_id, CAST(span AS BIGINT) AS span, CAST(min(i) AS BIGINT) AS first, CAST(max(i) + 1 AS BIGINT) AS last, count(*) AS cells, CAST(max(CASE WHEN rn = 1 THEN i END) AS BIGINT) AS peak_i,
  max(CASE WHEN rn = 1 THEN value END) AS peak, {r('max(CASE WHEN rn = 1 THEN 20 * log10(value / threshold) END)')} AS snr_db FROM p GROUP BY user_id, span""")
def ca_cfar_detections(spark: SparkSession, d: str) -> DataFrame:
    rows = cfar.spans(cfar.threshold(events(spark, d), "value", _KEY, _ORDER, CFAR), "value", _KEY, CFAR.cfar_merge_gap)
    whole = [F.col(c).cast("long").alias(c) for c in ("span", "first", "last", "cells", "peak_i")]
    return rows.select("user_id", *whole, "peak", rounded(cfar.snr_db(F.col("peak"), F.col("threshold"))).alias("snr_db"))


@query(f"""
SELECT user_id, event_id, {r(f"CASE WHEN len(c) > 0 THEN list_sort(c)[CAST(floor((len(c) - 1) * 0.75 + 0.5) AS INT) + 1] ELSE 0 END")} AS noise FROM (
  SELECT user_id, event_id, list_concat(coalesce(list(value * value) OVER {_LO}, []), coalesce(list(value * value) OVER {_HI}, [])) AS c FROM events)""")
def os_cfar_noise(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", "event_id", rounded(cfar.os_noise("value", _KEY, _ORDER, 8, 2, 0.75)).alias("noise"))


@query(f"""
SELECT user_id, event_id, {r("coalesce(CASE WHEN abs(s) <= 1 THEN s END, 0)")} AS shift FROM (
  SELECT *, CASE WHEN abs(a - 2 * value + c) >= 1e-12 THEN 0.5 * (a - c) / (a - 2 * value + c) END AS s FROM (SELECT user_id, event_id, value, lag(value) OVER {_W}) AS a, lead(value) OVER {_W}) AS c FROM events))""")
def parabolic_peak(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", "event_id", rounded(cfar.parabolic("value", _KEY, _ORDER)).alias("shift"))


_PI2 = repr(2 * math.pi)


@query(f"""
WITH p AS (SELECT user_id, event_id, ts, value % {_PI2} AS phase FROM events), t AS (SELECT *, -{_PI2} * floor(coalesce(phase - lag(phase) OVER {_W}), 0) / {_PI2} + 0.5) AS turn FROM p)
SELECT user_id, event_id, {r(f"phase + sum(turn) OVER {_W} ROWS UNBOUNDED PRECEDING)")} AS unwrapped FROM t""")
def phase_unwrap(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("phase", F.col("value") % (2 * math.pi))
    return cfar.turns(rows, "phase", _KEY, _ORDER).select("user_id", "event_id", rounded(cfar.unwrap("phase", _KEY, _ORDER)).alias("unwrapped"))


@query(f"""
SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS nearest_rank, {r("quantile_cont(l_extendedprice, 0.5)")} AS median FROM lineitem GROUP BY ALL""")
def quantile_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Both medians; no group's prices are brought together: counts by range find the range that holds a rank, and only that one is ranked."""
    keys = ["l_returnflag", "l_linestatus"]
    q = cfar.grouped_ranks(table(spark, d, "lineitem"), keys, "l_extendedprice", {"nearest": lambda n: F.floor((n - 1) * 0.5 + 0.5), "low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)})
    return q.select(*keys, F.col("nearest").alias("nearest_rank"), rounded((F.col("low") + F.col("high")) / 2).alias("median"))


@query(f"""
WITH a AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER w > 2.0 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM a)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS members, {r('avg(value)')} AS mean_value FROM c GROUP BY user_id, cluster""")
def gap_clustering(spark: SparkSession, d: str) -> DataFrame:
    rows = cfar.gap_clusters(events(spark, d), "value", _KEY, ["value", "event_id"], 2.0)
    return rows.groupBy("user_id", F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("members"), rounded(F.avg("value")).alias("mean_value"))


@query(f"""
WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER {_W} ROWS UNBOUNDED PRECEDING) AS grp FROM events)
SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g""")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    rows = cfar.streaks(events(spark, d).withColumn("bad", F.col("event_type") == "error"), "bad", _KEY, _ORDER)
    return rows.select("user_id", "event_id", F.col("streak").cast("long").alias("streak"))


_DELTA = "(value % 7 - 3) / 4"
_FOLD = f"SELECT user_id AS voxel, list_reduce(list_prepend(0.0::DOUBLE, list({_DELTA} ORDER BY event_id)), lambda a, x: greatest(-4.0, least(4.0, a + x))) AS log_odds FROM events GROUP BY user_id"


def _folded(spark, d):
    delta = (F.col("value") % 7 - 3) / 4
    return clamped.fold(events(spark, d).withColumnRenamed("user_id", "voxel"), ["voxel"], F.col("event_id"), delta, -4.0, 4.0, "log_odds")


@query(f"SELECT voxel, {r('log_odds')} AS log_odds FROM ({_FOLD}) WHERE log_odds <> 0")
def log_odds_fold(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).where("log_odds <> 0").select("voxel", rounded(F.col("log_odds")).alias("log_odds"))


@query(f"""
SELECT count(*) FILTER (log_odds >= 1.4) AS occupied, count(*) FILTER (log_odds <> 0) AS known, {r("avg(CASE WHEN p > 0 AND p < 1 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) ELSE 0 END) FILTER (log_odds <> 0)")} AS mean_entropy,
  'bv1:' || lpad(lower(to_hex(CAST(sum({N.cell_hash_sql("voxel", "log_odds")}) % 4294967296 AS BIGINT))), 8, '0') AS signature
FROM (SELECT *, 1 / (1 + exp(-log_odds)) AS p FROM (SELECT voxel, floor(log_odds * 1e6 + 0.5) / 1e6 AS log_odds FROM ({_FOLD})))""")
def map_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _folded(spark, d).select(F.lit("map").alias("session_id"), "voxel", rounded(F.col("log_odds")).alias("log_odds"))
    return occupancy.summary(rows).select("occupied", "known", rounded(F.col("mean_entropy")).alias("mean_entropy"), "signature")


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, (rank, event_id)) AS value FROM (SELECT *, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS rank FROM events) GROUP BY ALL""")
def first_writer(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    rows = table(spark, d, "events")
    return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("value", F.struct(rank, "event_id")).alias("value"))


_UNNEST = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"


@query(f"""
SELECT vec_id, k, {r("sqrt(pow(sum(v * cos(-2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(-2 * pi() * k * i / 64)), 2))")} AS magnitude FROM ({_UNNEST}), (SELECT unnest(range(6))::INT AS k) GROUP BY vec_id, k""")
def dft_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    s = memory.spectrum(rows, ["vec_id"], "i", "v", 64, 6)
    return s.select("vec_id", "k", rounded(F.col("magnitude")).alias("magnitude"))


_SCORED = """SELECT q.vec_id AS query_id, s.vec_id AS id, sum(q.v * s.v) / (sqrt(sum(q.v * q.v)) * sqrt(sum(s.v * s.v))) AS similarity
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 20 = 0) q JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) s USING (i) GROUP BY ALL"""
_RANKED = f"SELECT query_id, id, similarity, row_number() OVER w AS rank, coalesce(similarity - lead(similarity) OVER w, 'inf'::DOUBLE) AS margin FROM ({_SCORED}) WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, id)"


def _vectors(spark, d, only=None):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return rows if only is None else rows.where(F.col("id") % only == 0)


@query(f"SELECT query_id, id, rank, {r('similarity')} AS similarity, {r('margin')} AS margin FROM ({_RANKED}) WHERE rank <= 5 AND similarity >= 0.2")
def similarity_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = memory.recall(_vectors(spark, d, 20), _vectors(spark, d), 5, 0.2)
    return rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"), rounded(F.col("similarity")).alias("similarity"), rounded(F.col("margin")).alias("margin"))


@query(f"SELECT query_id, id, {r('similarity')} AS similarity FROM ({_RANKED}) WHERE rank = 1 AND similarity >= 0.9 AND margin >= 0.02")
def room_recognition(spark: SparkSession, d: str) -> DataFrame:
    return memory.recognize(_vectors(spark, d, 20), _vectors(spark, d)).select("query_id", "id", rounded(F.col("similarity")).alias("similarity"))


@query(f"""
SELECT vec_id, [greatest(0.0, list_max(embedding[2 * i + 1:2 * i + 2])::DOUBLE) FOR i IN range(32)] AS pooled FROM embeddings""")
def envelope_max_pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", wire.max_pool(F.col("embedding"), 32).alias("pooled"))


_DIR = "SELECT vec_id, label, embedding[1]::DOUBLE / n AS x, embedding[2]::DOUBLE / n AS y, embedding[3]::DOUBLE / n AS z FROM (SELECT *, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2) AS n FROM embeddings)"


def _directions(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select("vec_id", "label", G.normalize(G.vec(e(0), e(1), e(2))).alias("p"), G.vec(e(3), e(4), e(5)).alias("q"))


@query(f"""
SELECT label, {r("count(DISTINCT least(greatest(floor((asin(greatest(-1, least(1, z))) + pi() / 2) / pi() * 18), 0), 17) * 36 + least(greatest(floor((atan2(x, y) + pi()) / (2 * pi()) * 36), 0), 35)) / 648")} AS coverage FROM ({_DIR}) GROUP BY label""")
def angular_coverage(spark: SparkSession, d: str) -> DataFrame:
    return occupancy.angular_coverage(_directions(spark, d), F.col("p"), ["label"]).select("label", rounded(F.col("coverage")).alias("coverage"))


_Q = "embedding[4]::DOUBLE AS qx, embedding[5]::DOUBLE AS qy, embedding[6]::DOUBLE AS qz"


@query(f"""
SELECT vec_id, {r("x * qx + y * qy + z * qz")} AS dot, {r("y * qz - z * qy")} AS cross_x, {r("sqrt((x - qx) ** 2 + (y - qy) ** 2 + (z - qz) ** 2)")} AS distance,
  {r("acos(greatest(-1, least(1, (x * qx + y * qy + z * qz) / sqrt(qx ** 2 + qy ** 2 + qz ** 2))))")} AS angle, {r("atan2(x, y)")} AS azimuth, {r("asin(greatest(-1, least(1, z)))")} AS elevation,
  {r("sqrt((1 + z) / 2)")} AS quat_w, {r("-y / (2 * sqrt((1 + z) / 2))")} AS quat_x
FROM ({_DIR}) JOIN (SELECT vec_id, {_Q} FROM embeddings) USING (vec_id)""")
def vector_geometry(spark: SparkSession, d: str) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    quat = G.quaternion_to(p)
    out = {"dot": G.dot(p, q), "cross_x": G.cross(p, q)["x"], "distance": G.distance(p, q), "angle": G.angle_between(p, q), "azimuth": G.azimuth(p), "elevation": G.elevation(p), "quat_w": quat[3], "quat_x": quat[0]}
    return _directions(spark, d).select("vec_id", *[rounded(v).alias(k) for k, v in out.items()])


@query(f"""
SELECT l_orderkey, l_linenumber, p_partkey, {r("l_extendedprice / l_quantity - p_retailprice")} AS gap FROM lineitem JOIN part ON l_partkey = p_partkey AND abs(l_extendedprice / l_quantity - p_retailprice) <= 50""")
def tolerance_join(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("range_m"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("truth_m"))
    j = scoring.band_pairs(li, p, ["k"], 50.0)
    return j.select("l_orderkey", "l_linenumber", F.col("k").alias("p_partkey"), rounded(F.col("range_m") - F.col("truth_m")).alias("gap"))


@query("""
SELECT e.user_id, e.event_id, m.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY ALL) m ON e.user_id = m.user_id AND e.ts >= m.ts""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    marks = e.where("event_type = 'error'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("last_value"))
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return scoring.latest_before(clicks, marks, "user_id", "ts", "last_value").select("user_id", "event_id", "last_value")


# ---- settings held in columns: one row for each part ----------------------------------------------

_NAMES = list(WINDOWS)
_CONFIG = f"""SELECT p_partkey AS id, 48000.0::DOUBLE AS fs, 16000.0::DOUBLE + (p_partkey % 9) * 500 AS f0, 18000.0::DOUBLE + (p_partkey % 13) * 500 AS f1, 0.002::DOUBLE + (p_size % 10) * 0.001::DOUBLE AS duration_s, 0.3::DOUBLE + (p_size % 8) * 0.1::DOUBLE AS amplitude,
  [{", ".join(f"'{n}'" for n in _NAMES)}][CAST(p_partkey % 6 AS INT) + 1] AS tx_window, 'rect' AS rx_taper, (p_partkey % 5) * 0.25::DOUBLE AS tukey_alpha, 5.0::DOUBLE + p_size AS ping_rate_hz, (p_size % 40)::DOUBLE AS temperature_c, p_retailprice FROM part"""


def _configs(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    names = F.array(*[F.lit(n) for n in _NAMES])
    return table(spark, d, "part").select(k.alias("id"), F.lit(48000.0).alias("fs"), (16000.0 + (k % 9) * 500).alias("f0"), (18000.0 + (k % 13) * 500).alias("f1"), (0.002 + (s % 10) * 0.001).alias("duration_s"), (0.3 + (s % 8) * 0.1).alias("amplitude"), F.element_at(names, (k % 6).cast("int") + 1).alias("tx_window"), F.lit("rect").alias("rx_taper"), ((k % 5) * 0.25).alias("tukey_alpha"), (5.0 + s).alias("ping_rate_hz"), (s % 40).cast("double").alias("temperature_c"), "p_retailprice")


_WIDEN = "CASE tx_window " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in WINDOWS.items()) + " END"
_SIDE = "CASE tx_window " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in WINDOWS.items()) + " END"


@query(f"""
WITH c AS (SELECT *, 331.3 * sqrt(greatest(0, 1 + temperature_c / 273.15)) AS c, abs(f1 - f0) AS b FROM ({_CONFIG})), m AS (SELECT *, fs / greatest(1, b) * greatest({_WIDEN}, 1.0) AS lobe FROM c)
SELECT id, {r("c")} AS c, {r("b")} AS bandwidth, {r("CASE WHEN b * duration_s <= 1 THEN 0 ELSE 10 * log10(b * duration_s) END")} AS gain_db, {r("c * duration_s / 2")} AS blind_m, {r("c / (2 * fs)")} AS step_m, {r("c / ping_rate_hz / 2")} AS unambiguous_m,
  least({_SIDE}, -13.3)::DOUBLE AS sidelobe_db, {r("lobe")} AS lobe, CAST(greatest(4, ceil(1.5 * lobe)) AS BIGINT) AS guard, CAST(greatest(16, 2 * greatest(4, ceil(1.5 * lobe))) AS BIGINT) AS train, CAST(greatest(2, ceil(lobe)) AS BIGINT) AS merge_gap, CAST(floor(fs / ping_rate_hz + 0.5) AS BIGINT) AS pri FROM m""")
def design_report(spark: SparkSession, d: str) -> DataFrame:
    fs, f0, f1, dur, rate = (F.col(x) for x in ("fs", "f0", "f1", "duration_s", "ping_rate_hz"))
    c, b = Wf.speed_of_sound(F.col("temperature_c")), F.abs(f1 - f0)
    lobe = Wf.mainlobe(fs, b, F.col("tx_window"), F.col("rx_taper"))
    floats = {"c": c, "bandwidth": b, "gain_db": Wf.compression_gain_db(b, dur), "blind_m": c * dur / 2, "step_m": c / (2 * fs), "unambiguous_m": c / rate / 2, "lobe": lobe}
    whole = {"guard": Wf.guard(lobe), "train": Wf.train(lobe), "merge_gap": Wf.merge_gap(lobe), "pri": Wf.pri_samples(fs, rate)}
    side = F.least(Wf.first_sidelobe_db(F.col("tx_window")), Wf.first_sidelobe_db(F.col("rx_taper")))
    return _configs(spark, d).select("id", *[rounded(v).alias(k) for k, v in floats.items()], side.alias("sidelobe_db"), *[v.cast("long").alias(k) for k, v in whole.items()])


def _tap(x: str) -> str:
    cos = lambda k: f"cos(2 * pi() * {k} * {x})"
    edge = f"least({x}, 1 - {x})"
    return f"""CASE WHEN {x} < 0 OR {x} > 1 THEN 0 ELSE CASE tx_window WHEN 'rect' THEN 1 WHEN 'hamming' THEN 0.54 - 0.46 * {cos(1)} WHEN 'blackman' THEN 0.42 - 0.5 * {cos(1)} + 0.08 * {cos(2)}
    WHEN 'blackman-harris' THEN 0.35875 - 0.48829 * {cos(1)} + 0.14128 * {cos(2)} - 0.01168 * {cos(3)} WHEN 'tukey' THEN CASE WHEN {edge} >= 0.5 THEN 1 ELSE 0.5 * (1 - cos(2 * pi() * {edge})) END ELSE 0.5 - 0.5 * {cos(1)} END END"""


@query(f"""
SELECT id, n, {r("amplitude * (" + _tap("(t / duration_s)") + ") * sin((2 * pi() * (f0 * t + (f1 - f0) / duration_s * t * t / 2)) % (2 * pi()))", 5)} AS sample FROM (SELECT *, n / fs AS t FROM ({_CONFIG}), (SELECT unnest(range(0, 600))::INT AS n)) WHERE t <= duration_s""")
def pulse_samples(spark: SparkSession, d: str) -> DataFrame:
    """The samples of each part's pulse. A part becomes hundreds of rows, so parts are dealt out first: the table alone is a file or two, and as many tasks."""
    parts = _configs(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    rows = parts.withColumn("n", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_s") * F.col("fs")).cast("int") + 1))).withColumn("t", F.col("n") / F.col("fs")).where("t <= duration_s")
    s = Wf.pulse_at(F.col("amplitude"), F.col("tx_window"), F.col("f0"), F.col("f1"), F.col("duration_s"), F.col("t"))
    return rows.select("id", "n", rounded(s, 5).alias("sample"))


@query(f"""
WITH c AS (SELECT *, least(f0, f1) AS lo, greatest(f0, f1) AS hi FROM ({_CONFIG}))
SELECT id, CASE WHEN amplitude > 0.8 OR lo < 17500 OR hi >= fs / 2 OR duration_s * ping_rate_hz > 0.35 THEN 'deny' WHEN hi > 23000 OR ping_rate_hz > 25 OR tx_window = 'rect' OR (tx_window = 'tukey' AND tukey_alpha < 0.05) THEN 'gate' ELSE 'allow' END AS verdict,
  CAST((amplitude > 0.8)::INT + (lo < 17500)::INT + (hi > 23000)::INT + (hi >= fs / 2)::INT + (ping_rate_hz > 25)::INT + (duration_s * ping_rate_hz > 0.35)::INT + (tx_window = 'rect' OR (tx_window = 'tukey' AND tukey_alpha < 0.05))::INT AS INT) AS findings FROM c""")
def emission_guard(spark: SparkSession, d: str) -> DataFrame:
    return policy.emission(_configs(spark, d)).select("id", "verdict", F.size("findings").alias("findings"))


@query(f"""
SELECT id, 'amplitude=' || CAST(id % 7 AS VARCHAR) || ';rate=' || CAST(id % 11 AS VARCHAR) AS encoded, CAST(id % 7 AS BIGINT) AS amplitude, false AS has_unknown FROM ({_CONFIG})""")
def lever_codec(spark: SparkSession, d: str) -> DataFrame:
    fields = F.create_map(F.lit("amplitude"), (F.col("id") % 7).cast("string"), F.lit("rate"), (F.col("id") % 11).cast("string"))
    rows = _configs(spark, d).select("id", policy.encode_lever(fields).alias("encoded"))
    back = policy.decode_lever(F.col("encoded"))
    return rows.select("id", "encoded", back["amplitude"].cast("long").alias("amplitude"), (F.size(policy.unknown_keys(back, ["amplitude", "rate"])) > 0).alias("has_unknown"))


@query(f"""
SELECT id, {r("(0.4 + (id % 6) / 10.0) * pow(0.5, least(greatest(2 - (1 + id % 2), 0), 1)) * pow(1 + p_retailprice / 1000, -(1 + id % 2)) * pow(10, -2 * 0.8 * (1 + p_retailprice / 1000) / 20)")} AS echo, {r("pow(10, -0.8 * (1 + p_retailprice / 1000) / 20) / (1 + p_retailprice / 1000)")} AS direct,
  {r("0.002 * sin(2 * pi() * 0.25 * id / 15.0 + 0.7)")} AS moved, {r("1 / sqrt(2 * pow(10, (id % 30) / 10.0))")} AS phase_noise FROM ({_CONFIG})""")
def echo_model(spark: SparkSession, d: str) -> DataFrame:
    rm, k = 1 + F.col("p_retailprice") / 1000, F.col("id")
    out = {"echo": Wf.echo_amplitude(0.4 + (k % 6) / 10.0, rm, (1 + k % 2).cast("double"), F.lit(0.8)), "direct": Wf.direct_amplitude(rm, F.lit(0.8)), "moved": Wf.displacement(F.lit(0.002), F.lit(0.25), F.lit(0.7), k / 15.0), "phase_noise": Wf.phase_noise_rad((k % 30).cast("double"))}
    return _configs(spark, d).select("id", *[rounded(v).alias(c) for c, v in out.items()])


@query(f"""
SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, floor(value * 100 + 0.5) / 100 AS value2, CASE WHEN value = 0 THEN 0 ELSE sign(value) * floor(abs(value) * pow(10, 3 - floor(log10(abs(value)))) + 0.5) / pow(10, 3 - floor(log10(abs(value)))) END AS sig4 FROM events""")
def json_fields_and_rounding(spark: SparkSession, d: str) -> DataFrame:
    j = F.from_json("props", "k long")
    return events(spark, d).select("user_id", "event_id", j["k"].alias("k"), N.round_up_half(F.col("value"), 2).alias("value2"), N.significant(F.col("value"), 4).alias("sig4"))


@query("""
SELECT doc_id, octet_length(encode(text)) <= 4096 AS within_cap, octet_length(encode(trim(source))) BETWEEN 1 AND 256 AND NOT regexp_matches(source, '[\\x00-\\x1f\\x7f]') AS id_ok FROM documents""")
def size_caps_and_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.octet_length("text") <= 4096).alias("within_cap"), N.valid_id(F.col("source")).alias("id_ok"))


_CAPTURES = "SELECT doc_id % 5 AS suite, CASE WHEN doc_id % 11 = 0 THEN 'abstain' WHEN quality = 1 AND toxic = 1 THEN 'hit' WHEN quality = 1 THEN 'miss' WHEN toxic = 1 THEN 'false_alarm' ELSE 'correct_rejection' END AS outcome, CAST(doc_id % 13 AS INT) AS usable_bins FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL"


@query(f"""
WITH o AS (SELECT *, CASE WHEN outcome IN ('false_alarm', 'correct_rejection') THEN CASE WHEN usable_bins <= 0 THEN 0 ELSE 1 - pow(1 - 0.05, usable_bins) END END AS p FROM ({_CAPTURES})),
a AS (SELECT suite, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in scoring.OUTCOMES)}, coalesce(sum(p), 0) AS e, sqrt(coalesce(sum(p * (1 - p)), 0)) AS s FROM o GROUP BY suite)
SELECT suite, {", ".join(scoring.OUTCOMES)}, {r("coalesce(hit / nullif(hit + miss, 0), 0)")} AS hit_rate, {r("coalesce(false_alarm / nullif(false_alarm + correct_rejection, 0), 0)")} AS fa_rate, {r("coalesce(hit / nullif(hit + miss, 0), 0) - coalesce(false_alarm / nullif(false_alarm + correct_rejection, 0), 0)")} AS "primary", false_alarm > e + 3 * s AS over_budget FROM a""")
def detector_suite_score(spark: SparkSession, d: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    o = F.when(F.col("doc_id") % 11 == 0, "abstain").when(q & t, "hit").when(q, "miss").when(t, "false_alarm").otherwise("correct_rejection")
    rows = table(spark, d, "labels").where("quality is not null and toxic is not null").select((F.col("doc_id") % 5).alias("suite"), o.alias("outcome"), (F.col("doc_id") % 13).cast("int").alias("usable_bins"))
    s = scoring.suite_score(rows, 0.05, ["suite"])
    return s.select("suite", *scoring.OUTCOMES, *[rounded(F.col(c)).alias(c) for c in ("hit_rate", "fa_rate", "primary")], "over_budget")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'a:' || CAST(s_nationkey AS VARCHAR) AS x, 'b:' || CAST(CAST(floor(s_acctbal / 900) AS BIGINT) AS VARCHAR) AS y FROM supplier),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e), reach AS (SELECT x AS node, x AS label FROM both_ways UNION SELECT b.y, r.label FROM reach r JOIN both_ways b ON r.node = b.x)
SELECT node, min(label) AS label FROM reach GROUP BY node""")
def room_subject_components(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("room"), F.floor(F.col("s_acctbal") / 900).cast("long").alias("subject"))
    return scoring.components(rows, "room", "subject")


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 64")
def retained_events(spark: SparkSession, d: str) -> DataFrame:
    return wire.retained(events(spark, d).withColumn("seq", F.col("event_id")), "user_id").select("user_id", "event_id")


@query("""
SELECT user_id, event_id, coalesce(t > max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 100000 AS accepted FROM (SELECT *, value AS t FROM events)""")
def recording_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), F.col("value").alias("timestamp"))
    return wire.recording(rows).select("user_id", "event_id", "accepted")


_GRID = Grid()


@query(f"""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 4 AS x, embedding[2]::DOUBLE * 4 AS y, embedding[3]::DOUBLE * 4 AS z FROM embeddings), i AS (SELECT *, floor((x + 6.0) / 0.1) AS i, floor((y + 6.0) / 0.1) AS j, floor((z + 6.0) / 0.1) AS k FROM p),
v AS (SELECT vec_id, CASE WHEN least(i, j, k) < 0 OR greatest(i, j, k) >= 120 THEN -1 ELSE (k * 120 + j) * 120 + i END AS voxel FROM i)
SELECT vec_id, CAST(voxel AS BIGINT) AS voxel, {r("(voxel % 120 + 0.5) * 0.1 - 6.0")} AS cx, {r("(floor(voxel / 120) % 120 + 0.5) * 0.1 - 6.0")} AS cy FROM v""")
def voxel_indexing(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double") * 4
    rows = table(spark, d, "embeddings").select("vec_id", G.voxel_of(G.vec(e(0), e(1), e(2)), 6.0, 0.1, 120).cast("long").alias("voxel"))
    c = G.centre_of(F.col("voxel"), 6.0, 0.1, 120)
    return rows.select("vec_id", "voxel", rounded(c["x"]).alias("cx"), rounded(c["y"]).alias("cy"))


@query(f"""
WITH p AS (SELECT vec_id, ROW(embedding[1], embedding[2], embedding[3]) AS p, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, vec_id % 2 AS side FROM embeddings),
d AS (SELECT a.vec_id AS ia, b.vec_id AS ib, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a, p b WHERE a.side = 0 AND b.side = 1)
SELECT {r("((SELECT avg(m) FROM (SELECT min(d) AS m FROM d GROUP BY ia)) + (SELECT avg(m) FROM (SELECT min(d) AS m FROM d GROUP BY ib))) / 2")} AS chamfer""")
def chamfer_distance(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), G.vec(e(0), e(1), e(2)).alias("p"))
    return scoring.chamfer(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).select(rounded(F.col("chamfer")).alias("chamfer"))


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select("user_id", F.col("w.start").alias("start"), "n", "top")


@query("""
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n")).select("user_id", "first", "n")


@query(f"""
SELECT r_name, n_name, count(*) AS lines, {r("sum(l_extendedprice * (1 - l_discount))", 2)} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_revenue(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    # dimensions are joined to customers before the large tables meet; sizes decide on broadcasts
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")
    o = t("orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("lines"), rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
