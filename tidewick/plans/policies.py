"""Queries over policies and the rules for what is recorded, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import waveform as Wf
from ..operators import memory, policy, scoring
from .registry import query, r
from .tables import rounded, table

_L = policy.DETECTOR_LADDERS
_CHOICE = {"dwell": "CAST(p_partkey % 5 AS INT)", "band": "CAST(floor(p_partkey / 5) % 5 AS INT)", "periodicity": "CAST(floor(p_partkey / 25) % 5 AS INT)", "common_mode": "CAST(floor(p_partkey / 125) % 5 AS INT)"}
_BAD = {"band": (7, "band_low_hz"), "periodicity": (11, "alpha=1.5;min_snr_db=3"), "dwell": (13, "dwell_s=5;min_cycles=2;alpha=0.1"), "common_mode": (17, "rejection=maybe;max_peak_m=0.1")}


def _lever_sql(name: str) -> str:
    n, bad = _BAD[name]
    return f"CASE WHEN p_size % {n} = 0 THEN '{bad}' ELSE [{', '.join(f"'{x}'" for x in _L[name])}][{_CHOICE[name]} + 1] END AS {name}"


def _policies(spark, d):
    def lever(name):
        n, bad = _BAD[name]
        return F.when(F.col("p_size") % n == 0, bad).otherwise(F.element_at(F.array(*[F.lit(x) for x in _L[name]]), F.expr(_CHOICE[name]) + 1)).alias(name)

    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[lever(k) for k in _L])


_FIELD = lambda t, f: f"TRY_CAST(regexp_extract({t}, '(^|;){f}=([^;]*)', 2) AS DOUBLE)"


@query(f"""
WITH p AS (SELECT p_partkey AS id, p_size, {", ".join(_lever_sql(k) for k in _L)} FROM part)
SELECT id, CASE WHEN p_size % 13 = 0 THEN 'unknown key' WHEN p_size % 7 = 0 THEN 'malformed entry' WHEN p_size % 11 = 0 THEN 'alpha must lie in (0, 1)' WHEN p_size % 17 = 0 THEN 'rejection must be on or off' END AS error,
  CASE WHEN p_size % 13 = 0 OR p_size % 7 = 0 THEN NULL ELSE {_FIELD("dwell", "dwell_s")} END AS dwell_s, CASE WHEN p_size % 13 = 0 OR p_size % 7 = 0 THEN NULL ELSE {_FIELD("band", "band_high_hz")} END AS band_high_hz,
  CASE WHEN p_size % 13 = 0 OR p_size % 7 = 0 OR p_size % 11 = 0 OR p_size % 17 = 0 THEN NULL ELSE {r("1 - " + _FIELD("periodicity", "alpha"))} END AS score_threshold FROM p""")
def detector_policies(spark: SparkSession, d: str) -> DataFrame:
    p = policy.resolve_detector(_policies(spark, d))
    return p.select("id", "error", "dwell_s", "band_high_hz", rounded(F.col("score_threshold")).alias("score_threshold"))


@query(f"""
WITH d AS (SELECT p_partkey % 7 AS suite, {r("p_retailprice / 2500")} AS p, (p_size % 10) / 10.0::DOUBLE AS n, p_size::DOUBLE AS c, p_partkey % 97 = 0 AS bad FROM part)
SELECT {r("avg(p)")} AS "primary", {r("avg(n)")} AS noop_rate, {r("avg(c)")} AS cost_per_win, bool_or(bad) AS regressed FROM d""")
def policy_suite(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(rounded(F.col("p_retailprice") / 2500).alias("primary"), ((F.col("p_size") % 10) / 10.0).alias("noop_rate"), F.col("p_size").cast("double").alias("cost_per_win"), (F.col("p_partkey") % 97 == 0).alias("regressed"))
    return policy.aggregate(rows).select(*[rounded(F.col(c)).alias(c) for c in ("primary", "noop_rate", "cost_per_win")], "regressed")


@query(f"""
WITH a AS (SELECT p_partkey AS id, radians((p_partkey % 360)::DOUBLE) AS a, radians((p_size * 3 - 75)::DOUBLE) AS b, radians((p_partkey % 91 - 45)::DOUBLE) AS g, 0.3::DOUBLE AS x, -0.8::DOUBLE AS y, 0.5::DOUBLE AS z FROM part),
y AS (SELECT *, cos(g) * x + sin(g) * z AS x1, y AS y1, -sin(g) * x + cos(g) * z AS z1 FROM a), p AS (SELECT *, x1 AS x2, cos(b) * y1 - sin(b) * z1 AS y2, sin(b) * y1 + cos(b) * z1 AS z2 FROM y)
SELECT id, {r("cos(a) * x2 - sin(a) * y2")} AS x, {r("sin(a) * x2 + cos(a) * y2")} AS y, {r("z2")} AS z, {r("sin(a) * cos(b)")} AS beam_x, {r("sqrt(greatest(0, 1 - 2 * f * (1 - f) * (1 - cos(2 * pi() * k / 64))))")} AS attenuation, {r("17500 + 3000 / 0.005 * (p_size / 10000.0::DOUBLE)")} AS freq
FROM p JOIN (SELECT p_partkey AS id, p_size, (p_partkey % 6) AS k, (p_size % 10) / 20.0::DOUBLE AS f FROM part) USING (id)""")
def device_frames(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    a, b, g = (k % 360).cast("double"), (s * 3 - 75).cast("double"), (k % 91 - 45).cast("double")
    v = G.device_to_world(G.vec(F.lit(0.3), F.lit(-0.8), F.lit(0.5)), a, b, g)
    out = {"x": F.col("v.x"), "y": F.col("v.y"), "z": F.col("v.z"), "beam_x": G.beam_direction(a, b, g)["x"], "attenuation": memory.harmonic_attenuation(k % 6, (s % 10) / 20.0), "freq": Wf.instantaneous_freq(F.lit(17500.0), F.lit(20500.0), F.lit(0.005), s / 10000.0)}
    return table(spark, d, "part").withColumn("v", v).select(k.alias("id"), *[rounded(x).alias(n) for n, x in out.items()])


@query(f"""
SELECT o_orderkey AS id, CASE WHEN n + 1 >= 0 AND n - 1 < 30 THEN CAST(greatest(0, n - 1) AS BIGINT) END AS first, CASE WHEN n + 1 >= 0 AND n - 1 < 30 THEN CAST(least(29, n + 1) AS BIGINT) END AS last FROM (SELECT o_orderkey, floor((o_totalprice / 100000 - 0.6) / 0.05 + 0.5) AS n FROM orders)""")
def bins_of_ranges(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = scoring.bins_covering(F.col("o_totalprice") / 100000, 0.6, 0.05, F.lit(30))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), lo.cast("long").alias("first"), hi.cast("long").alias("last"))
