"""Labelled dwells as JSON lines, made from the recordings, written, and read back with the line of every refusal.

Each row of ``embeddings`` becomes a record whose samples are its vector. Some rows get a fault, by their id; the SQL says which check each line fails
first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..sources import presence
from .registry import query, r
from .tables import rounded, table

EPOCH, PRF, PINGS, BINS = 1_700_000_000, 15.0, 4, 8
#: id modulo .. equals .. has the fault
FAULTS = {"cut": (41, 6), "field": (37, 1), "noise": (29, 7), "beam": (31, 2), "skew": (17, 3), "late": (19, 4), "device": (43, 9), "behind": (23, 5)}


def _has(fault: str):
    n, k = FAULTS[fault]
    return F.col("vec_id") % n == k


def records(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, value): a JSON line for each row."""
    i, e, lit = F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double")), F.lit
    start = EPOCH + i * 10 - F.when(_has("behind"), 30).otherwise(0)
    in_scene, on_beam = (i % 2 == 0) & ~_has("beam"), (i % 6 == 0) | _has("beam")
    blocks = {
        "consent": [F.concat(lit("r"), (i % 7).cast("string")), F.concat(lit("s"), F.col("label").cast("string")), lit(presence.SCOPE), lit(presence.PRIVACY), lit(EPOCH - 3600), lit(EPOCH + 80_000), lit("w")],
        "provenance": [lit(presence.TYPE), F.when(_has("device"), "other").otherwise("dev"), i, lit("simulated"), lit(True)],
        "clock": [start, (start - EPOCH) * 1_000_000_000 + F.when(_has("late"), 5_000_000_000).otherwise(100_000_000), lit(presence.DOMAIN), lit(float(EPOCH)), F.when(_has("skew"), 0.9).otherwise(0.01)],
        "measurement": [F.slice(e, 1, 3), lit("c"), lit(PRF), lit(0.018), lit(PINGS), lit(BINS), lit(0.5), lit(0.05), e, F.when(_has("noise"), -0.01).otherwise(0.01), lit(False)],
        "teacher": [lit("lidar_depth"), lit("l"), i, 0.5 + (i % 8) * 0.05, lit(2), lit(100), in_scene, on_beam, F.array(*[lit(float(k % 5 == 0)) for k in range(16)]), F.struct(lit(900.0), lit(900.0), lit(320.0), lit(240.0), lit(640), lit(480))],
    }
    types = dict(x.split(" ", 1) for x in presence._split(presence.SCHEMA))
    rows = table(spark, d, "embeddings").select(i, lit(presence.TYPE).alias("type"), *[F.struct(*v).cast(types[k]).alias(k) for k, v in blocks.items()])
    value = presence.encode(rows.select("*"), "vec_id")
    whole = F.when(_has("field"), F.regexp_replace("value", '"device_id"', '"colour":"red","device_id"')).otherwise(F.col("value"))
    return value.select("vec_id", F.when(_has("cut"), F.substring("value", 1, 200)).otherwise(whole).alias("value"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Write the lines in order of their ids, and read them as a corpus."""
    folder, n = scan.shared_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    records(spark, d).repartitionByRange(n, "vec_id").sortWithinPartitions("vec_id").select("value").write.text(folder)
    return presence.parse(presence.lines(spark, folder))


_f = {k: f"vec_id % {n} = {m}" for k, (n, m) in FAULTS.items()}
_CORPUS = f"""
f AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS line, {EPOCH} + vec_id * 10 - CASE WHEN {_f["behind"]} THEN 30 ELSE 0 END AS start, CASE WHEN {_f["cut"]} THEN NULL WHEN {_f["device"]} THEN 'other' ELSE 'dev' END AS device FROM embeddings),
m AS (SELECT *, max(start + {PINGS} / {PRF}) OVER (PARTITION BY device ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended, first_value(device) OVER (ORDER BY line) AS lead_device FROM f),
c AS (SELECT *, CASE WHEN {_f["cut"]} THEN 'parse' WHEN {_f["field"]} THEN 'unknown_field' WHEN {_f["noise"]} THEN 'invalid' WHEN {_f["beam"]} THEN 'invalid' WHEN {_f["skew"]} THEN 'clock_skew' WHEN {_f["late"]} THEN 'teacher_outside_dwell'
  WHEN start + {PINGS} / {PRF} > {EPOCH + 80_000} THEN 'consent_invalid' WHEN device <> lead_device THEN 'device_mismatch' WHEN start <= ended THEN 'non_monotonic' END AS error FROM m)"""


@query(f"WITH {_CORPUS} SELECT line, error FROM c")
def corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first check that each line fails, or null."""
    return corpus(spark, d).select("line", "error")


@query(f"""
WITH {_CORPUS} SELECT count(*) AS records, arg_min(error, line) FILTER (error IS NOT NULL) AS error, false AS accepted, min(line) FILTER (error IS NOT NULL) AS line FROM c""")
def corpus_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether the corpus is accepted, and the line that decides it."""
    return presence.verdict(corpus(spark, d))


@query(f"""
WITH {_CORPUS}
SELECT 'dev#' || vec_id AS dwell_id, vec_id AS sequence, CAST(start AS DOUBLE) AS start_s, {PINGS} AS pings, {BINS} AS bins, 2 * {PINGS * BINS} AS n_samples, vec_id % 6 = 0 AS body_in_scene, CASE WHEN vec_id % 6 = 0 THEN {r(f"0.5 + (vec_id % 8) * 0.05")} END AS body_range_m, {r("list_sum([x::DOUBLE FOR x IN embedding])", 4)} AS iq_sum FROM c WHERE error IS NULL""")
def corpus_captures(spark: SparkSession, d: str) -> DataFrame:
    """Accepted dwells without labels, rejoined with theirs for scoring."""
    good = corpus(spark, d).where("error is null")
    dwells = presence.dwells(good)
    joined = presence.captures(dwells, presence.labels(good)).join(dwells.select("device_id", "sequence", "start_s", F.aggregate("iq", F.lit(0.0), lambda a, x: a + x).alias("iq_sum")), ["device_id", "sequence"])
    return joined.select("dwell_id", "sequence", "start_s", "pings", "bins", F.col("n_samples").cast("int").alias("n_samples"), "body_in_scene", rounded(F.col("body_range_m")).alias("body_range_m"), rounded(F.col("iq_sum"), 4).alias("iq_sum"))
