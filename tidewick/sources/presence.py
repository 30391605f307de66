"""Labelled dwells as JSON lines. Any bad line refuses the whole file; the first failing check names the error.

Labels leave the measurement at once: ``dwells`` has no label column, ``labels`` nothing else, and only
scoring joins them again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import finite, is_epoch, is_index, significant, valid_id
from ..operators import scan
from ..operators.policy import same_keys

MOST_BYTES, MOST_RECORDS, MOST_PINGS, MOST_BINS, MOST_SAMPLES, MOST_RANGE_M, MOST_SKEW_S = 64 << 20, 4096, 4096, 1280, 262_144, 50.0, 1.0
CONSENT_WINDOW_S, MOST_TEACHER_SAMPLES = 86_400.0, 4_194_304
TYPE, SCOPE, PRIVACY, DOMAIN = "presence_pair", "presence_corpus", "P4", "arkit_uptime"
BLOCKS = {
    "consent": "receipt_id string, subject_ref string, scope string, privacy_max string, granted_unix_s double, expires_unix_s double, withdrawal_ref string",
    "provenance": "schema string, device_id string, sequence long, source string, synthetic boolean",
    "clock": "ultrasonic_unix_s double, lidar_timestamp_ns long, lidar_domain string, offset_s double, skew_s double",
    "measurement": "beam array<double>, calibration_id string, prf_hz double, lambda_m double, pings int, bins int, start_range_m double, range_step_m double, iq array<double>, noise_floor double, saturated boolean",
    "teacher": "frame_type string, sensor string, sequence long, range_m double, range_confidence int, sample_count int, body_in_scene boolean, body_on_beam boolean, pose array<double>, intrinsics struct<fx:double,fy:double,cx:double,cy:double,image_width:int,image_height:int>",
}


def _split(fields: str) -> list[str]:
    """Top-level comma-separated fields of a schema text."""
    out, depth, now = [], 0, ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


SCHEMA = "type string, " + ", ".join(f"{k} struct<{','.join(x.replace(' ', ':', 1) for x in _split(v))}>" for k, v in BLOCKS.items())


def first_error() -> Column:
    """The code of the first check a parsed record fails, or null."""
    c = F.col
    m, t, k, p, s = "measurement", "teacher", "clock", "provenance", "consent"
    end = c(f"{m}.start_range_m") + c(f"{m}.range_step_m") * c(f"{m}.bins")
    skew = F.least(F.try_divide(F.lit(1.0), c(f"{m}.prf_hz")), F.lit(MOST_SKEW_S))
    start_s, stop_s = c(f"{k}.ultrasonic_unix_s"), c(f"{k}.ultrasonic_unix_s") + F.try_divide(c(f"{m}.pings"), c(f"{m}.prf_hz"))
    lidar = c(f"{k}.lidar_timestamp_ns") / 1e9 + c(f"{k}.offset_s")
    beam = F.sqrt(F.aggregate(f"{m}.beam", F.lit(0.0), lambda a, x: a + x * x))
    every = lambda x, f=finite: F.coalesce(F.forall(x, f), F.lit(False))
    pose = c(f"{t}.pose")
    checks = [
        ("schema_mismatch", c("type") == TYPE),
        ("schema_mismatch", c(f"{p}.schema") == c("type")),
        ("invalid", valid_id(c(f"{p}.device_id")) & is_index(c(f"{p}.sequence")) & c(f"{p}.source").isin("simulated", "device_capture") & c(f"{p}.synthetic").isNotNull()),
        ("synthetic_mismatch", c(f"{p}.synthetic") == (c(f"{p}.source") == "simulated")),
        ("consent_invalid", valid_id(c(f"{s}.receipt_id")) & valid_id(c(f"{s}.subject_ref")) & valid_id(c(f"{s}.withdrawal_ref"))),
        ("consent_invalid", (c(f"{s}.scope") == SCOPE) & (c(f"{s}.privacy_max") == PRIVACY)),
        ("consent_invalid", is_epoch(c(f"{s}.granted_unix_s")) & is_epoch(c(f"{s}.expires_unix_s")) & (c(f"{s}.expires_unix_s") > c(f"{s}.granted_unix_s"))),
        ("consent_invalid", c(f"{s}.expires_unix_s") - c(f"{s}.granted_unix_s") <= CONSENT_WINDOW_S),
        ("invalid", valid_id(c(f"{m}.calibration_id")) & (F.size(f"{m}.beam") == 3) & every(f"{m}.beam") & (beam >= 1e-6)),
        ("invalid", finite(c(f"{m}.prf_hz")) & c(f"{m}.prf_hz").between(1, 200) & finite(c(f"{m}.lambda_m")) & (c(f"{m}.lambda_m") > 0) & (c(f"{m}.lambda_m") <= 1)),
        ("invalid", c(f"{m}.pings").between(1, MOST_PINGS) & c(f"{m}.bins").between(1, MOST_BINS) & (c(f"{m}.pings") * c(f"{m}.bins") <= MOST_SAMPLES)),
        ("invalid", finite(c(f"{m}.start_range_m")) & (c(f"{m}.start_range_m") >= 0) & finite(c(f"{m}.range_step_m")) & (c(f"{m}.range_step_m") > 0) & (end <= MOST_RANGE_M)),
        ("invalid", (F.size(f"{m}.iq") == 2 * c(f"{m}.pings") * c(f"{m}.bins")) & every(f"{m}.iq")),
        ("invalid", finite(c(f"{m}.noise_floor")) & (c(f"{m}.noise_floor") >= 0) & c(f"{m}.saturated").isNotNull()),
        ("schema_mismatch", c(f"{t}.frame_type") == "lidar_depth"),
        ("invalid", valid_id(c(f"{t}.sensor")) & is_index(c(f"{t}.sequence")) & finite(c(f"{t}.range_m")) & (c(f"{t}.range_m") > 0) & c(f"{t}.range_m").between(c(f"{m}.start_range_m") - 1e-6, end + 1e-6)),
        ("invalid", c(f"{t}.range_confidence").between(0, 2) & c(f"{t}.sample_count").between(1, MOST_TEACHER_SAMPLES) & c(f"{t}.body_in_scene").isNotNull()),
        ("invalid", ~(F.coalesce(c(f"{t}.body_on_beam"), F.lit(False)) & ~c(f"{t}.body_in_scene"))),
        ("invalid", (F.size(pose) == 16) & every(pose) & (F.abs(F.try_element_at(pose, F.lit(4))) <= 1e-3) & (F.abs(F.try_element_at(pose, F.lit(8))) <= 1e-3) & (F.abs(F.try_element_at(pose, F.lit(12))) <= 1e-3) & (F.abs(F.try_element_at(pose, F.lit(16)) - 1) <= 1e-3)),
        ("invalid", (c(f"{t}.intrinsics.fx") > 0) & (c(f"{t}.intrinsics.fy") > 0) & finite(c(f"{t}.intrinsics.cx")) & finite(c(f"{t}.intrinsics.cy")) & (c(f"{t}.intrinsics.image_width") >= 1) & (c(f"{t}.intrinsics.image_height") >= 1)),
        ("invalid", is_epoch(c(f"{k}.ultrasonic_unix_s")) & is_index(c(f"{k}.lidar_timestamp_ns")) & (c(f"{k}.lidar_domain") == DOMAIN) & finite(c(f"{k}.offset_s")) & finite(c(f"{k}.skew_s")) & (c(f"{k}.skew_s") >= 0) & is_epoch(lidar)),
        ("clock_skew", c(f"{k}.skew_s") <= skew),
        ("teacher_outside_dwell", lidar.between(start_s - skew, stop_s + skew)),
        ("consent_invalid", (start_s >= c(f"{s}.granted_unix_s")) & (stop_s <= c(f"{s}.expires_unix_s"))),
    ]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks])


def parse(lines: DataFrame, expected_source: str | None = None) -> DataFrame:
    """Rows with line, record blocks and ``error``. lines: (line long, value string).

    Sizes are tested before parsing, block keys exactly, then the ordered checks, then what concerns
    neighbours: a single device, and dwells that don't overlap.
    """
    kept = lines.where(F.length(F.trim("value")) > 0)
    size = F.octet_length("value")
    raw = kept.withColumn("over", size > MOST_BYTES).withColumn("text", F.when(size <= MOST_BYTES, F.col("value")))
    keys = lambda path: F.coalesce(F.json_object_keys(F.get_json_object("text", path)), F.array().cast("array<string>"))
    names = lambda fields: [re.split("[ :]", x, maxsplit=1)[0] for x in _split(fields)]
    consent = F.size(F.array_except(F.array(*[F.lit(x) for x in names(BLOCKS["consent"])]), keys("$.consent"))) == 0
    lens = BLOCKS["teacher"].rpartition("intrinsics struct<")[2].removesuffix(">")
    exact = same_keys(F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>")), ["type", *BLOCKS]) & same_keys(keys("$.teacher.intrinsics"), names(lens))
    for block, fields in BLOCKS.items():
        exact = exact & same_keys(keys(f"$.{block}"), names(fields))
    j = raw.withColumn("j", F.from_json("text", SCHEMA)).withColumn("shape", F.when(F.col("over"), "line_too_long").when(F.col("j").isNull() | F.json_object_keys("text").isNull(), "parse").when(~consent, "consent_missing").when(~exact, "unknown_field"))
    rows = j.select("line", "shape", "j.*")
    rows = rows.withColumn("error", F.coalesce("shape", first_error()))
    if expected_source is not None:
        rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("provenance.source") != expected_source, "source_mismatch")))
    device = F.trim("provenance.device_id")
    one = rows.agg(F.min_by(device, "line").alias("_first"))
    rows = rows.join(F.broadcast(one)).withColumn("error", F.coalesce("error", F.when(device != F.col("_first"), "device_mismatch"))).drop("_first")
    return _in_order(rows).drop("shape")


def _in_order(rows: DataFrame) -> DataFrame:
    """Refuse a dwell that begins before all earlier ones of its device have ended. A corpus has one device, so the running maximum goes over ranges of lines."""
    end = F.col("clock.ultrasonic_unix_s") + F.try_divide(F.col("measurement.pings"), F.col("measurement.prf_hz"))
    narrow = rows.select("line", F.col("provenance.device_id").alias("device"), F.col("clock.ultrasonic_unix_s").alias("start"), end.alias("stop"))
    dealt = scan.dealt(narrow, ["device"], [F.col("line")])
    ran = scan.running(dealt, ["device"], [F.col("line")], {"ended": F.col("stop")}, F.max, before=True)
    behind = ran.where("device is not null and start <= ended").select("line", F.lit("non_monotonic").alias("_late"))
    return rows.join(behind, "line", "left").withColumn("error", F.coalesce("error", "_late")).drop("_late")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): a file's physical lines with their numbers from 1; the files of a folder follow one another by name.

    Files are read in byte ranges by many tasks. Each range's lines are counted, and a range's lines go on from the sum of the
    counts before it: one row for each range, not for each line.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"))
    ranges = text.groupBy("_file", "_from").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranges.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    return text.join(placed, ["_file", "_from"]).select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def verdict(rows: DataFrame) -> DataFrame:
    """One row: whether the file is accepted, its records, and the first error in line order with its line."""
    wrong = F.when(F.col("error").isNotNull(), F.col("line"))
    one = rows.agg(F.count(F.lit(1)).alias("records"), F.min_by("error", wrong).alias("error"), F.min(wrong).alias("line"))
    error = F.coalesce("error", F.when(F.col("records") > MOST_RECORDS, "too_many_records"), F.when(F.col("records") == 0, "empty"))
    return one.select("records", error.alias("error"), error.isNull().alias("accepted"), "line")


def read(spark: SparkSession, path: str, expected_source: str | None = None) -> DataFrame:
    """The records of a file that has no error at all; else an error that names the first wrong line."""
    rows = parse(lines(spark, path), expected_source)
    v = verdict(rows).first()
    if not v.accepted:
        raise ValueError(f"corpus refused: {v.error}" + (f" at line {v.line}" if v.line else ""))
    return rows


def dwells(rows: DataFrame) -> DataFrame:
    """Measurements without any label column; the beam has length 1 and the clock is epoch seconds."""
    n = F.sqrt(F.aggregate("measurement.beam", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select(F.col("provenance.device_id").alias("device_id"), F.col("provenance.sequence").alias("sequence"), F.transform("measurement.beam", lambda x: x / n).alias("beam"), F.col("clock.ultrasonic_unix_s").alias("start_s"), *[F.col(f"measurement.{c}").alias(c) for c in ("prf_hz", "lambda_m", "pings", "bins", "start_range_m", "range_step_m", "iq", "noise_floor", "saturated")])


def labels(rows: DataFrame) -> DataFrame:
    """The labels alone, keyed as the dwells are: for scoring only."""
    return rows.select(F.col("provenance.device_id").alias("device_id"), F.col("provenance.sequence").alias("sequence"), F.col("teacher.body_in_scene").alias("body_in_scene"), F.col("teacher.body_on_beam").alias("body_on_beam"), F.col("teacher.range_m").alias("range_m"), (F.col("clock.lidar_timestamp_ns") / 1e9 + F.col("clock.offset_s")).alias("frame_s"))


def captures(dwell_rows: DataFrame, label_rows: DataFrame) -> DataFrame:
    """Dwells rejoined with their labels; a body counts only on the beam."""
    j = dwell_rows.join(label_rows, ["device_id", "sequence"])
    return j.select("device_id", "sequence", F.concat_ws("#", "device_id", F.col("sequence").cast("string")).alias("dwell_id"), "pings", "bins", "prf_hz", "lambda_m", F.size("iq").alias("n_samples"), "noise_floor", F.coalesce("body_on_beam", F.lit(False)).alias("body_in_scene"), F.when(F.coalesce("body_on_beam", F.lit(False)), F.col("range_m")).alias("body_range_m"), F.lit(True).alias("consent"))


def long_dwells(dwell_rows: DataFrame) -> DataFrame:
    """(dwell_id, ping, bin, re, im) from interleaved, ping-major samples."""
    d = dwell_rows.select(F.concat_ws("#", "device_id", F.col("sequence").cast("string")).alias("dwell_id"), "bins", F.posexplode("iq").alias("i", "v"))
    at = F.floor(F.col("i") / 2)
    pairs = d.groupBy("dwell_id", at.alias("at"), "bins").agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).alias("re"), F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).alias("im"))
    return pairs.select("dwell_id", F.floor(F.col("at") / F.col("bins")).cast("int").alias("ping"), (F.col("at") % F.col("bins")).cast("int").alias("bin"), "re", "im")


def encode(rows: DataFrame, *keep: str) -> DataFrame:
    """Records back to lines, beside the columns to keep; samples keep 7 significant digits."""
    iq = F.transform("measurement.iq", lambda x: significant(x, 7))
    return rows.select(*keep, F.to_json(F.struct("type", "consent", "provenance", "clock", F.col("measurement").withField("iq", iq).alias("measurement"), "teacher"), {"ignoreNullFields": "false"}).alias("value"))
