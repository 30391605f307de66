"""Recorded pings as JSON lines: reading with checks, writing, and events for the field endpoint.

The size of a line is tested before it is parsed. Every rule a line breaks is named in ``broken``; callers
fail or set such lines aside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.numbers import clamp01, finite, is_epoch, non_negative, round_up_half, valid_id

MOST_BYTES, MOST_LINES, MOST_BINS, MOST_DETECTIONS, MOST_RANGE_M = 262_144, 100_000, 4096, 64, 50.0
SCHEMA = "timestamp double, source string, device_id string, beam array<double>, start_range_m double, range_step_m double, profile array<double>, detections array<struct<range_m:double,snr_db:double,width_m:double>>, noise_floor double, blast_amplitude double, saturated boolean"


def broken_rules() -> Column:
    """Names of the rules that a parsed line breaks."""
    end = F.col("start_range_m") + F.col("range_step_m") * F.size("profile")
    length = F.sqrt(F.aggregate("beam", F.lit(0.0), lambda a, x: a + x * x))
    every = lambda c, f: F.coalesce(F.forall(c, f), F.lit(False))
    in_order = F.forall(F.sequence(F.lit(1), F.greatest(F.size("detections") - 1, F.lit(1))), lambda i: (F.size("detections") < 2) | (F.try_element_at("detections", i)["range_m"] <= F.try_element_at("detections", i + 1)["range_m"]))
    rules = {
        "timestamp": is_epoch(F.col("timestamp")),
        "source": F.col("source").isin("simulated", "device_capture"),
        "device_id": valid_id(F.col("device_id")),
        "beam": (F.size("beam") == 3) & every("beam", finite) & (length > 1e-6),
        "start_range_m": finite(F.col("start_range_m")) & (F.col("start_range_m") >= 0),
        "range_step_m": finite(F.col("range_step_m")) & (F.col("range_step_m") > 0),
        "profile": F.size("profile").between(1, MOST_BINS) & every("profile", lambda x: finite(x) & (x >= 0)),
        "span": end <= MOST_RANGE_M,
        "detections": (F.size("detections") <= MOST_DETECTIONS) & every("detections", lambda d: finite(d["range_m"]) & finite(d["snr_db"]) & finite(d["width_m"]) & (d["width_m"] >= 0)),
        "order": in_order,
        "inside": every("detections", lambda d: d["range_m"].between(F.col("start_range_m") - 1e-6, end + 1e-6)),
        "levels": finite(F.col("noise_floor")) & (F.col("noise_floor") >= 0) & finite(F.col("blast_amplitude")) & (F.col("blast_amplitude") >= 0),
        "saturated": F.col("saturated").isNotNull(),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines with ``broken``; lines over the size limit aren't parsed."""
    return parse(spark.read.text(path))


def parse(lines: DataFrame) -> DataFrame:
    short = lines.where(F.length(F.trim("value")) > 0).withColumn("bytes", F.octet_length("value"))
    j = short.select(F.col("bytes"), F.from_json(F.when(F.col("bytes") <= MOST_BYTES, F.col("value")), SCHEMA).alias("j")).select("bytes", "j.*")
    over = F.when(F.col("bytes") > MOST_BYTES, F.array(F.lit("bytes")))
    return j.withColumn("broken", F.coalesce(over, broken_rules())).drop("bytes")


def max_pool(values: Column, bins: int) -> Column:
    """At most ``bins`` maxima of consecutive stretches with floored edges, never below 0."""
    n = F.size(values)
    many = F.least(n, F.lit(bins))
    part = lambda i: F.slice(values, F.floor(i * n / many).cast("int") + 1, F.greatest(F.lit(1), (F.floor((i + 1) * n / many) - F.floor(i * n / many)).cast("int")))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.greatest(F.lit(0.0), F.array_max(part(i)).cast("double")))).otherwise(F.array().cast("array<double>"))


def encode(pings: DataFrame, bins: int = 256, low_m: float = 0.3, high_m: float = 5.0) -> DataFrame:
    """Lines from processed pings (with envelope, beam, timestamp, device_id, source).

    Each of the window's equal range bins takes the envelope's maximum in it; detections in the window are
    cut to the limit before they are sorted.
    """
    step = (high_m - low_m) / bins
    # names of their own: in a lambda a column of the select's own output would come first
    pings = pings.withColumnsRenamed({"start_range_m": "_start_m", "range_step_m": "_step_m"})
    first = lambda b: F.greatest(F.lit(0), F.least(F.size("envelope"), F.ceil((low_m + b * step - F.col("_start_m")) / F.col("_step_m")).cast("int")))
    held = lambda x: non_negative(x.cast("double"))
    pooled = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.array_max(F.transform(F.slice("envelope", first(b) + 1, F.greatest(F.lit(0), first(b + 1) - first(b))), held)), F.lit(0.0)))
    ok = F.filter("detections", lambda d: finite(d["range_m"]) & finite(d["snr_db"]) & d["range_m"].between(low_m, high_m))
    near = F.transform(F.slice(ok, 1, MOST_DETECTIONS), lambda d: F.struct(round_up_half(d["range_m"], 6).alias("range_m"), round_up_half(d["snr_db"], 4).alias("snr_db"), round_up_half(non_negative(d["width_m"]), 6).alias("width_m")))
    n = G.norm(F.col("beam"))
    unit = F.when(n > 0, F.array(*[round_up_half(F.col("beam")[a] / n, 7) for a in "xyz"])).otherwise(F.raise_error(F.lit("beam has no length")).cast("array<double>"))
    return pings.select("timestamp", "source", "device_id", unit.alias("beam"), round_up_half(F.lit(low_m), 6).alias("start_range_m"), round_up_half(F.lit(step), 9).alias("range_step_m"), F.transform(pooled, lambda x: round_up_half(x, 7)).alias("profile"), F.array_sort(near).alias("detections"), round_up_half(non_negative(F.col("noise_floor")), 9).alias("noise_floor"), round_up_half(non_negative(F.col("blast_amplitude")), 7).alias("blast_amplitude"), "saturated")


def to_lines(lines: DataFrame) -> DataFrame:
    """One JSON text for each line; one over the size limit or that breaks a rule is an error."""
    text = F.to_json(F.struct(*[c for c in lines.columns if c != "broken"]))
    bad = F.array_join(broken_rules(), ",")
    checked = lines.withColumn("_bad", bad).withColumn("value", text)
    good = F.when((F.col("_bad") == "") & (F.octet_length("value") <= MOST_BYTES), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("line breaks: "), F.col("_bad"))).cast("string"))
    return checked.select(good.alias("value"))


def write(lines: DataFrame, path: str) -> None:
    to_lines(lines).write.text(path)


def recording(lines: DataFrame) -> DataFrame:
    """Add ``accepted``: timestamps of a device must advance, and only its first MOST_LINES lines count."""
    w = Window.partitionBy("device_id").orderBy("seq")
    before = F.max("timestamp").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("accepted", (before.isNull() | (F.col("timestamp") > before)) & (F.row_number().over(w) <= MOST_LINES))


def byte_length(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bytes of lines with their line ends, of all or by the columns ``by``."""
    return lines.groupBy(*by or []).agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))


def field_events(lines: DataFrame, bins: int = 32) -> DataFrame:
    """Lines as events: pooled surface, a confidence from the strongest echo, a label, nanoseconds and an orientation."""
    peak = F.array_max(F.transform("detections", lambda d: d["snr_db"]))
    beam = G.vec(*(F.element_at("beam", i) for i in (1, 2, 3)))
    nearest = F.try_element_at("detections", F.lit(1))["range_m"]
    return lines.select(
        "seq",
        F.concat(F.col("device_id"), F.lit("-"), F.lpad(F.col("seq").cast("string"), 6, "0")).alias("event_id"),
        F.floor(F.col("timestamp") * 1e9).cast("long").alias("timestamp_ns"),
        max_pool(F.col("profile"), bins).alias("surface"),
        F.when(F.size("detections") > 0, clamp01(peak / 20)).otherwise(0.5).alias("confidence"),
        F.when(F.size("detections") > 0, "surface_echo").otherwise("clear_path").alias("label"),
        nearest.alias("nearest_m"),
        G.quaternion_to(beam).alias("orientation"),
        (F.col("source") == "simulated").alias("synthetic"),
    )


def retained(events: DataFrame, key: str, most: int = 64) -> DataFrame:
    """The last events of each key, oldest first."""
    w = Window.partitionBy(key).orderBy(F.col("seq").desc())
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n").orderBy(key, "seq")


MOST_EVENTS = 64


def body(events: DataFrame) -> DataFrame:
    """Retained events in the endpoint's envelope; more than MOST_EVENTS are an error."""
    if events.limit(MOST_EVENTS + 1).count() > MOST_EVENTS:
        raise ValueError(f"an envelope holds at most {MOST_EVENTS} events")
    return events.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.sort_array(F.collect_list(F.struct(*events.columns))).alias("events"))).alias("value"))


def ppi(echoes: DataFrame, now: Column, fade: int = 60) -> DataFrame:
    """What a plan view shows: echoes of the last pings with fading, strength and plan range."""
    age = now - F.col("ping")
    return echoes.withColumn("age", age).withColumn("plan_range", F.col("range_m") * F.cos("elevation")).where((F.col("age") <= fade) & (F.col("plan_range") > 0)).withColumn("fade", 1 - F.col("age") / fade).withColumn("strength", F.least(F.greatest(F.col("snr_db") / 30, F.lit(0.05)), F.lit(1.0)))


def bearing_bin(azimuth: Column, bins: int) -> Column:
    turn = 2 * math.pi
    return F.least(F.floor(F.pmod(azimuth, F.lit(turn)) / turn * bins), F.lit(bins - 1))
