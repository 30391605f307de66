"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a zoned timestamp, which watermarks need."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def rounded(c, places: int = 6):
    """Floats compared across engines are rounded in this way, never by SQL's round."""
    s = 10.0**places
    return F.floor(c * s + 0.5) / s
