"""Exact length histogram: what any context limit costs, from one aggregation.

Documents are counted by encoded length, with partial sums on the map side. Suffix sums over the
histogram then answer, for a limit L, how many documents reach it, their tokens, and the tokens left
after truncation to L. The suffix sums are taken in two levels (blocks of lengths, then within a
block), so that no task gets all lengths.

Defined cases: null and empty texts have length 0; repeated rows count each; an empty table gives an
empty histogram; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import text_of, written
from .tokens import BYTE_BPE, encoder

BLOCK = 512


def lengths(docs: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """The encoded length of each row's whole text."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(enc.encode_ordinary(t)) for t in text_of(b.column(0))], pa.int64())], names=["length"])

    return docs.select("text").mapInArrow(run, "length long")


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each occurring length: documents and tokens at and above it, total tokens if cut to it, and the share of documents below."""
    hist = written(hist).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("length")).alias("bt"))
    # one row for each block of lengths: as many as the longest text has blocks
    w = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = blocks.select(F.col("block").alias("b"), F.coalesce(F.sum("bd").over(w), F.lit(0)).alias("above_d"), F.coalesce(F.sum("bt").over(w), F.lit(0)).alias("above_t"))
    total = blocks.agg(F.sum("bd").alias("all_d"), F.sum("bt").alias("all_t"))
    inner = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.join(over, F.col("block") == F.col("b")).join(F.broadcast(total))
    docs = F.sum("n_docs").over(inner) + F.col("above_d")
    tokens = F.sum(F.col("n_docs") * F.col("length")).over(inner) + F.col("above_t")
    rows = rows.select("length", "n_docs", docs.alias("docs_from"), tokens.alias("tokens_from"), "all_d", "all_t")
    return rows.select("length", "n_docs", "docs_from", "tokens_from", (F.col("all_t") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"), ((F.col("all_d") - F.col("docs_from") + F.col("n_docs")) / F.col("all_d")).alias("quantile"), F.col("all_d").alias("total_docs"), F.col("all_t").alias("total_tokens"))


def context_report(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each stated limit: documents beyond it, and tokens kept and lost when cut to it."""
    spark = sums.sparkSession
    asked = F.broadcast(spark.createDataFrame([(x,) for x in limits], "context_limit long"))  # the stated limits only
    above = F.col("length") > F.col("context_limit")
    part = sums.join(asked).groupBy("context_limit").agg(F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"), F.coalesce(F.sum(F.when(above, F.col("n_docs"))), F.lit(0)).alias("docs_cut"), F.coalesce(F.sum(F.when(above, F.col("n_docs") * (F.col("length") - F.col("context_limit")))), F.lit(0)).alias("tokens_lost"))
    return part.withColumn("tokens_kept", F.col("total_tokens") - F.col("tokens_lost"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def byte_length_sums(spark, sf_dir: str) -> DataFrame:
    """The same sums over lengths in bytes, which SQL can say too."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    return suffix_sums(histogram(rows)).withColumn("quantile", F.floor(F.col("quantile") * 1e6 + 0.5) / 1e6)
