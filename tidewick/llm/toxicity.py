"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a whole text: its distinct words, word pairs and pairs that skip one word, each hashed into
``DIM`` places (presence, not counts, so that long texts aren't worse by length). Training follows
FTRL-proximal with per-coordinate rates; the L1 term leaves most places at exactly 0, so that the model
is a short list of places and weights, which every task gets.

The model learns from the ``TRAIN_ROWS`` labelled rows with the smallest hash of doc_id (a documented
bound; all rows when there are fewer), never from held-out ones. Their features are written once, and
each epoch streams them to the driver partition by partition, so that no epoch holds all of them.

Defined cases: a null or empty text scores as the bias alone; null labels aren't learned from; a doc_id
that is null is in no fold and so is held out only if its remainder says so (null: false, and no label
joins it); repeated rows get equal scores; without any training row every score is 0.5; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mix, text_of, word_hashes, written

DIM_BITS = 20
TRAIN_ROWS = 12_000
EPOCHS = 5
FOLDS = 5


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: rates of each coordinate; l1, l2: penalties."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 15.0
    l2: float = 0.01


def features(text: str) -> np.ndarray:
    """Sorted distinct places of a text's words, pairs and skipping pairs."""
    w = word_hashes(text)
    with np.errstate(over="ignore"):
        parts = [w, mix(w[:-1] * np.uint64(3) + w[1:] * np.uint64(5)), mix(w[:-2] * np.uint64(7) + w[2:] * np.uint64(11))]
    return np.unique((np.concatenate(parts) >> np.uint64(64 - DIM_BITS)).astype(np.int32))


def train(rows: Callable[[], Iterable[tuple[np.ndarray, int]]], p: Ftrl = Ftrl(), epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places with a weight, their weights, and the bias (which has no penalty). ``rows`` starts an epoch's (places, label), always in the same order."""
    z, n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)
    zb = nb = 0.0
    rate = lambda n: (p.beta + np.sqrt(n)) / p.alpha
    for _ in range(epochs):
        for at, y in rows():
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= p.l1, 0.0, -(za - np.sign(za) * p.l1) / (rate(na) + p.l2))
            b = -zb / rate(nb)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y
            z[at] = za + g - (rate(na + g * g) - rate(na)) * w
            n[at] = na + g * g
            zb += g - (rate(nb + g * g) - rate(nb)) * b
            nb += g * g
    at = np.flatnonzero(np.abs(z) > p.l1)
    return at.astype(np.int32), -(z[at] - np.sign(z[at]) * p.l1) / (rate(n[at]) + p.l2), float(-zb / rate(nb))


def fold(docs: DataFrame):
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from labelled rows outside fold 0. A document with several labels counts as toxic if any says so."""
    truth = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = truth.where(fold(truth) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = written(chosen).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "toxic", "text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).tobytes() for t in text_of(b.column(2))], pa.binary())], names=["doc_id", "toxic", "places"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    # repeated rows of a document: one of them, the same in every run, is learned from
    rows = written(sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, places binary"))
    ordered = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("places", "toxic")
    return train(lambda: ((np.frombuffer(r.places, np.int32), r.toxic) for r in ordered.toLocalIterator()))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted, n_evidence (weighted places found) for each row."""
    at, weight, bias = model
    kept = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weight.astype(np.float32)))  # at most DIM places

    def run(batches):
        at, weight = kept.value
        dense = np.zeros(1 << DIM_BITS, np.float32)
        dense[at] = weight
        for b in batches:
            found = [dense[features(t)].astype(np.float64) for t in text_of(b.column(2))]
            s = np.array([1 / (1 + np.exp(-np.clip(f.sum() + bias, -30, 30))) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array(s >= 0.5).cast(pa.int32()), pa.array([int(np.count_nonzero(f)) for f in found], pa.int64())], names=["doc_id", "held_out", "score", "predicted", "n_evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(fold(docs) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_evidence long")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
