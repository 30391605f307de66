"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PATHS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent (tests, single machine) is a temporary folder used; other clusters
    than a local session are refused then. The folder is removed when the driver's Python ends.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewick-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tidewick-{uuid.uuid4().hex}"
    if not _PATHS:
        atexit.register(_clean)
    _PATHS.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _PATHS:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone, and the folder with it
            pass


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read back.

    Unlike cached blocks, the files survive the loss of any executor.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no plan refers to any more; it goes by the collected garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_key(*cols: str) -> Column:
    """A 64-bit key from a row's content: rows with equal content are interchangeable, so no row number is needed."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in cols])


def join_hot(rows: DataFrame, facts: DataFrame, on: str, weight: str, total: int, most: int = 50_000) -> DataFrame:
    """Left join of rows with facts, of which there is one for each value of ``on``, and which say in ``weight`` how many rows have it.

    Values that more than a ``most``-th of all rows have, of which there are fewer than ``most``, are
    broadcast, so that their rows aren't brought together; the others are joined by a shuffle.
    """
    limit = max(1000, total // most)
    here = free_name(facts, "is_hot")
    hot = F.broadcast(facts.where(F.col(weight) > limit).withColumn(here, F.lit(True)))
    marked = rows.join(hot, on, "left")
    rest = marked.where(F.col(here).isNull()).select(*rows.columns).join(facts.where(F.col(weight) <= limit), on, "left")
    return marked.where(F.col(here)).drop(here).unionByName(rest)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have yet, compared without case as Spark does."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that follow from the seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = odd_numbers(256, 11)
_PLACE = odd_numbers(1 << 12, 12)
_STEP = odd_numbers(64, 13)
#: the products of both for the first places, a row of 256 for each
with np.errstate(over="ignore"):
    _BOTH = (_PLACE[:64, None] * _BYTE[None, :]).ravel()
#: ASCII letters and digits, and every byte of a character beyond ASCII, belong to words.
_WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a whole text, in order.

    A word is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII of the
    lower-cased text. No loop over words: bytes are hashed by their place and summed by word.
    """
    return word_hashes_of([text])[0]


def word_hashes_of(texts: list[str]) -> list[np.ndarray]:
    """``word_hashes`` of each text, in one go over all bytes."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b" ".join(coded), np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    np.take(_WORD, b, out=inside[1:-1], mode="clip")
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edge):
        return [np.empty(0, np.uint64) for _ in texts]
    ends = np.searchsorted(edge[::2], np.cumsum([len(x) + 1 for x in coded]))
    b = b[edge[0] : edge[-1]]
    # stretches: words and, between them, what belongs to none
    edge -= edge[0]
    lengths = np.diff(edge)
    place = np.arange(len(b))
    place -= np.repeat(edge[:-1], lengths)
    with np.errstate(over="ignore"):
        if lengths[::2].max() <= len(_BOTH) >> 8:
            place <<= 8
            place += b
            h = _BOTH.take(place, mode="clip")
        else:
            h = _BYTE[b] * _PLACE[place & 0xFFF]
        h = mix(np.add.reduceat(h, edge[:-1])[::2] + lengths[::2].astype(np.uint64))
    return [h[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words; a shorter text is one shingle; no words, none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += words[j : j + n] * _STEP[j]
    return mix(h + np.uint64(k))
