"""A store of room records in buckets, with versions: a batch rewrites the buckets it touches and no others.

Records lie in Parquet folders by a hash of their id. A manifest for each version says which folder holds each bucket; it is
written last, in one step that fails where that version is there already, so a writer that dies leaves the last version
whole, and of two writers one is refused. Folders of earlier versions stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory

RECORD = "id string, label string, vector array<double>, observations long"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    p, fs = _fs(spark, f"{folder}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """{version, buckets, folders: bucket -> folder, batch} of a version, the last one by default."""
    known = _versions(spark, folder)
    if not known or version is not None and version not in known:
        raise ValueError(f"no such version of the store: {version}")
    path = f"{folder}/manifest/{known[-1] if version is None else version}.json"
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def _commit(spark: SparkSession, folder: str, m: dict) -> None:
    """Write beside, then rename: a reader sees a whole manifest or none, and a version that exists is kept."""
    jvm = spark.sparkContext._jvm
    part, fs = _fs(spark, f"{folder}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(m, sort_keys=True).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/{m['version']}.json")
    if fs.exists(final) or not fs.rename(part, final):
        fs.delete(part, False)
        raise RuntimeError(f"version {m['version']} was written by another writer")


def create(spark: SparkSession, folder: str, buckets: int = 256) -> None:
    _commit(spark, folder, {"version": 0, "buckets": buckets, "folders": {}, "batch": None})


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _held(spark: SparkSession, m: dict, buckets: list[int] | None = None) -> DataFrame:
    folders = [f for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(RECORD).parquet(*folders) if folders else spark.createDataFrame([], RECORD)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    return _held(spark, manifest(spark, folder, version))


def _rewrite(spark: SparkSession, folder: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: int | None) -> int:
    """Change the buckets that ``keys`` (id) fall into; returns the new version. A batch that was written before isn't written again."""
    m = manifest(spark, folder)
    if batch is not None and m["batch"] is not None and batch <= m["batch"]:
        return m["version"]
    touched = sorted(r.b for r in keys.select(bucket_of(m["buckets"]).alias("b")).distinct().collect())  # at most one row for each bucket
    new, path = m["version"] + 1, f"{folder}/data/{m['version'] + 1}-{uuid.uuid4().hex}"
    rows = change(_held(spark, m, touched)).select("id", "label", F.col("vector").cast("array<double>").alias("vector"), F.col("observations").cast("long").alias("observations"))
    rows.withColumn("bucket", bucket_of(m["buckets"])).repartition("bucket").write.partitionBy("bucket").parquet(path)
    p, fs = _fs(spark, path)
    there = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}
    folders = {b: f for b, f in m["folders"].items() if int(b) not in touched} | {str(b): f"{path}/bucket={b}" for b in sorted(there)}
    _commit(spark, folder, m | {"version": new, "folders": folders, "batch": m["batch"] if batch is None else batch})
    return new


def remember(spark: SparkSession, folder: str, seen: DataFrame, batch: int | None = None) -> int:
    """Upsert seen rows (id, label, vector, at), as ``memory.remember`` says."""
    return _rewrite(spark, folder, seen, lambda held: memory.remember(held, seen), batch)


def forget(spark: SparkSession, folder: str, ids: DataFrame, batch: int | None = None) -> int:
    return _rewrite(spark, folder, ids, lambda held: memory.forget(held, ids), batch)


def sink(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is one version, once."""

    def run(batch: DataFrame, i: int) -> None:
        remember(batch.sparkSession, folder, batch, i)

    return run


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete folders that the last version doesn't name, and earlier manifests; returns how many folders went."""
    m, gone = manifest(spark, folder), 0
    kept = set(m["folders"].values())
    p, fs = _fs(spark, f"{folder}/data")
    for s in fs.listStatus(p) if fs.exists(p) else []:
        for b in fs.listStatus(s.getPath()):
            name = f"{folder}/data/{s.getPath().getName()}/{b.getPath().getName()}"
            if b.isDirectory() and name not in kept:
                fs.delete(b.getPath(), True)
                gone += 1
    for v in _versions(spark, folder)[:-1]:
        fs.delete(_fs(spark, f"{folder}/manifest/{v}.json")[0], False)
    return gone
