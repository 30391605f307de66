"""Room signatures that don't change with heading, and a memory of rooms searched by similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Grid
from ..functions import geometry as G
from ..operators.occupancy import probability

AZIMUTHS, BANDS, HARMONICS, RADII = 64, 8, 6, 24
DIM = 2 * BANDS * HARMONICS + RADII + BANDS
VERSION = 2
MOST_RECORDS = 4096
SIMILAR, MARGIN = 0.9, 0.02


def spectrum(rows: DataFrame, key: list[str], position: str, value: str, n: int, harmonics: int) -> DataFrame:
    """(key, k, magnitude): the first Fourier magnitudes of a circular signal of n places, in which missing places are 0."""
    angle = -2 * math.pi * F.col("k") * F.col(position) / n
    parts = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(harmonics - 1))))
    sums = parts.groupBy(*key, "k").agg(F.sum(F.col(value) * F.cos(angle)).alias("a"), F.sum(F.col(value) * F.sin(angle)).alias("b"))
    return sums.select(*key, "k", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("magnitude"))


def signatures(grid_rows: DataFrame, grid: Grid = Grid(), min_range_m: float = 0.3, max_range_m: float = 6.0) -> DataFrame:
    """One row per session: a unit vector of DIM floats, occupied, known, mean_range_m, azimuth_support.

    Blocks: magnitudes of mass and of mean range around each of 8 elevation bands, a radial histogram, and
    the mean range of each band; each block has length 1 before the whole has.
    """
    s = "session_id"
    p = G.centre_of(F.col("voxel"), grid.extent_m, grid.voxel_m, grid.dim)
    v = grid_rows.select(s, "log_odds", p.alias("p")).withColumn("r", G.norm(F.col("p")))
    bin_of = lambda x, n: F.least(F.greatest(F.floor(x * n + 1e-9), F.lit(0)), F.lit(n - 1)).cast("int")
    occ = v.where((F.col("log_odds") >= grid.occupied) & F.col("r").between(min_range_m, max_range_m)).withColumn("m", probability(F.col("log_odds")))
    el = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("p.z") / F.col("r"))))
    occ = occ.withColumn("a", bin_of((F.atan2("p.x", "p.y") + math.pi) / (2 * math.pi), AZIMUTHS)).withColumn("e", bin_of((el + math.pi / 2) / math.pi, BANDS)).withColumn("q", bin_of((F.col("r") - min_range_m) / (max_range_m - min_range_m), RADII))
    cells = occ.groupBy(s, "e", "a").agg(F.sum("m").alias("mass"), F.sum(F.col("m") * F.col("r")).alias("mass_r"))
    band = Window.partitionBy(s, "e")
    cells = cells.withColumn("even", F.col("mass") / F.greatest(F.count(F.lit(1)).over(band), F.lit(1))).withColumn("mean_r", F.col("mass_r") / F.col("mass"))
    parts = []
    for block, (value, offset) in enumerate((("even", 0), ("mean_r", BANDS * HARMONICS))):
        x = spectrum(cells, [s, "e"], "a", value, AZIMUTHS, HARMONICS)
        parts.append(x.select(s, F.lit(block).alias("block"), (offset + F.col("e") * HARMONICS + F.col("k")).alias("i"), F.col("magnitude").alias("v")))
    parts.append(occ.groupBy(s, "q").agg(F.sum("m").alias("v")).select(s, F.lit(2).alias("block"), (2 * BANDS * HARMONICS + F.col("q")).alias("i"), "v"))
    parts.append(cells.groupBy(s, "e").agg((F.sum("mass_r") / F.sum("mass")).alias("v")).select(s, F.lit(3).alias("block"), (2 * BANDS * HARMONICS + RADII + F.col("e")).alias("i"), "v"))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(s, "block")))
    unit = every.withColumn("v", F.when(length > 1e-12, F.col("v") / length).otherwise(0.0))
    held = unit.groupBy(s).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    total = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    vectors = held.select(s, vector.alias("vector")).select(s, F.transform("vector", lambda x: F.when(total > 1e-12, x / total).otherwise(x).cast("float")).alias("vector"))
    facts = cells.groupBy(s).agg((F.sum("mass_r") / F.sum("mass")).alias("mean_range_m"), F.count_distinct("a").alias("azimuth_support"))
    counts = v.groupBy(s).agg(F.count_if(F.col("log_odds") >= grid.occupied).alias("occupied"), F.count_if(F.col("log_odds") != 0).alias("known"))
    return vectors.join(facts, s).join(counts, s).withColumn("version", F.lit(VERSION))


def harmonic_attenuation(k: Column, delta: Column, bins: int = AZIMUTHS) -> Column:
    """What is left of harmonic k where a heading falls ``delta`` of a bin beside a boundary."""
    return F.sqrt(F.greatest(F.lit(0.0), 1 - 2 * delta * (1 - delta) * (1 - F.cos(2 * math.pi * k / bins))))


def similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has no length, and an error where lengths differ."""
    products = F.zip_with(a, b, lambda x, y: F.struct((x * y).cast("double").alias("d"), (x * x).cast("double").alias("p"), (y * y).cast("double").alias("q")))
    sums = F.aggregate(products, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")), lambda s, x: F.struct((s["d"] + x["d"]).alias("d"), (s["p"] + x["p"]).alias("p"), (s["q"] + x["q"]).alias("q")))
    size = F.sqrt(sums["p"]) * F.sqrt(sums["q"])
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(F.when(size > 1e-12, sums["d"] / size).otherwise(0.0))


#: queries in a block, and values that a block of queries holds at most
QUERY_BLOCK, BLOCK_VALUES = 2048, 1 << 22


#: similarities that are held at once
_SCORES = 1 << 20


def _unit(column: pa.Array) -> np.ndarray:
    """Lists as rows of length 1 (0 stays 0); ValueError where lengths differ."""
    if len(pa.compute.list_value_length(column).unique()) > 1:
        raise ValueError("vectors differ in length")
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(size > 1e-12, m / np.where(size > 1e-12, size, 1), 0.0)


def _nearest(q: np.ndarray, v: np.ndarray, by_id: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, row of v, similarity) of the ``most`` best for each row of q, best first and ties by ``by_id``, for a few rows of q at a time.

    Only what is no worse than the last that counts is sorted.
    """
    few = max(1, _SCORES // max(1, len(v)))
    for lo in range(0, len(q), few):
        away = -(q[lo : lo + few] @ v.T)
        if most < len(v):
            row, at = np.nonzero(~(away > np.partition(away, most - 1, axis=1)[:, most - 1 : most]))
        else:
            row, at = (x.ravel() for x in np.indices(away.shape))
        order = np.lexsort((by_id[at], away[row, at], row))
        row, at = row[order], at[order]
        first = np.searchsorted(row, np.arange(len(away)))
        best = np.arange(len(row)) - first[row] < most
        row, at = row[best], at[best]
        yield row + lo, at, -away[row, at]


def recall(queries: DataFrame, store: DataFrame, top_k: int = 5, floor: float = SIMILAR) -> DataFrame:
    """(query_id, id, similarity, rank, margin): the best records above the floor; the margin is to the next in rank even below it, infinite for the last.

    A stated set of queries against all records. Queries are dealt into blocks, each of which meets each
    part of the store once, in a matrix product; a part returns its best for each query, and those are
    ranked. A block of queries takes at most 32 MB wherever it is held, and a task holds _SCORES similarities at once.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if not size.n:
        return store.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"), F.lit(0.0).alias("margin")).where("false")
    many = max(1, -(-size.n // max(1, min(QUERY_BLOCK, BLOCK_VALUES // max(1, size.dim)))))
    blocks = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q"), F.pmod(F.xxhash64("id"), F.lit(many)).alias("block"))
    kind_q, kind = queries.schema["id"].dataType.simpleString(), store.schema["id"].dataType.simpleString()
    best = None
    for n in range(many):
        held = store.sparkSession.sparkContext.broadcast(pa.Table.from_batches(blocks.where(F.col("block") == n).select("query_id", "q").toArrow().to_batches()))  # of a checked size

        def run(batches, held=held):
            t = held.value.combine_chunks()
            if not t.num_rows:
                return
            names, q = t.column("query_id").combine_chunks(), _unit(t.column("q").combine_chunks())
            for b in batches:
                if not b.num_rows:
                    continue
                v = _unit(b.column(1))
                if v.shape[1] != q.shape[1]:
                    raise ValueError("vectors differ in length")
                ids = b.column(0)
                by_id = np.empty(b.num_rows, np.int64)
                by_id[pa.compute.sort_indices(ids).to_numpy()] = np.arange(b.num_rows)
                # ties go by id, as the ranking after all parts does
                for row, at, s in _nearest(q, v, by_id, top_k + 1):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), ids.take(pa.array(at)), pa.array(s)], names=["query_id", "id", "similarity"])

        part = store.select("id", "vector").mapInArrow(run, f"query_id {kind_q}, id {kind}, similarity double")
        best = part if best is None else best.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    ranked = best.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.coalesce(F.col("similarity") - F.lead("similarity").over(w), F.lit(float("inf"))))
    return ranked.where((F.col("rank") <= top_k) & (F.col("similarity") >= floor))


def recognize(queries: DataFrame, store: DataFrame, floor: float = SIMILAR, margin: float = MARGIN) -> DataFrame:
    return recall(queries, store, 1, floor).where(F.col("margin") >= margin)


def valid_record() -> Column:
    """Whether a record (id, label, vector) may be stored."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.length(F.trim("id")).between(1, 256) & (F.coalesce(F.length("label"), F.lit(0)) <= 256) & (F.size("vector") == DIM) & good


def remember(store: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert: seen rows (id, label, vector, at) replace a record's vector, keep its label where they have none, and count as observations."""
    old = store.select("id", "label", "vector", "observations", F.lit(-1).cast("long").alias("at"))
    new = seen.select("id", "label", "vector", F.lit(1).cast("long").alias("observations"), F.col("at").cast("long"))
    every = old.unionByName(new)
    label = F.max_by("label", F.when(F.col("label").isNotNull(), F.col("at")))
    out = every.groupBy("id").agg(label.alias("label"), F.max_by("vector", "at").alias("vector"), F.sum("observations").alias("observations"))
    return out


def forget(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti")


def load(texts: DataFrame) -> DataFrame:
    """Stores from JSON text, checked: version, dimension, number of records, every record; anything wrong is an error."""
    schema = "version int, dim int, records array<struct<id:string,label:string,vector:array<double>,observations:bigint>>"
    j = texts.select(F.from_json("value", schema).alias("s"))
    ok = (F.col("s.version") == VERSION) & (F.col("s.dim") == DIM) & (F.size("s.records") <= MOST_RECORDS)
    rows = j.select(F.when(ok, F.col("s.records")).otherwise(F.raise_error(F.lit("not a room store of this version")).cast("array<struct<id:string,label:string,vector:array<double>,observations:bigint>>")).alias("r"))
    flat = rows.select(F.explode("r").alias("x")).select("x.*")
    return flat.withColumn("id", F.when(valid_record(), F.col("id")).otherwise(F.raise_error(F.lit("damaged room record")).cast("string")))


def dump(store: DataFrame) -> DataFrame:
    """The store as one JSON text; it has at most MOST_RECORDS records, more are an error."""
    r = F.sort_array(F.collect_list(F.struct("id", "label", F.transform("vector", lambda x: x.cast("double")).alias("vector"), "observations")))
    if store.limit(MOST_RECORDS + 1).count() > MOST_RECORDS:
        raise ValueError(f"a store has at most {MOST_RECORDS} records")
    return store.agg(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(DIM).alias("dim"), r.alias("records"))).alias("value"))


def field_embeddings(signatures: DataFrame, source_event_id: Column) -> DataFrame:
    """Signatures as embeddings for the field endpoint: modality, vector, privacy class, source event.

    The privacy class is the ceiling for room signatures, whatever the caller holds. A signature of another
    version, of another length or with values that aren't finite is an error, and so is a bad event id.
    """
    good = (F.col("version") == VERSION) & (F.size("vector") == DIM) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    refuse = lambda why, kind: F.raise_error(F.lit(why)).cast(kind)
    event = F.when(F.coalesce(F.length(F.trim(source_event_id)).between(1, 256), F.lit(False)), source_event_id).otherwise(refuse("bad event id", "string"))
    vector = F.when(F.coalesce(good, F.lit(False)), F.col("vector")).otherwise(refuse("not a signature of this version", signatures.schema["vector"].dataType))
    return signatures.select(F.lit("ultrasonic").alias("modality"), vector.alias("vector"), F.lit("P3").alias("privacy_class"), event.alias("source_event_id"))
