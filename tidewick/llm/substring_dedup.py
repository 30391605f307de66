"""Exact substring deduplication over a sparse suffix array.

A byte goes if a ``SPAN``-byte string that covers it also starts anywhere else. Texts that occur more than
once go whole (a count by text finds them), and one of each stands in for the copies from there on. Sorting
every suffix of the rest would write many times the input, so suffixes are chosen by content first, without
losing a match: of every window of SPAN bytes, the leftmost of its smallest ``GRAM``-byte grams (by hash) is
its anchor, so that equal windows have anchors at equal places. All windows of one anchor form a run.

Anchors are the suffixes of the array: sampled splitters range-partition them by their leading bytes, the
gram. Each bucket is sorted locally by multikey quicksort on the gram's bytes, eight at a time, then on
the digest of the run's whole context, and neighbours are compared, also across the boundaries of buckets.
An anchor whose gram no other has is done; one whose whole context another has goes with all its windows.

The rest lie where copied passages begin and end. Only they bring their bytes along: they are partitioned
by gram again, and a bucket compares all their windows, byte by byte where their hashes are equal. A gram
with more than ``HOT_ROWS`` anchors is cut by a salt in the range key; what its buckets know of its windows
is compared by an aggregation over digests.

Equality is that of bytes for texts, grams and windows within a bucket, and that of 128-bit BLAKE2b digests
for contexts and for windows of hot grams, which would have to travel whole otherwise.

Defined cases: null and empty texts have no bytes and nothing removed; texts shorter than SPAN lose
nothing; repeated rows are copies of each other (whole texts of SPAN bytes or more go); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_hot, mix, odd_numbers, partitions, written

SPAN = 200
GRAM = 32
#: bytes of a text that are handled at once; stretches overlap by SPAN
STRETCH = 1 << 19
#: rows whose windows are compared at once
ROWS_AT_ONCE = 4000
#: a gram with more anchors than this, or than a MOST_HOTth of all, is dealt to several buckets; there are at most MOST_HOT
HOT_ROWS, MOST_HOT = 10_000, 100_000
GRAMS = ["g0", "g1", "g2", "g3"]
CONTEXT = ["c0", "c1"]

_VALUE = odd_numbers(256, 31)
_BASE = int(odd_numbers(1, 32)[0])


class Hashes:
    """Polynomial hashes mod 2^64 of any stretch of a byte array, in constant time each."""

    powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, b: np.ndarray):
        n = len(b)
        if Hashes.powers is None or len(Hashes.powers[0]) <= n:
            up, down = (np.full(max(n + 1, 1 << 12), x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            Hashes.powers = np.cumprod(up), np.cumprod(down)
        up, self.down = Hashes.powers
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUE[b] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def words_of(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The GRAM bytes from each place on, as four numbers that sort as the bytes do."""
    w = np.ascontiguousarray(b[at[:, None] + np.arange(GRAM)]).view(">u8").astype(np.uint64)
    return (w ^ np.uint64(1 << 63)).view(np.int64)


def multikey(columns: list[np.ndarray]) -> np.ndarray:
    """The rows' order by multikey quicksort, in which a column is a character: each one sorts only rows that are equal so far."""
    order = np.arange(len(columns[0]))
    at, group = order.copy(), np.zeros(len(order), np.int64)
    for c in columns:
        rows = order[at]
        rows = rows[np.lexsort((c[rows], group))]
        order[at] = rows
        new = np.append(True, (group[1:] != group[:-1]) | (c[rows][1:] != c[rows][:-1]))[: len(rows)]
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1 if len(group) else np.empty(0, bool)
        at, group = at[tied], group[tied]
        if not len(at):
            break
    return order


def stretches(n: int):
    """(lo, hi) of byte stretches so that each window lies in exactly one."""
    for lo in range(0, max(0, n - SPAN + 1), STRETCH):
        yield lo, min(n, lo + STRETCH + SPAN - 1)


def anchors(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one stretch: place, first and last window of each anchor."""
    h = Hashes(b)
    grams = np.arange(len(b) - GRAM + 1)
    # the hash's upper bits, then the place: the minimum is the leftmost of the smallest
    key = (h.of(grams, grams + GRAM) >> np.uint64(20) << np.uint64(20)) | grams.astype(np.uint64)
    width, span = 1, SPAN - GRAM + 1
    least = key
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    return place[first], first, last


def _digests(raw: memoryview, starts: list[int], ends: list[int]) -> np.ndarray:
    """128-bit digests as pairs of numbers."""
    d = b"".join([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts, ends)])
    return np.frombuffer(d, np.int64).reshape(-1, 2)


def _anchor_rows(batches):
    """key, spot (place, windows before and after it), gram and context of all anchors."""
    for batch in batches:
        parts = [[] for _ in range(4)]
        for key, packed in zip(*(c.to_pylist() for c in batch.columns)):
            raw = zlib.decompress(packed)
            whole = np.frombuffer(raw, np.uint8)
            for lo, hi in stretches(len(raw)):
                at, first, last = anchors(whole[lo:hi])
                context = _digests(memoryview(raw), (first + lo).tolist(), (last + lo + SPAN).tolist())
                for p, x in zip(parts, (np.full(len(at), key), _spot(at + lo, at - first, last - first), words_of(whole, at + lo), context)):
                    p.append(x)
        key, spot, gram, context = (np.concatenate(p) if p else np.empty((0, n), np.int64) for p, n in zip(parts, (1, 1, 4, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).ravel()) for x in (key, spot, *gram.T, *context.T)], names=["key", "spot", *GRAMS, *CONTEXT])


def _spot(at: np.ndarray, before: np.ndarray, more: np.ndarray) -> np.ndarray:
    """An anchor's place, how far before it its first window starts, and how many more windows follow; the latter two are below 256."""
    return at << 16 | before << 8 | more


def _runs(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spot >> 16, spot >> 8 & 255, spot & 255


def _same(t: pa.Table, cols: list[str]) -> np.ndarray:
    """Whether each row but the first equals the one before."""
    same = np.ones(t.num_rows - 1, bool)
    for c in cols:
        x = t.column(c).to_numpy()
        same &= x[1:] == x[:-1]
    return same


def _sorted_bucket(order: list[str], levels: dict[str, list[str]]):
    """For mapInArrow over a range partition: sort by ``order`` and flag, for each level, rows equal to a neighbour.

    ``witness`` marks one row of each run of the last level, where its run of the first level has, or may
    have in another bucket, rows of other runs. Emits rows with any flag, and always the first and last row (role 1, 2, or 3 for both) for the comparison across buckets.
    """

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        t = t.take(pa.array(multikey([t.column(c).to_numpy() for c in order])))
        n = t.num_rows
        role = np.zeros(n, np.int32)
        role[0] += 1
        role[-1] += 2
        keep, flags = role > 0, {}
        for name, cols in levels.items():
            same = _same(t, cols)
            flags[name] = np.append(same, False) | np.append(False, same)
            keep |= flags[name]
        coarse, fine = (np.append(True, ~_same(t, cols)) for cols in (list(levels.values())[0], list(levels.values())[-1]))
        group = np.cumsum(coarse) - 1
        mixed = np.bincount(group[fine])[group] > 1
        flags["witness"] = fine & (mixed | (group == 0) | (group == group[-1]))
        for name, x in flags.items():
            t = t.append_column(name, pa.array(x))
        t = t.append_column("role", pa.array(role)).append_column("bucket", pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)))
        yield from t.filter(pa.array(keep)).combine_chunks().to_batches(max_chunksize=50_000)

    return run


def neighbours(rows: DataFrame, order: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """Rows with, for each level, whether another row has equal columns; rows without any may be left out.

    Each level's columns must be a prefix of ``order``, so that equal rows are neighbours. Range
    partitioning computes ``rows`` twice, for its splitters and for the shuffle, which is less than
    writing them.
    """
    schema = rows.sparkSession.createDataFrame([], rows.schema).select("*", *[F.lit(True).alias(x) for x in (*levels, "witness")], F.lit(0).alias("role"), F.lit(0).alias("bucket")).schema
    flagged = written(rows.repartitionByRange(2 * partitions(rows.sparkSession), *order, _salt(rows)).mapInArrow(_sorted_bucket(order, levels), schema))
    # across boundaries: the last row of a bucket and the first of the next that has any; two rows of each bucket
    edges = flagged.where("role > 0").select("bucket", "role", *order).collect()
    firsts, lasts = {r.bucket: r for r in edges if r.role & 1}, {r.bucket: r for r in edges if r.role & 2}
    buckets, mend = sorted(firsts), {name: set() for name in levels}
    for a, b in zip(buckets, buckets[1:]):
        for name, cols in levels.items():
            if all(lasts[a][c] == firsts[b][c] for c in cols):
                mend[name] |= {(a, "last"), (b, "first")}
    out = flagged
    for name in levels:
        for which, bit in (("first", 1), ("last", 2)):
            if numbers := [k for k, w in mend[name] if w == which]:
                out = out.withColumn(name, F.col(name) | F.col("bucket").isin(numbers) & (F.col("role").bitwiseAND(bit) > 0))
    return out.drop("role", "bucket")


def _salt(rows: DataFrame):
    return F.xxhash64("key", "spot")


def _context_rows(batches):
    """For each anchor that is left, the bytes of its windows."""
    for batch in batches:
        rows, gram = [[] for _ in range(4)], []
        for key, packed, runs in zip(*(c.to_pylist() for c in batch.columns)):
            raw = zlib.decompress(packed)
            spots = np.array([r["spot"] for r in runs])
            at, before, more = _runs(spots)
            gram.append(words_of(np.frombuffer(raw, np.uint8), at))
            rows[0] += [key] * len(runs)
            rows[1] += spots.tolist()
            rows[2] += [r["hot"] for r in runs]
            rows[3] += [raw[s:e] for s, e in zip((at - before).tolist(), (at - before + more + SPAN).tolist())]
        g = np.concatenate(gram) if gram else np.empty((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))), *(pa.array(np.ascontiguousarray(x)) for x in g.T)], names=["key", "spot", "hot", "bytes", *GRAMS])


def equal_windows(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): an order of the windows from ``starts`` on in which equal ones are neighbours, and whether each equals the next.

    Hashes bring windows together, bytes decide; where unequal windows share a hash, those are sorted by their bytes.
    """
    h = Hashes(flat).of(starts, starts + SPAN)
    order = np.argsort(h, kind="stable")
    alike = np.append(h[order][1:] == h[order][:-1], False)[: len(order)]
    view, same = np.lib.stride_tricks.sliding_window_view(flat, SPAN), alike.copy()
    compare = lambda i: (view[starts[order[i]]] == view[starts[order[i + 1]]]).all(axis=1)
    at = np.flatnonzero(alike)
    for i in range(0, len(at), 50_000):
        same[at[i : i + 50_000]] = compare(at[i : i + 50_000])
    if (same != alike).any():
        ends = np.flatnonzero(~alike)
        for e in np.unique(np.searchsorted(ends, np.flatnonzero(same != alike))):
            lo, hi = (int(ends[e - 1]) + 1 if e else 0), int(ends[e]) + 1
            order[lo:hi] = sorted(order[lo:hi].tolist(), key=lambda i: flat[starts[i] : starts[i] + SPAN].tobytes())
            same[lo : hi - 1] = compare(np.arange(lo, hi - 1))
    return order, same


def _compare_windows(batches):
    """One bucket: stretches of windows that occur twice, and, with their digest, the different windows of hot grams."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    words = [t.column(c).to_numpy() for c in GRAMS]
    order = multikey(words)
    t = t.take(pa.array(order))
    new = np.append(True, np.any([w[order][1:] != w[order][:-1] for w in words], axis=0))
    starts = np.append(np.flatnonzero(new), t.num_rows)
    lo, names, none = 0, ["key", "s", "e", *CONTEXT], np.empty((0, 2), np.int64)
    while lo < len(starts) - 1:  # whole grams at a time, of so many rows that their windows fit
        hi = min(len(starts) - 1, max(lo + 1, int(np.searchsorted(starts, starts[lo] + ROWS_AT_ONCE, "right")) - 1))
        part = t.slice(int(starts[lo]), int(starts[hi] - starts[lo]))
        key, opened, raw = part.column("key").to_numpy(), part.column("hot").to_numpy(), b"".join(part.column("bytes").to_pylist())
        at, before, more = _runs(part.column("spot").to_numpy())
        n, sizes = more + 1, more + SPAN
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        here, start = (np.cumsum(sizes) - sizes)[row] + step, (at - before)[row] + step
        order, same = equal_windows(np.frombuffer(raw, np.uint8), here)
        twice = np.zeros(len(row), bool)
        twice[order] = same | np.append(False, same[:-1])
        # windows that occur twice, as stretches of bytes: a row's windows lie one after the other
        join = np.append(False, twice[1:] & twice[:-1] & (row[1:] == row[:-1]))
        first = np.flatnonzero(twice & ~join)
        last = np.flatnonzero(twice & ~np.append(join[1:], False))
        # of equal windows here one goes on to be compared with other buckets: the others are known to occur twice
        free = order[np.append(True, ~same[:-1])]
        free = free[opened[row[free]]]
        digest = _digests(memoryview(raw), here[free].tolist(), (here[free] + SPAN).tolist()) if len(free) else none
        nothing = pa.nulls(len(first), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(key[row[first]]), pa.array(start[first]), pa.array(start[last] + SPAN), nothing, nothing], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(key[row[free]]), pa.array(start[free]), pa.array(start[free] + SPAN), *(pa.array(np.ascontiguousarray(x)) for x in digest.T)], names=names)
        lo = hi


def _packed(batches):
    """Texts are kept and travel compressed."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([zlib.compress(t, 1) for t in b.column(3).cast(pa.binary()).to_pylist()], pa.binary())], names=["copies", "digest", "n_bytes", "packed"])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """A row (key, copies, digest, n_bytes, packed) for each different text of SPAN bytes or more. Copies are merged before the shuffle; keys are row numbers of the written table."""
    counted = docs.where(F.octet_length("text") >= SPAN).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    rows = counted.select("copies", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return written(rows.mapInArrow(_packed, "copies long, digest string, n_bytes long, packed binary").withColumn("key", F.monotonically_increasing_id()))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(key, spans): for each of the different texts with any, the stretches of bytes [s, e) that repeated windows cover, not yet merged."""
    words, context = (", ".join(f"{c} long" for c in x) for x in (GRAMS, CONTEXT))
    rows = texts.select("key", "packed").mapInArrow(_anchor_rows, f"key long, spot long, {words}, {context}")
    found = neighbours(rows, [*GRAMS, *CONTEXT], {"gram_twice": GRAMS, "context_twice": [*GRAMS, *CONTEXT]})
    at, before, more = F.shiftright("spot", 16), F.shiftright("spot", 8).bitwiseAND(255), F.col("spot").bitwiseAND(255)
    whole = found.where("context_twice").select("key", (at - before).alias("s"), (at - before + more + SPAN).alias("e"))
    # of each repeated context one goes along, for windows elsewhere that equal part of it
    left = found.where("gram_twice and (not context_twice or witness)").select("key", "spot", *GRAMS)
    limit = max(HOT_ROWS, left.count() // MOST_HOT)
    hot = left.groupBy(*GRAMS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(*GRAMS, F.lit(True).alias("hot"))
    left = left.join(F.broadcast(hot), GRAMS, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))  # at most MOST_HOT rows
    runs = left.groupBy("key").agg(F.collect_list(F.struct("spot", "hot")).alias("runs"))  # the places of one text
    contexts = written(texts.join(runs, "key").select("key", "packed", "runs").mapInArrow(_context_rows, f"key long, spot long, hot boolean, bytes binary, {words}"))
    dealt = contexts.repartitionByRange(2 * partitions(texts.sparkSession), *GRAMS, F.when(F.col("hot"), _salt(contexts)).otherwise(0))
    windows = written(dealt.mapInArrow(_compare_windows, f"key long, s long, e long, {context}"))
    opened = windows.where("c0 is not null")
    again = opened.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*CONTEXT)
    found_twice = windows.where("c0 is null").select("key", "s", "e").unionByName(opened.join(again, CONTEXT, "left_semi").select("key", "s", "e"))
    return whole.unionByName(found_twice).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover; spans that touch are one run."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _cut(batches):
    names = ["digest", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        rows = [[] for _ in names]
        for digest, packed, spans in zip(*(c.to_pylist() for c in batch.columns)):
            raw, merged = zlib.decompress(packed), merge(spans)
            left = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(raw)]))
            for x, v in zip(rows, (digest, len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left)):
                x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=names)


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes that stay."""
    texts = distinct_texts(docs)
    cut = texts.where("copies = 1").join(repeated_spans(texts), "key").select("digest", "packed", "spans").mapInArrow(_cut, "digest string, n_removed long, n_spans long, kept_sha256 string, kept binary")
    gone = texts.where("copies > 1").select("digest", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.lit(b"").alias("kept"), "copies")
    facts = cut.withColumn("copies", F.lit(1).cast("long")).unionByName(gone)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"), F.encode(text, "UTF-8").alias("whole"))
    j = join_hot(rows, facts, "digest", "copies", texts.agg(F.sum("copies")).first()[0] or 0)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return j.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"), F.coalesce("kept", "whole").alias("kept"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
