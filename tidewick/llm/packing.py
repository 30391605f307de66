"""Packing documents into sequences by linear grouping.

Everything that is optimised is a histogram of piece lengths, of at most ``limit`` entries whatever the
number of documents. Lengths above ``limit / SMALL`` are large: sorted, cut into ``GROUPS`` groups of
equal cardinality, and rounded up to the longest of their group. A configuration is a multiset of rounded
lengths that fits; column generation finds the configurations' fractional optimum, whose whole parts are
used, and what is left over is packed by best fit, decreasing. Actual lengths are then substituted for
rounded ones, in runs of sequences with equal lengths, and small pieces go by best fit into the gaps that
leaves. The plan is a list of runs (length, ranks, sequences, offset). Documents join it by their rank
among pieces of equal length; ranks come from counts by (length, salt), so that a length that a third of
all rows have is spread over many tasks.

Defined cases: a null text is empty, and so its document is the end token alone; repeated rows are
packed each; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import partitions, row_key, text_of, written
from .tokens import BYTE_BPE, encoder

LIMIT = 1024
END = 2
GROUPS = 128
SMALL = 16


def pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str = BYTE_BPE) -> DataFrame:
    """doc_id, row_hash, piece, start, length, ids_crc32: whole documents where they fit, else pieces of which the first may be shorter."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            out = []
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_of(b.column(2))):
                ids = np.array([*enc.encode_ordinary(text), END], "<u4")
                cut = [0, *range(len(ids) % limit or limit, len(ids), limit), len(ids)]
                out += [(doc, key, k, s, e - s, zlib.crc32(ids[s:e])) for k, (s, e) in enumerate(zip(cut, cut[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 6, (b.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "row_hash", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key("doc_id", "text").alias("row_hash"), "text").mapInArrow(run, f"doc_id {kind}, row_hash long, piece int, start long, length long, ids_crc32 long")


def _groups(hist: dict[int, int], many: int) -> dict[int, int]:
    """Length: the rounded length of its group, for groups of equal cardinality of the sorted lengths (equal lengths stay together)."""
    total, seen, out, top, now = sum(hist.values()), 0, {}, 0, -1
    for length in sorted(hist, reverse=True):
        if (at := seen * many // total) != now:
            now, top = at, length
        out[length] = top
        seen += hist[length]
    return out


def _configurations(demand: dict[int, int], limit: int, rounds: int = 4000) -> list[tuple[list[tuple[int, int]], float]]:
    """The cutting-stock linear programme by column generation: ([(rounded length, times)], multiplicity)."""
    sizes = np.array(sorted(demand, reverse=True))
    need = np.array([demand[s] for s in sizes], float)
    m = len(sizes)
    columns = np.diag(limit // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ need
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        best, last = np.zeros(limit + 1), np.full(limit + 1, -1)
        # an unbounded knapsack over sizes in falling order: copies of one size by shifted maxima
        for i in range(m):
            s, v = int(sizes[i]), dual[i]
            if v <= 1e-12:
                continue
            for start in range(s, limit + 1, s):
                stop = min(start + s, limit + 1)
                other = best[start - s : stop - s] + v
                better = other > best[start:stop] + 1e-12
                best[start:stop][better] = other[better]
                last[start:stop][better] = i
        if best[limit] <= 1 + 1e-4:  # Farley's bound: within a ten thousandth of the optimum
            break
        column, room = np.zeros(m), limit
        while room > 0 and last[room] >= 0:
            column[last[room]] += 1
            room -= int(sizes[last[room]])
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        theta = ratio[out]
        x = x - theta * step
        x[out] = theta
        np.maximum(x, 0, out=x)
        columns[:, out] = column
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    return [([(int(sizes[i]), int(columns[i, k])) for i in np.flatnonzero(columns[:, k])], float(x[k])) for k in np.argsort(-x, kind="stable") if x[k] > 0]


class _Plan:
    """Runs of equal sequences, with what is placed so far; pieces are taken from each length's ranks in order."""

    def __init__(self, hist: dict[int, int], limit: int):
        self.limit, self.left, self.used, self.bins, self.runs = limit, dict(hist), defaultdict(int), 0, []

    def place(self, length: int, many: int, first: int, offset: int) -> None:
        self.runs.append((length, self.used[length], self.used[length] + many, first, offset))
        self.used[length] += many
        self.left[length] -= many

    def open(self, lengths: list[int], many: int) -> tuple[int, int, int]:
        """many new sequences with these lengths: (gap, first sequence, how many)."""
        first, at = self.bins, 0
        self.bins += many
        for x in lengths:
            self.place(x, many, first, at)
            at += x
        return self.limit - at, first, many


def plan(hist: dict[int, int], limit: int = LIMIT, groups: int = GROUPS, small: int = SMALL) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, first sequence, offset), and the number of sequences."""
    p = _Plan({k: v for k, v in hist.items() if v > 0}, limit)
    gaps: list[tuple[int, int, int]] = []
    if p.left.get(limit):
        p.open([limit], p.left[limit])
    large = {k: v for k, v in p.left.items() if v and k * small > limit}
    if large:
        rounded = _groups(large, groups)
        members, demand, order = defaultdict(list), defaultdict(int), sorted(large, reverse=True)
        for length, many in large.items():
            members[rounded[length]].append(length)
            demand[rounded[length]] += many
        for m in members.values():
            m.sort(reverse=True)
        for content, times in _configurations(dict(demand), limit):
            whole = int(times + 1e-6)
            while whole > 0:
                # the longest actual lengths left in each group; as many sequences as have the same ones
                take, ahead, many = [], defaultdict(int), whole
                slots = [top for top, copies in content for _ in range(copies)]
                for k, top in enumerate(slots):
                    own = [*members[top]]
                    if k == len(slots) - 1:  # the last place takes the longest large piece that fits, rounded or not
                        room = limit - sum(take)
                        own = [x for x in order[bisect.bisect_left(order, -room, key=lambda x: -x) :] if p.left[x] > ahead.get(x, 0)][:1]
                    x = next((x for x in own if p.left[x] > ahead.get(x, 0)), None)
                    if x is not None:
                        take.append(x)
                        ahead[x] += 1
                if not take:
                    break
                many = max(1, min(many, *(p.left[x] // c for x, c in ahead.items())))
                gaps.append(p.open(take, many))
                whole -= many
    # what is left of the large ones, then the small ones: best fit, longest first
    heap = defaultdict(list)
    for gap, first, many in gaps:
        heap[gap].append((first, many))
    for length in sorted((k for k, v in p.left.items() if v), reverse=True):
        while p.left[length]:
            gap = next((g for g in range(length, limit) if heap[g]), None)
            if gap is None:
                fit = limit // length
                if full := p.left[length] // fit:
                    g, first, many = p.open([length] * fit, full)
                    heap[g].append((first, many))
                if rest := p.left[length]:
                    g, first, many = p.open([length] * rest, 1)
                    heap[g].append((first, many))
                break
            first, many = heap[gap].pop()
            # as often in each sequence of the run as the gap holds, else once in as many as there are pieces
            each = min(gap // length, p.left[length] // many)
            if each == 0:
                use = p.left[length]
                p.place(length, use, first, limit - gap)
                heap[gap].append((first + use, many - use))
                heap[gap - length].append((first, use))
            else:
                for k in range(each):
                    p.place(length, many, first, limit - gap + k * length)
                heap[gap - each * length].append((first, many))
    return p.runs, p.bins


def best_fit_count(hist: dict[int, int], limit: int = LIMIT) -> int:
    """Sequences that best fit, decreasing, needs: the yardstick of tests."""
    free: list[int] = []
    for length in sorted(hist, reverse=True):
        for _ in range(hist[length]):
            i = bisect.bisect_left(free, length)
            gap = free.pop(i) - length if i < len(free) else limit - length
            bisect.insort(free, gap)
    return len(free)


def pack(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to pieces with row_hash, piece and length."""
    spark = rows.sparkSession
    rows = written(rows)
    salts = max(16, 2 * partitions(spark))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row_hash", "piece"), F.lit(salts)).cast("int"))
    counts = written(rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` lengths
    runs, _ = plan(hist, limit)
    runs = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "run_length long, lo long, hi long, first_sequence long, at long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("length").alias("c_length"), F.col("salt").alias("c_salt"), before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_hash", "piece", "doc_id")) - 1
    ranked = rows.withColumn("inner", inner).join(counts, (F.col("length") == F.col("c_length")) & (F.col("salt") == F.col("c_salt"))).withColumn("rank", (F.col("inner") + F.col("before")).cast("long"))
    # runs number at most a few for each length and configuration, whatever the number of documents
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("at").alias("offset"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
