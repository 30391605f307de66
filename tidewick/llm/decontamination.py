"""Benchmark decontamination: SimHash of windows as long as parts of items, multi-index Hamming search, exact verification.

An item has three parts, each two fifths of its words: the first, the middle and the last one. What has ``SIMILARITY`` of
an item's shingles lacks a fifth of them at most, and then some part is (nearly) whole: whatever lies in one stretch, or at both
ends, leaves one of the three untouched, and what is spread out takes little from any. A part's fingerprint is the
SimHash (64 bits) of its word pairs. Parts are put into size classes, and every document is covered by windows of each
class's length; a window's bit sums come from differences of prefix sums, so overlapping windows cost no rehashing. The
index has four tables, one for each 16-bit block of a fingerprint: a fingerprint within ``RADIUS`` (15) bits of a part's
has a block within 3 bits of the part's, and each table lists a part under every value within 3 bits of its block; so the search
returns all windows within the radius, and a popcount keeps those. Around each, the item is then verified exactly: the weighted
share of the item's 5-word shingles (with their multiplicity) that an item-sized window has; at least ``SIMILARITY``.

Windows start every sixth of their length from their text's first word and classes span three tenths. ``tests/llm`` holds
what is found against all that brute force accepts, also where passages have just 0.80 to 0.85 of an item.

Defined cases: null texts and items are empty; an empty item matches nothing; items of fewer than 5 words
are a single shingle; repeated documents give repeated rows; repeated items each match; empty tables give
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, mix, row_key, shingle_hashes, text_of, word_hashes, word_hashes_of, written

SIMILARITY = 0.8
RADIUS = 15
#: items that one pass over the documents looks for; a larger benchmark takes several passes
ITEMS = 8_000
#: a part's share of an item, and its least words; windows start every STEPth part of their length, and a class's longest part is SPAN times its shortest
PART, LEAST, STEP, SPAN = 0.4, 6, 6, 1.3
_CHUNK = 1 << 13
#: characters of texts that are hashed together
_TOGETHER = 1 << 15


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each word and its follower; a single word is a pair of its own."""
    if len(words) < 2:
        return mix(words)
    with np.errstate(over="ignore"):
        return mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(5))


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(words: np.ndarray) -> int:
    h = pair_hashes(words)
    return int(np.packbits(_bits(h).sum(axis=0) > len(h) // 2, bitorder="little").view("<u8")[0])


def majorities(counts: np.ndarray, half: int | np.ndarray, counter: type) -> np.ndarray:
    """Fingerprints from rows of 64 counters, side by side in 64-bit numbers: the bits of those above ``half``, of all rows or of each. Uses up the counters."""
    if counter is not np.uint8:
        return np.packbits(counts.view(counter) > np.reshape(half, (-1, 1)).astype(counter), axis=1, bitorder="little").view("<u8").ravel()
    # eight counters below 128 in a number: adding 127 - half sets a counter's top bit if it is above half; a product brings the top bits together in the last byte
    with np.errstate(over="ignore"):
        counts += np.reshape(127 - half, (-1, 1)).astype(np.uint64) * np.uint64(0x0101010101010101)
        counts &= np.uint64(0x8080808080808080)
        counts *= np.uint64(0x0002040810204081)
    return counts.astype("<u8", copy=False).view(np.uint8)[:, 7::8].copy().view("<u8").ravel()


#: what turns a 16-bit value into those within 3 bits of it: with four blocks, radius 15 needs no more
_NEAR = np.array([sum(1 << i for i in c) for k in range(RADIUS // 4 + 1) for c in itertools.combinations(range(16), k)], np.int64)


class Index:
    """The multi-index over the parts of all items; each size class has its own part of every table.

    Most values list no more than ``FEW`` parts. A table has the numbers of these in a single 64-bit number, so that all windows are
    compared with them at once; lists are only walked for windows that are near one of them or whose value lists more.
    """

    FEW = 4
    #: parts with numbers that fit a quarter of it; those beyond are only in the lists
    NUMBERED = 0xFFFF

    def __init__(self, prints: np.ndarray, classes: np.ndarray):
        self.prints, self.tables = prints, []
        self.more = min(len(prints), self.NUMBERED)  # instead of a part's number: see the list
        self.few = np.append(prints[: self.more], np.uint64(0))
        places = (1 << 16) * (int(classes.max()) + 1 if len(classes) else 1)
        for block in range(4):
            own = (prints >> np.uint64(16 * block)).astype(np.int64) & 0xFFFF
            v = ((classes << 16)[:, None] | own[:, None] ^ _NEAR[None, :]).ravel()
            size = np.bincount(v, minlength=places)
            start, flat = np.cumsum(size) - size, (np.argsort(v, kind="stable") // len(_NEAR)).astype(np.int32)
            first = np.full((places, self.FEW), self.more, np.uint16)
            for j in range(self.FEW if len(flat) else 0):
                # the last part again where there are fewer; any part where there is none, as the list is empty
                at = np.minimum(start + np.clip(size - 1, 0, j), len(flat) - 1)
                first[:, j] = np.minimum(flat[at], self.more)
            first[size > self.FEW, -1] = self.more
            self.tables.append((first.view(np.uint64).ravel(), size.astype(np.int32), start.astype(np.int32), flat))

    def search(self, windows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, part) pairs of equal class within the radius; a pair may come from several blocks and is returned once."""
        found = [np.empty(0, np.int64)]
        blocks, many, copies = windows.view("<u2").reshape(-1, 4), max(1, len(self.prints)), np.repeat(windows, self.FEW)
        for block, (first, size, start, flat) in enumerate(self.tables):
            v = blocks[:, block] + classes
            few = first.take(v, mode="clip").view(np.uint16)
            differ = self.few.take(few, mode="clip")
            differ ^= copies
            look = np.bitwise_count(differ) <= RADIUS
            look |= few == self.more
            hit = np.flatnonzero(look.view(np.uint32))
            v = v[hit]
            n = size[v]
            at = np.repeat(start[v] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            w, item = np.repeat(hit, n), flat[at]
            near = np.bitwise_count(windows[w] ^ self.prints[item]) <= RADIUS
            found.append(w[near] * many + item[near])
        key = np.unique(np.concatenate(found))
        return key // many, key % many


def parts_of(size: int) -> list[tuple[int, int]]:
    """(first word, words) of an item's parts."""
    n = min(size, max(LEAST, -(-size * 2 // 5)))
    return sorted({(at, n) for at in (0, (size - n) // 2, size - n)})


class Matcher:
    def __init__(self, items: list[tuple[object, str]], similarity: float = SIMILARITY):
        self.similarity, self.items = similarity, []
        parts = []  # words, fingerprint, item
        for key, text in items:
            w = word_hashes(text or "")
            if len(w):
                parts += [(n, fingerprint(w[at : at + n]), len(self.items)) for at, n in parts_of(len(w))]
                s, n = np.unique(shingle_hashes(w), return_counts=True)
                self.items.append((key, len(w), s, n))
        parts.sort(key=lambda x: x[0])
        self.owner = np.array([x[2] for x in parts], np.int64)
        # shingles of all items but those of fewer than 5 words, and a table of their low bits
        self.short = np.array([x[1] < 5 for x in self.items], bool)
        self.wanted = np.unique(np.concatenate([np.empty(0, np.uint64), *(x[2] for x in self.items if x[1] >= 5)]))
        self.low = np.zeros(1 << max(16, len(self.wanted).bit_length() + 5), bool)
        self.low[self.wanted & np.uint64(len(self.low) - 1)] = True
        self.classes: list[tuple[int, int]] = []  # pairs in a window, step
        of, at = [], 0
        while at < len(parts):
            shortest = parts[at][0]
            end = next((i for i in range(at, len(parts)) if parts[i][0] > shortest * SPAN), len(parts))
            size = (shortest + parts[end - 1][0] + 1) // 2
            of += [len(self.classes)] * (end - at)
            self.classes.append((max(1, size - 1), max(1, size // STEP)))
            at = end
        longest = max((x[0] for x in parts), default=0)
        self.counter = np.uint8 if longest < 1 << 7 else np.uint16 if longest < 1 << 16 else np.uint32
        self.index = Index(np.array([x[1] for x in parts], np.uint64), np.array(of, np.int64))

    def contains(self, shingles: np.ndarray, item: tuple, at: np.ndarray) -> tuple[float, int]:
        """The best weighted share of the item's shingles in any window of its size that holds a place of ``at``, and that window's start."""
        _, size, want, weight = item
        k = max(1, size - min(5, size) + 1)
        total, best, where = int(weight.sum()), 0, 0
        # places whose windows meet make one stretch
        for part in np.split(at, np.flatnonzero(np.diff(at) >= 2 * k) + 1):
            lo, hi = max(0, int(part[0]) - k + 1), min(len(shingles), int(part[-1]) + k)
            region = shingles[lo:hi]
            i = np.searchsorted(want, region)
            i[i == len(want)] = 0
            i[want[i] != region] = -1
            sums = np.concatenate([[0], np.cumsum(i >= 0)])
            starts = np.arange(max(1, len(region) - k + 1))
            if (sums[np.minimum(starts + k, len(region))] - sums[starts]).max() < self.similarity * total:
                continue
            # the window moves by one shingle at a time
            i, have, limit, got = i.tolist(), [0] * len(want), weight.tolist(), 0
            for e, x in enumerate(i):
                if x >= 0:
                    have[x] += 1
                    got += have[x] <= limit[x]
                if e >= k and (y := i[e - k]) >= 0:
                    got -= have[y] <= limit[y]
                    have[y] -= 1
                if got > best:
                    best, where = got, lo + max(0, e - k + 1)
        return best / total, where

    def windows(self, lengths: list[int], ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, class and fingerprint of all windows of the segments that lie one after the other below ``ones``, prefix sums of bits.

        Counters lie side by side in 64-bit numbers. A difference of two sums is the number whose counters are
        the differences, as each of these fits its place, whatever overflowed into a neighbour in the sums.
        """
        ends = np.cumsum(lengths)
        begins = ends - lengths
        out = []
        for c, (pairs, step) in enumerate(self.classes):
            many = np.maximum(0, (np.asarray(lengths) - pairs) // step + 1)
            # and the last window of each segment, or the whole of a shorter one
            tail, at = np.maximum(begins, ends - pairs), 0
            s = np.empty(int(many.sum()) + len(tail), np.int64)
            counts = np.empty((len(s), ones.shape[1]), np.uint64)
            for b, n in zip(begins.tolist(), many.tolist()):
                stop = b + (n - 1) * step + 1
                if n:
                    s[at : at + n] = np.arange(b, stop, step)
                    np.subtract(ones[b + pairs : stop + pairs : step], ones[b:stop:step], out=counts[at : at + n])
                at += n
            s[at:] = tail
            np.subtract(ones[ends], ones[tail], out=counts[at:])
            prints = majorities(counts[:at], pairs // 2, self.counter), majorities(counts[at:], (ends - tail) // 2, self.counter)
            out.append((s, np.full(len(s), c << 16), np.concatenate(prints)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def match(self, texts: list[str]) -> list[list[tuple[object, float, int]]]:
        """For each text (item, similarity, first word of the best window), for each item that it holds."""
        best: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        if self.classes:
            longest, held, batch = max(c[0] for c in self.classes), 0, []
            for i, words, pairs in hashed(texts):
                for lo in range(0, len(pairs), _CHUNK):
                    batch.append((i, words, lo, pairs[lo : lo + _CHUNK + longest]))
                    held += len(batch[-1][3])
                    if held >= _CHUNK:
                        self._search(batch, best)
                        held, batch = 0, []
            self._search(batch, best)
        return [[(self.items[k][0], -share, where) for k, (share, where) in sorted(b.items())] for b in best]

    def worth(self, batch: list, at: np.ndarray, k: np.ndarray, first: np.ndarray, last: np.ndarray, longest: int) -> np.ndarray:
        """Whether items ``k`` are worth verifying in segments ``at``: nearly all that are within the radius by chance have no item's shingle from their first window to the end of their last."""
        if not len(at):
            return np.empty(0, bool)
        parts = [words[lo : lo + len(pairs) + longest + 4] for _, words, lo, pairs in batch]
        sizes = np.array([len(x) for x in parts])
        ends = np.cumsum(sizes)
        known = np.zeros(int(ends[-1]) + 1, np.int64)
        if ends[-1] >= 5 and len(self.wanted):
            h = shingle_hashes(np.concatenate(parts))
            # shingles end in their own segment
            own = np.ones(len(known) + 3, bool)
            own[(ends[:, None] - 1 - np.arange(4)).clip(0)] = False
            maybe = np.flatnonzero(self.low.take((h & np.uint64(len(self.low) - 1)).astype(np.int64)) & own[: len(h)])
            found = np.minimum(np.searchsorted(self.wanted, h[maybe]), len(self.wanted) - 1)
            known[maybe[self.wanted[found] == h[maybe]] + 1] = 1
            np.cumsum(known, out=known)
        lo, total = np.array([x[2] for x in batch])[at], np.array([max(0, len(x[1]) - 4) for x in batch])[at]
        a, b = np.minimum(first, total - 1) - lo, np.minimum(np.minimum(last, total - 1) - lo + longest, sizes[at])
        begin = (ends - sizes)[at]
        return self.short[k] | (a < 0) | (known[begin + np.maximum(b, 0)] > known[begin + np.maximum(a, 0)])

    def _search(self, batch: list, best: list) -> None:
        if not batch:
            return
        lengths = [len(x[3]) for x in batch]
        part = _bits(np.concatenate([x[3] for x in batch])).astype(self.counter, copy=False).view(np.uint64)
        ones = np.zeros((len(part) + 1, part.shape[1]), np.uint64)
        np.cumsum(part, axis=0, out=ones[1:])
        starts, classes, prints = self.windows(lengths, ones)
        begins = np.cumsum(lengths) - lengths
        w, part = self.index.search(prints, classes)
        if not len(w):
            return
        at, k = np.searchsorted(begins, starts[w], "right") - 1, self.owner[part]
        first, longest = starts[w] - begins[at] + np.array([x[2] for x in batch])[at], max(c[0] for c in self.classes) + 1
        # all windows of one item in one stretch of a text are verified together
        order = np.lexsort((first, k, at))
        at, k, first = at[order], k[order], first[order]
        edge = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(k, prepend=-1) != 0))
        stop = np.append(edge[1:], len(at))
        worth = self.worth(batch, at[edge], k[edge], first[edge], first[stop - 1], longest)
        shingles: dict[tuple[int, int], np.ndarray] = {}
        for a, b in zip(edge[worth].tolist(), stop[worth].tolist()):
            i, words = batch[at[a]][:2]
            item = int(k[a])
            size = min(5, self.items[item][1])
            if (i, size) not in shingles:
                shingles[i, size] = shingle_hashes_of(words, size)
            text, want = shingles[i, size], self.items[item][2]
            if not len(text):
                continue
            places = np.minimum(first[a:b], len(text) - 1)
            region = text[places[0] : places[-1] + longest]
            # those within the radius by chance have none of the item's shingles
            if not (want[np.minimum(np.searchsorted(want, region), len(want) - 1)] == region).any():
                continue
            share, where = self.contains(text, self.items[item], np.unique(places))
            if share >= self.similarity and (-share, where) < best[i].get(item, (1.0, 0)):
                best[i][item] = (-share, where)


def hashed(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, word hashes and pair hashes of each text; short texts are hashed together."""
    at = 0
    while at < len(texts):
        end, held = at + 1, len(texts[at])
        while end < len(texts) and held + len(texts[end]) <= _TOGETHER:
            held += len(texts[end])
            end += 1
        words = word_hashes_of(texts[at:end])
        pairs, begin = pair_hashes(np.concatenate(words)), 0
        for i, w in enumerate(words, at):
            yield i, w, pairs[begin : begin + len(w) - 1] if len(w) > 1 else pair_hashes(w)
            begin += len(w)
        at = end


@functools.lru_cache(2)
def _matcher(items: tuple, similarity: float) -> Matcher:
    """One index for all tasks of a Python worker."""
    return Matcher(list(items), similarity)


def shingle_hashes_of(words: np.ndarray, k: int) -> np.ndarray:
    """Shingles of k words, for items shorter than 5; a text shorter than the item has none."""
    return shingle_hashes(words, k) if len(words) >= k else np.empty(0, np.uint64)


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], similarity: float = SIMILARITY) -> DataFrame:
    """Columns ``keep`` of docs with item_id, similarity and start (in words), a row for each document and item found in it."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").orderBy("item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    fields = [docs.schema[c] for c in keep]
    source = docs.select(*keep, F.col("text").alias(free_name(docs, "whole_text")))
    many = items.count()
    numbered = items.withColumn("part", F.pmod(row_key("item_id", "text"), F.lit(max(1, -(-many // ITEMS)))))
    found = None
    for part in range(max(1, -(-many // ITEMS))):  # the benchmark, in blocks of a stated size, against all documents
        block = spark.sparkContext.broadcast(tuple((r.item_id, r.text) for r in numbered.where(F.col("part") == part).collect()))

        def run(batches, block=block):
            matcher = _matcher(block.value, similarity)
            for b in batches:
                rows, hits = [], []
                for i, hits_of in enumerate(matcher.match(text_of(b.column(b.num_columns - 1)))):
                    for hit in hits_of:
                        rows.append(i)
                        hits.append(hit)
                kept = pa.Table.from_batches([b]).take(pa.array(rows, pa.int64())).drop_columns([b.schema.names[-1]])
                cols = [kept.column(j).combine_chunks() for j in range(kept.num_columns)]
                item, share, where = zip(*hits) if hits else ((), (), ())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(item, item_type), pa.array(share, pa.float64()), pa.array(where, pa.int64())], names=[*kept.column_names, "item_id", "similarity", "start"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(items.schema["item_id"].dataType)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"item_id {kind}", "similarity double", "start long"])
        one = source.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    key = free_name(docs, "content_key")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    bad = written(find(keyed.select("doc_id", "text", key), benchmark, [key]).select(F.col(key).alias(f"{key}_bad")).distinct())
    return keyed.join(bad, F.col(key) == F.col(f"{key}_bad"), "left_anti").select(*docs.columns)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
