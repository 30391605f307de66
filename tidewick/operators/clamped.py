"""Sums that are held within bounds after every step, folded in order without a group's rows ever meeting.

"Add d, then hold within [low, high]" is a function x -> max(lo, min(hi, x + shift)), and two of these in a row are again one. So
a run of steps is a triple (lo, hi, shift) however long it is: rows are dealt by (group, block of the order), each block
streams through its task into one triple, and the few triples of a group are composed in order the same way. A group that all rows hit is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: places in the order that one block spans
BLOCK = 4096


def compose(lo: np.ndarray, hi: np.ndarray, shift: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One triple for each run of rows, which begin at ``starts``: neighbours are composed in pairs until each run is one."""
    while len(lo) > len(starts):
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(lo))))
        first = (np.arange(len(lo)) - starts[run]) % 2 == 0
        i = np.flatnonzero(first)
        j = np.minimum(i + 1, len(lo) - 1)
        two = (i + 1 < len(lo)) & (run[j] == run[i])
        a, b = i[two], j[two]
        lo2, hi2, shift2 = lo[i].copy(), hi[i].copy(), shift[i].copy()
        for out, x in ((lo2, lo[a]), (hi2, hi[a])):
            out[two] = np.maximum(lo[b], np.minimum(hi[b], x + shift[b]))
        shift2[two] = shift[a] + shift[b]
        starts = np.flatnonzero(np.diff(run[i], prepend=-1))
        lo, hi, shift = lo2, hi2, shift2
    return lo, hi, shift


def prefixes(shift: np.ndarray, starts: np.ndarray, first: np.ndarray, low: float, high: float) -> np.ndarray:
    """The value after each step, for runs that begin at ``starts`` with the values ``first``: doubling over distances, no loop over steps."""
    n = len(shift)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    lo, hi, shift = np.full(n, low), np.full(n, high), shift.astype(float)
    step = 1
    while n and step <= place.max():
        b = np.flatnonzero(place >= step)
        a = b - step
        lo2, hi2 = (np.maximum(lo[b], np.minimum(hi[b], x[a] + shift[b])) for x in (lo, hi))
        shift[b] = shift[a] + shift[b]
        lo[b], hi[b] = lo2, hi2
        step *= 2
    return np.maximum(lo, np.minimum(hi, np.repeat(first, np.diff(np.append(starts, n))) + shift))


def _runs(keys: list[pa.Array], n: int) -> np.ndarray:
    """Where the rows' keys differ from the row before; nulls are equal to one another."""
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        a, b = k.slice(1), k.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        new[1:] |= pc.or_(differs, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _composed(n_keys: int):
    """Stream rows (keys, order, lo, hi, shift) that come sorted into one triple for each run of equal keys, with the order of its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last run of the batch before may go on
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            column = lambda i: t.column(i).chunk(0)  # noqa: E731, B023
            starts = _runs([column(i) for i in range(n_keys)], t.num_rows)
            lo, hi, shift = compose(*(column(n_keys + i).to_numpy() for i in (1, 2, 3)), starts)
            at = pa.array(starts)
            out = pa.table([*(column(i).take(at) for i in range(n_keys + 1)), pa.array(lo), pa.array(hi), pa.array(shift)], schema=t.schema)
            held = out.slice(out.num_rows - 1)
            yield from out.slice(0, out.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return run


def _pass(rows: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, "fold_at", "fold_lo", "fold_hi", "fold_shift"]
    sorted_rows = rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, "fold_at")
    return sorted_rows.mapInArrow(_composed(len(keys)), StructType([sorted_rows.schema[n] for n in names]))


def fold(rows: DataFrame, by: list[str], order: Column, delta: Column, low: float, high: float, name: str, block: int = BLOCK) -> DataFrame:
    """(by, ``name``): from 0, deltas added in order and held within [low, high] after each. A null delta is no step; rows of equal order follow one another in any order."""
    at = order.cast("long")
    steps = rows.select(*by, F.floor(at / block).alias("fold_block"), at.alias("fold_at"), F.lit(float(low)).alias("fold_lo"), F.lit(float(high)).alias("fold_hi"), delta.cast("double").alias("fold_shift"))
    whole = _pass(_pass(steps.where(F.col("fold_shift").isNotNull()), [*by, "fold_block"]), by)
    return whole.select(*by, F.greatest(F.col("fold_lo"), F.least(F.col("fold_hi"), F.col("fold_shift"))).alias(name))
