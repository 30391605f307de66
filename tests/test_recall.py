"""Recall holds a bounded number of similarities."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidewick.operators import memory


def test_a_block_of_queries_against_a_batch_takes_little_memory():
    r = np.random.default_rng(1)
    q, v = r.standard_normal((2048, 16)), r.standard_normal((10_000, 16))
    v[100:200] = v[0]  # ties
    by_id = r.permutation(len(v))
    tracemalloc.start()
    n = 0
    for row, at, s in memory._nearest(q, v, by_id, 6):
        n += len(row)
        if row[0] == 0:
            away = -(q[:3] @ v.T)
            for k in range(3):
                assert at[row == k].tolist() == np.lexsort((by_id, away[k]))[:6].tolist()
                assert np.allclose(s[row == k], -np.sort(away[k])[:6])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6 * 2048
    assert peak < 64e6  # all similarities at once were 164 MB, and as much again for each step of sorting them


def test_vectors_that_are_not_finite_and_few_records():
    q, v = np.array([[1.0, 0.0]]), np.array([[0.5, 0.0], [np.nan, 0.0], [0.7, 0.0]])
    for most in (2, 3, 9):
        ((row, at, s),) = memory._nearest(q, v, np.arange(3), most)
        assert at.tolist() == [2, 0, 1][:most]


def test_recall_of_lists_of_other_lengths_is_refused():
    with pytest.raises(ValueError):
        memory._unit(pa.array([[1.0, 2.0], [1.0]]))
    assert memory._unit(pa.array([[3.0, 4.0], [0.0, 0.0]])).tolist() == [[0.6, 0.8], [0.0, 0.0]]
