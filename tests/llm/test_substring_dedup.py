import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import frame, words
from tidewick.llm import substring_dedup as S


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if count[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        left = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(g and not p for g, p in zip(gone, b"\x00" + bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def check(spark, rows):
    got = S.deduplicate(frame(spark, rows)).collect()
    want = brute([t for _, t in rows])
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got)) == sorted(key((d, *w)) for (d, _), w in zip(rows, want))
    return want


def test_against_brute_force(spark, no_docs):
    r = random.Random(1)
    shared = " ".join(words(1, 80))
    rows = [(i, " ".join(words(10 + i, r.randrange(5, 120))) + " " + shared[r.randrange(40) : len(shared) - r.randrange(40)] + " ".join(words(90 + i, 30))) for i in range(30)]
    rows += [(100, "a" * 1000), (101, "ab" * 300), (102, "ü" * 150), (103, None), (104, ""), (105, "x" * 199), (106, shared), (106, shared), (None, shared[:210]), (107, shared * 3), (108, "b" * 200), (109, "b" * 200)]
    want = check(spark, rows)
    assert sum(w[1] for w in want) > 5000
    assert S.deduplicate(no_docs).count() == 0


@pytest.mark.parametrize("hot", [10, 10_000])
def test_hot_passage_and_many_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_ROWS", hot)
    shared = " ".join(words(1, 60))
    rows = [(i, " ".join(words(1000 + i, 12)) + " " + shared + " " + " ".join(words(5000 + i, 12))) for i in range(150)] + [(500 + i, " ".join(words(3, 70))) for i in range(40)]
    check(spark, rows)


def test_many_repeated_rows(spark):
    """10,000 equal rows, and some of the same text with other ids."""
    t = " ".join(words(3, 60))
    rows = [(1, t)] * 10_000 + [(2, t), (3, t + " tail"), (4, " ".join(words(9, 80)))]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicate(frame(spark, rows)).collect())
    want = brute([t, t, t + " tail", rows[-1][1]])
    assert got == Counter({(1, *want[0]): 10_000, (2, *want[1]): 1, (3, *want[2]): 1, (4, *want[3]): 1})


def test_stretches_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 1000)  # in the driver's own process only: the kernel is called here
    t = " ".join(words(4, 2000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([zlib.compress(t.encode())])], names=["key", "packed"])
    at, before, more = S._runs(next(S._anchor_rows([batch])).column("spot").to_numpy())
    covered = sorted(zip((at - before).tolist(), (at - before + more).tolist()))
    assert covered[0][0] == 0 and covered[-1][1] == len(t) - 200
    assert all(e + 1 == s for (_, e), (s, _) in zip(covered, covered[1:]))


def test_multikey_order():
    r = np.random.default_rng(1)
    grams = np.frombuffer(r.choice([b"ab", b"\xff\x00", b"zz"], (500, 16)).tobytes(), np.uint8)
    w = S.words_of(grams, np.arange(500) * 32)
    order = S.multikey(list(w.T))
    rows = [grams[32 * i : 32 * i + 32].tobytes() for i in range(500)]
    assert [rows[i] for i in order] == sorted(rows)
    assert S.multikey([np.empty(0, np.int64)]).tolist() == []


def test_equal_hashes_of_unequal_windows(monkeypatch):
    """Bytes decide, even where every window has the same hash."""
    monkeypatch.setattr(S.Hashes, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    a, b = (" ".join(words(i, 60)).encode()[:200] for i in (1, 2))
    flat = np.frombuffer(a + b + a + a + b, np.uint8)
    order, same = S.equal_windows(flat, np.arange(5) * 200)
    assert sorted(order.tolist()) == list(range(5)) and same.sum() == 3
    kinds = [i in (0, 2, 3) for i in order]
    assert same.tolist() == [x == y for x, y in zip(kinds, kinds[1:])] + [False]
