import random
from collections import Counter

import numpy as np

from tests.llm.conftest import frame, words
from tidewick.llm import jaccard_join as J


def brute(rows):
    sets = [(d, set(J.shingle_set(t or "").tolist())) for d, t in rows]
    links, up = Counter(), list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min([x for x in (least.get(top(i)), d) if x is not None], default=None)
    return sorted(((d is None, d or 0), least[top(i)], links[i]) for i, (d, _) in enumerate(sets))


def near_copies(seed, base, many):
    r, out = random.Random(seed), []
    for i in range(many):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        out.append(" ".join(w))
    return out


def test_links_and_classes(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = J.near_groups(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.class_id, r.n_links) for r in got) == brute(rows)
    assert J.near_groups(no_docs).count() == 0


def test_large_groups_go_by_blocks(spark):
    """More near copies than a bucket is expanded for, beside small groups and copies."""
    texts = near_copies(1, words(1, 150), 180) + near_copies(2, words(2, 100), 12) + [" ".join(words(s, 60)) for s in range(20, 40)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:5])]
    got = J.near_groups(frame(spark, rows)).collect()
    assert sorted(((False, r.doc_id), r.class_id, r.n_links) for r in got) == brute(rows)


def test_one_of_each_group_stays(spark, docs, no_docs):
    kept = J.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert J.drop_near_duplicates(no_docs).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    r = np.random.default_rng(1)
    for _ in range(20):
        common = r.integers(0, 1 << 63, 90, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, 10, dtype=np.uint64)])) for _ in range(2))
        far = np.unique(r.integers(0, 1 << 63, 100, dtype=np.uint64))
        sig = np.stack([J.minhash(x) for x in (a, a)]), np.stack([J.minhash(x) for x in (b, far)])
        assert J.survivors(*sig).tolist() == [0]
    assert (np.diff(J.least_matches()) >= 0).all()
