import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import frame, words
from tidewick.llm import licenses, packing, token_counts, tokens, toxicity

TEXTS = ["", "plain words", "  two  spaces\n\n and\ttabs ", "don't we'll I'M", "ü漢字🎉 12345 #$%", "<|endoftext|> is text", "a" * 5000, "x" * 100 + " " * 300, " ".join(words(1, 3000))]


def reference():
    t = Tokenizer.from_file(tokens.BYTE_BPE)
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_tokenizers_library():
    enc, ref, r = tokens.encoder(), reference(), random.Random(2)
    more = ["".join(r.choice(["a", "é", " ", "\n", "'s", "7", ".", "漢", " ", "\r", "!!", "the "]) for _ in range(60)) for _ in range(300)]
    for t in TEXTS + more:
        assert enc.encode_ordinary(t) == ref.encode(t, add_special_tokens=False).ids


def test_length_histogram(spark, docs, no_docs):
    n = sorted(len(reference().encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    rows = {r.length: r for r in token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs))).collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(n)
    for k, r in rows.items():
        assert r.docs_from == sum(x >= k for x in n) and r.tokens_from == sum(x for x in n if x >= k)
        assert r.truncated_total == sum(min(x, k) for x in n) and r.total_tokens == sum(n)
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs)))
    for r in token_counts.context_report(sums, [1, 100, 10**6]).collect():
        assert r.tokens_kept == sum(min(x, r.context_limit) for x in n) and r.docs_cut == sum(x > r.context_limit for x in n)
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(no_docs))).count() == 0


def test_packing(spark, docs, no_docs):
    rows = packing.pack(packing.pieces(docs)).collect()
    ref, want = reference(), Counter()
    for r in docs.collect():
        ids = np.array([*ref.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if k == 0 else s + 1024]
            want[r.doc_id, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert all(o == sum(n for _, n in s[:i]) for i, (o, _) in enumerate(s)) and sum(n for _, n in s) <= 1024
    assert packing.pack(packing.pieces(no_docs)).count() == 0


def check_plan(hist, limit=1024):
    runs, bins = packing.plan(hist, limit)
    fill, ranks = {}, Counter()
    for length, lo, hi, first, at in runs:
        ranks[length] += hi - lo
        for i in range(hi - lo):
            fill.setdefault(first + i, []).append((at, length))
    assert ranks == Counter(hist) and set(fill) == set(range(bins))
    for s in fill.values():
        s.sort()
        assert all(o == sum(n for _, n in s[:i]) for i, (o, _) in enumerate(s)) and sum(n for _, n in s) <= limit
    return bins


def test_plans_are_tight():
    r = np.random.default_rng(1)
    for hist in ({}, {1024: 3}, {1: 2000}, {600: 7, 400: 3, 30: 9}, Counter(map(int, r.integers(1, 1025, 4000))), Counter(map(int, r.integers(340, 420, 3000))), Counter(map(int, np.clip(r.lognormal(5.8, 0.8, 4000), 1, 1024)))):
        bins = check_plan(hist)
        assert bins <= 1.02 * packing.best_fit_count(hist) + 2


def test_toxicity(spark, no_docs):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = words(i, 60, 800)
        if i % 4 == 0:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["vile", "nasty", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0), 1))
    labels += [(None, 1, 1), (3, None, 1), (5, 0, 1)]
    rows += [(900, None), (901, ""), (None, "vile nasty"), (7, rows[7][1])]
    d, l = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    got = toxicity.score(d, toxicity.fit(d, l)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    held = [x for x in got if x.held_out and x.doc_id < 400]
    assert sum(x.predicted == (x.doc_id % 4 == 0) for x in held) >= 0.95 * len(held)
    flipped = spark.createDataFrame([(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in labels], "doc_id long, toxic int, text int")
    again = toxicity.score(d, toxicity.fit(d, flipped)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.score)
    assert sorted(map(key, again)) == sorted(map(key, got))  # held-out labels change nothing
    assert toxicity.score(no_docs, toxicity.fit(no_docs, l)).count() == 0
    assert {x.score for x in toxicity.score(d, toxicity.fit(d, l.where("false"))).collect()} == {0.5}


def test_ftrl_equals_a_plain_loop():
    """Every coordinate on its own, as the update is written."""
    r, p = np.random.default_rng(1), toxicity.Ftrl(alpha=0.7, beta=1.0, l1=0.3, l2=0.05)
    rows = [(np.unique(r.integers(0, 30, 8)).astype(np.int32), int(r.random() < 0.4)) for _ in range(200)]
    z, n, w = {}, {}, {}
    rate = lambda k: (p.beta + n.get(k, 0.0) ** 0.5) / p.alpha
    for _ in range(2):
        for at, y in rows:
            keys = [*at.tolist(), "bias"]
            for k in keys:
                zk = z.get(k, 0.0)
                l1, l2 = (0.0, 0.0) if k == "bias" else (p.l1, p.l2)
                w[k] = 0.0 if abs(zk) <= l1 else -(zk - (l1 if zk > 0 else -l1)) / (rate(k) + l2)
            g = 1 / (1 + np.exp(-sum(w[k] for k in keys))) - y
            for k in keys:
                before = rate(k)
                n[k] = n.get(k, 0.0) + g * g
                z[k] = z.get(k, 0.0) + g - (rate(k) - before) * w[k]
    at, weight, bias = toxicity.train(lambda: iter(rows), p, 2)
    want = {k: -(v - (p.l1 if v > 0 else -p.l1)) / (rate(k) + p.l2) for k, v in z.items() if k != "bias" and abs(v) > p.l1}
    assert sorted(want) == at.tolist() and np.allclose([want[k] for k in at.tolist()], weight) and np.isclose(bias, -z["bias"] / rate("bias"))


def test_toxicity_of_other_ids_and_long_texts(spark):
    """doc_id keeps its type; a very long text is scored whole: its one toxic word lies at the end."""
    rows = [(str(i), " ".join(words(i, 40, 600)) + (" vile" if i % 3 == 0 else "")) for i in range(300)] + [("long", " ".join(words(999, 60_000, 600)) + " vile")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    l = spark.createDataFrame([(str(i), int(i % 3 == 0)) for i in range(300)], "doc_id string, toxic int")
    got = toxicity.score(d, toxicity.fit(d, l))
    assert dict(got.dtypes)["doc_id"] == "string"
    by = {r.doc_id: r for r in got.collect()}
    assert by["long"].n_evidence >= by["3"].n_evidence > 0 and sum(by[str(i)].predicted == (i % 3 == 0) for i in range(300)) > 290


def test_licenses_against_brute_force(spark, tmp_path):
    """Every window of every group, every template, by sets; of windows that tie the first one counts."""
    T = list(licenses.TEMPLATES.items())
    r, rows = random.Random(3), []
    for n in range(60):
        name, t = T[n % len(T)]
        w = t.split()
        if n % 5 == 1 and len(w) > 12:
            w[r.randrange(len(w))] = "changed"
        if n % 5 == 2:
            w = w[: len(w) // 2]
        rows.append((n, " ".join(words(n, r.randrange(120)) + w + words(n + 500, r.randrange(80)) + (w if n % 5 == 3 else []))))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, t in rows:
        for g in licenses.Scanner(T).groups:
            s = licenses.shingle_hashes(licenses.word_hashes(t), g.k)
            for a in range(0, max(1, len(s) - g.span + g.step), g.step):
                for name, own in zip(g.names, g.sets):
                    share = float(np.isin(own, s[a : a + g.span]).mean())
                    if share >= licenses.CONTAINMENT and share > want.get((d, name), (0.0, 0))[0]:
                        want[d, name] = (share, a)
    got = {(x.doc_id, x.license_id): (x.containment, x.start) for x in licenses.op2_licenses(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 40
    with __import__("pytest").raises(ValueError, match="similarity"):
        licenses.band_rows(0.05)


def test_licenses(spark, docs, no_docs):
    T = licenses.TEMPLATES
    cut = T["gpl-notice"].split()
    rows = [(1, " ".join(words(1, 200) + T["apache-2.0"].split() + words(2, 90))), (2, T["mit"].upper()), (3, " ".join(words(3, 33) + cut[:36] + words(4, 50))), (4, " ".join(cut[:15] + words(5, 100))), (5, None), (6, ""), (7, " ".join(words(6, 5000))), (2, T["mit"])]
    got = Counter((r.doc_id, r.license_id) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == Counter({(1, "apache-2.0"): 1, (2, "mit"): 2, (3, "gpl-notice"): 1})
    assert licenses.scan(no_docs).count() == 0 and licenses.scan(docs, {"empty": "", "none": None}).count() == 0
    for g in licenses.Scanner(list(T.items())).groups:
        n = licenses.HASHES // g.rows
        least = min(licenses.least_similarity(len(s), g.span) for s in g.sets)
        assert 1 - (1 - least**g.rows) ** n >= licenses.CERTAIN


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert F is not None
