import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from tests.llm.conftest import frame, words
from tidewick.llm import divergence, mixing, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, node string, depth string, owner int, id string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "n", "d", 1, "i") for r in rows], TURNS)


# --- mixing -------------------------------------------------------------------------------------------------


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]


def water(by_source):
    """Targets by sharing the excess again, source by source."""
    names = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + ([None] if None in by_source else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(by_source.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(2 * by_source[s] for s in full)
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > 2 * by_source[s]}
        if not above:
            return {s: 2.0 * by_source[s] if s in full else weight[s] * level for s in names}
        full |= above


def check_mix(rows, spark):
    docs = frame(spark, rows)
    got = mixing.planned(docs).collect()
    n, by_source = sizes(rows), Counter()
    for (_, _, _, s), k in zip(rows, n):
        by_source[s] += k
    goal = water(by_source)
    assert sorted((r.doc_id is None, r.doc_id, r.mix.size) for r in got) == sorted((i is None, i, k) for (i, *_), k in zip(rows, n))
    taken = Counter()
    for r in got:
        assert r.mix.source_size == by_source[r.source] and abs(r.mix.target - goal[r.source]) <= 1e-6 * max(1, goal[r.source])
        rate = r.mix.target / r.mix.source_size if r.mix.source_size else 0
        assert r.mix.copies in (int(rate), int(rate) + 1) and r.mix.copies <= 2
        taken[r.source] += r.mix.size * r.mix.copies
    again = mixing.planned(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mixture(docs).count() == sum(r.mix.copies for r in got) and mixing.mixture(docs).columns == docs.columns
    return goal, taken


def test_mix_targets_and_draws(spark, no_docs):
    r = random.Random(5)
    rows = [(i, " ".join(words(i, r.randrange(20, 60))), "en", s) for i, s in enumerate(["hot"] * 900 + ["b"] * 500 + ["Ä"] * 300 + ["a"] * 40 + [None] * 60)]
    goal, taken = check_mix(rows, spark)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.15 * goal[s], (s, taken[s], goal[s])
    assert mixing.planned(no_docs).count() == 0


def test_mix_of_odd_rows(spark):
    check_mix([(1, None, "en", "a"), (1, None, "en", "a"), (None, "x y", "en", None), (2, "", None, "b"), (3, "q " * 30_000, "en", "c"), (4, "one", "en", "c\u0000"), (5, "    \x1c", "en", "")], spark)
    check_mix([(1, None, "en", "a"), (2, "", "en", None)], spark)


def test_mix_of_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(words(i, 5)), "en", f"s{i % 40}") for i in range(400)]
    want = sorted(map(str, mixing.planned(frame(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 3)
    assert sorted(map(str, mixing.planned(frame(spark, rows)).collect())) == want


# --- trie ---------------------------------------------------------------------------------------------------


def brute_trie(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    talk = {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c, t in talk.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(talk[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def same_trie(spark, rows):
    got = [tuple(r) for r in prefix_trie.trie(talks(spark, rows)).collect()]
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(brute_trie(rows), key=key)


def test_trie_equals_brute_force(spark):
    r = random.Random(7)
    rows = []
    for c in [*range(0, 40), 103, 104, 207, 1_000_000_001]:  # some families lack their first conversation
        for t in range(r.choice([1, 2, 3, 6, 12])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "b", "ça", "漢字"])))
    rows += [(41, None, None, "x"), (41, 2, "user", None), (41, 2, "user", None), (41, 2, "user", "tie"), (41, -1, "", ""), (None, 1, "user", "nobody's")]
    same_trie(spark, rows)


def test_trie_of_nested_chains_and_copies(spark):
    """Each conversation leaves the last one's path a turn later; many are equal; one holds most rows."""
    path = [("user" if i % 2 else "bot", f"turn {i}") for i in range(40)]
    rows = []
    for j in range(12):
        c = 5 * j
        rows += [(c, i, *x) for i, x in enumerate(path[: 12 + j] + [("bot", f"own {j}")])]
    for c in range(100, 160, 5):
        rows += [(c, i, *x) for i, x in enumerate(path[:20])]
    rows += [(1000, i, *path[i % 40]) for i in range(1500)]
    same_trie(spark, rows)


def test_trie_of_nothing_and_of_turnless(spark):
    assert prefix_trie.trie(talks(spark, [(1, 0, "user", "x")]).where("false")).count() == 0
    lone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    same_trie(spark, [(lone, 0, "user", "x"), (5000, 0, "user", "y")])


# --- divergence ---------------------------------------------------------------------------------------------


def brute_audit(rows, least=10, top=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))) for _, t, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        held = Counter(t for x, _, f in docs if x == lang for t in set(f))
        vocab = {t for t, k in held.items() if k >= least}
        count = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, f in docs:
            if x == lang:
                count[s].update(t for t in f if t in vocab)
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(vocab)) for t in vocab}
        p, q = {s: shares(c) for s, c in count.items()}, shares(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in vocab), o.encode()) for o in count if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in vocab if count[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return out


def test_audit_equals_brute_force(spark, docs, no_docs):
    r = random.Random(9)
    vocab = ["Äpfel", "äpfel", "ÇA", "the", "The", "of", "漢字", "z"] + words(1, 30, 60)
    rows = [(i, " ".join(r.choices(vocab, k=r.randrange(0, 40))) + r.choice(["", "!x2y", "\x7f", "\n"]), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "É", None])) for i in range(240)]
    rows += [(900, None, "en", "silent"), (901, "only once", "fr", "a"), (902, "q", "fr", "b"), (903, "q" * 5000 + " the" * 20_000, "en", "a")]
    rows += [(904, "tie one two", "tt", s) for s in ("x", "y", "z") for _ in range(5)]
    got = [tuple(x) for x in divergence.audit(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_audit(rows))
    assert divergence.audit(no_docs).count() == 0
    assert {x.part for x in divergence.audit(docs).collect()} <= {"pair", "term"}


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(9 * 10**14, 9 * 10**14, 10**6), (123_456_789_012_345, 876_543_210_987_654, 7), (0, 0, 1), (5, 5, 1), (10**15, 3 * 10**15, 10**9)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [x[0] for x in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]
