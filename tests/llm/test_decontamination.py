from collections import Counter

import numpy as np

from tests.llm.conftest import frame, words
from tidewick.llm import _common as C
from tidewick.llm import decontamination as D
from tidewick.llm._common import shingle_hashes, word_hashes


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, start string")


def test_finds_planted_items(spark, docs, no_docs):
    items = [(i, " ".join(words(100 + i, n))) for i, n in enumerate((6, 20, 33, 48, 90))] + [(50, None), (51, ""), (52, "two words"), (1, " ".join(words(101, 20)))]
    hosts = [(100 + i, " ".join(words(200 + i, 400)[:137] + t.split() + words(300 + i, 50))) for i, t in items[:5]]
    edited = items[3][1].split()
    edited[20] = "edited"
    rows = [*hosts, (200, " ".join(words(7, 90) + edited + words(8, 90))), (201, items[2][1].upper() + "!"), (202, " ".join(words(9, 500))), (203, None), (204, ""), (205, " ".join(words(9, 60) + items[4][1].split()[:45]))]
    got = {(r.doc_id, r.item_id) for r in D.find(frame(spark, rows), bench(spark, [(*x, "s") for x in items]), ["doc_id"]).collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (103, 3), (104, 4), (200, 3), (201, 2)}
    clean = D.decontaminate(frame(spark, rows), bench(spark, [(*x, "s") for x in items]))
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [202, 203, 204, 205]
    assert D.find(no_docs, bench(spark, [(*x, "s") for x in items]), ["doc_id"]).count() == 0
    assert D.find(docs, bench(spark, [(1, "x", "s")]).where("false"), ["doc_id"]).count() == 0


def test_index_returns_all_within_radius():
    r = np.random.default_rng(2)
    prints = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    index = D.Index(prints, np.zeros(40, np.int64))
    windows = []
    for k in range(64):
        mask = np.uint64(sum(1 << int(i) for i in r.choice(64, k % 24, replace=False)))
        windows.append(prints[k % 40] ^ mask)
    windows = np.array(windows, np.uint64)
    got = set(zip(*(x.tolist() for x in index.search(windows, np.zeros(64, np.int64)))))
    want = {(i, j) for i in range(64) for j in range(40) if int(windows[i] ^ prints[j]).bit_count() <= D.RADIUS}
    assert got == want


def test_index_where_values_list_many_parts(monkeypatch):
    """Lists longer than what is compared at once, parts beyond the numbered ones, several classes, and no parts at all."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = [sum(1 << int(i) for i in r.choice(64, n % 12, replace=False)) for n in range(90)]
    prints = np.array([base[n % 3] ^ np.uint64(f) for n, f in enumerate(flips)], np.uint64)
    classes = np.arange(90) // 45
    windows = np.array([prints[n % 90] ^ np.uint64(sum(1 << int(i) for i in r.choice(64, n % 20, replace=False))) for n in range(200)], np.uint64)
    want = {(i, j) for i in range(200) for j in range(90) if classes[j] == i % 2 and int(windows[i] ^ prints[j]).bit_count() <= D.RADIUS}
    for numbered in (D.Index.NUMBERED, 7, 0):
        monkeypatch.setattr(D.Index, "NUMBERED", numbered)
        got = D.Index(prints, classes).search(windows, np.arange(200) % 2 << 16)
        assert len(got[0]) == len(want) and set(zip(*(x.tolist() for x in got))) == want
    assert not len(D.Index(prints[:0], classes[:0]).search(windows, np.zeros(200, np.int64))[0])


def test_what_is_near_by_chance_costs_little(monkeypatch):
    """Windows within the radius by chance don't have their texts' shingles made one text after the other."""
    items = [(i, " ".join(words(i, 20 + i % 40))) for i in range(150)]
    texts = [" ".join(words(1000 + n, 400)) for n in range(120)] + [" ".join(words(2000, 200) + items[3][1].split() + words(2001, 200))]
    m, made, near = D.Matcher(items), [], []
    search, shingles = m.index.search, D.shingle_hashes_of
    monkeypatch.setattr(m.index, "search", lambda *x: near.append(search(*x)) or near[-1])
    monkeypatch.setattr(D, "shingle_hashes_of", lambda *x: made.append(1) or shingles(*x))
    assert [[h[0] for h in x] for x in m.match(texts)] == [[]] * 120 + [[3]]
    assert sum(len(x[0]) for x in near) > 100 and len(made) < 12


def test_texts_hashed_together_are_hashed_alike():
    """A word's hash is that of its bytes by place, whatever stands around it."""
    r = np.random.default_rng(6)
    pieces = ["a", "Wort", "7", "w" * 63, "x" * 64, "y" * 65, "Z" * 5000, "\u00dcber", "\u6f22\u5b57", "\u0130x", "\ud800", " ", "  ", "\n", ", ", "-" * 90]
    texts = ["", " ", "..", *("".join(pieces[i] for i in r.integers(0, len(pieces), int(n))) for n in r.integers(0, 40, 60)), ""]
    texts += ["".join(p + " " for p in pieces if len(p) < 60) for _ in range(3)]

    def plain(text):
        out, run = [], []
        for c in [*text.lower().encode("utf-8", "surrogatepass"), 32]:
            if c > 127 or chr(c).isalnum():
                run.append(c)
            elif run:
                out.append((sum(int(C._BYTE[x]) * int(C._PLACE[j & 0xFFF]) for j, x in enumerate(run)) + len(run)) % (1 << 64))
                run = []
        return C.mix(np.array(out, np.uint64)).tolist()

    assert [x.tolist() for x in C.word_hashes_of(texts)] == [plain(t) for t in texts] == [word_hashes(t).tolist() for t in texts]
    got = {i: (w.tolist(), p.tolist()) for i, w, p in D.hashed(texts)}
    assert got == {i: (plain(t), D.pair_hashes(word_hashes(t)).tolist()) for i, t in enumerate(texts)} and not list(D.hashed([]))


def test_agrees_with_brute_force():
    items = [(i, " ".join(words(i, 25 + i))) for i in range(12)]
    texts = [" ".join(words(50 + i, 200) + items[i % 12][1].split()[: 10 + 3 * i] + words(80 + i, 100)) for i in range(20)]
    m = D.Matcher(items)
    for t, hits in zip(texts, m.match(texts)):
        s = set(shingle_hashes(word_hashes(t)).tolist())
        want = {i for i, x in items if len(set(shingle_hashes(word_hashes(x)).tolist()) & s) >= 0.8 * len(set(shingle_hashes(word_hashes(x)).tolist()))}
        assert {h[0] for h in hits} == want


def brute(text, item):
    """The best weighted share of the item's shingles in an item-sized window of the text."""
    size = min(5, len(item.split()))
    need, have = shingle_hashes(word_hashes(item), size), shingle_hashes(word_hashes(text), size)
    if not len(need) or not np.isin(have, need).any():
        return 0.0
    have, need = have.tolist(), need.tolist()
    return max(sum((Counter(have[a : a + len(need)]) & Counter(need)).values()) for a in range(max(1, len(have) - len(need) + 1))) / len(need)


def damaged(w, kind, lost, r):
    """Words of an item of which about so many shingles are lost: at an end, at both, in one stretch, or here and there."""
    w = list(w)
    if kind == "head":
        return w[lost:]
    if kind == "tail":
        return w[: len(w) - lost]
    if kind == "both":
        a = int(r.integers(0, lost + 1))
        return w[a : len(w) - (lost - a)]
    if kind == "stretch":
        n = max(1, lost - 4)
        at = int(r.integers(1, max(2, len(w) - n)))
        return w[:at] + [f"s{j}" for j in r.integers(0, 10**6, n)] + w[at + n :]
    for at in r.choice(np.arange(2, len(w) - 2), max(1, lost // 5), replace=False):
        w[at] = f"e{r.integers(0, 10**6)}"
    return w


def test_recall_of_passages_at_the_limit():
    """Passages that keep 0.80 to 0.85 of an item's shingles, damaged in every way: SimHash alone finds them, and nothing else."""
    r = np.random.default_rng(4)
    items = [(i, " ".join(words(i, int(n)))) for i, n in enumerate(r.integers(14, 160, 80))]
    m = D.Matcher(items)
    wanted = Counter()
    missed = Counter()
    for n in range(1500):
        i, kind = n % 80, ("head", "tail", "both", "stretch", "spread")[n % 5]
        w = items[i][1].split()
        lost = int((len(w) - 4) * (0.15 + 0.05 * r.random()))
        text = " ".join(words(1000 + n, int(r.integers(0, 90))) + damaged(w, kind, lost, r) + words(9000 + n, int(r.integers(0, 90))))
        share = brute(text, items[i][1])
        found = {h[0]: h[1] for h in m.match([text])[0]}
        assert set(found) <= {i} and all(abs(x - share) < 1e-9 for x in found.values())
        if share >= 0.8:
            wanted[kind] += 1
            missed[kind] += i not in found
        else:
            assert not found
    assert all(wanted[k] > 40 for k in ("head", "tail", "both", "stretch", "spread")) and sum(wanted.values()) > 900
    assert sum(missed.values()) <= 0.01 * sum(wanted.values()), (missed, wanted)


def test_whatever_precedes_a_text():
    items = [(i, " ".join(words(i, 20 + 3 * i))) for i in range(20)]
    texts = [" ".join(words(300 + n, 17 * n) + items[n][1].split()[n % 3 :] + words(600 + n, 40)) for n in range(20)] + ["", "one"]
    m = D.Matcher(items)
    assert [m.match([t])[0] for t in texts] == m.match(texts) and all(len(x) == 1 for x in m.match(texts)[:20])


def test_retrieval_is_the_fingerprints(monkeypatch):
    """Without windows within the radius nothing is found: there is no other way in."""
    items = [(1, " ".join(words(1, 40)))]
    assert D.Matcher(items).match([items[0][1]])[0]
    m = D.Matcher(items)
    monkeypatch.setattr(m.index, "search", lambda *_: (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert m.match([items[0][1]]) == [[]]


def test_a_very_long_text_and_repeated_ones():
    items = [(i, " ".join(words(i, 40))) for i in range(5)]
    text = " ".join(words(50, 120_000) + items[1][1].split() + words(51, 60_000) + items[1][1].split() + items[3][1].split())
    hits = D.Matcher(items).match([text, text, items[1][1]])
    assert [[h[0] for h in x] for x in hits] == [[1, 3], [1, 3], [1]] and hits[0][0][2] == 120_000


def test_fingerprints_of_windows_are_those_of_their_words():
    """Whatever the counters' width: a window's fingerprint from prefix sums is its words' own."""
    for longest in (30, 100, 200, 70_000):
        m = D.Matcher([(0, " ".join(words(1, 20))), (1, " ".join(words(2, longest)))])
        w = word_hashes(" ".join(words(3, 300)))
        pairs = D.pair_hashes(w)
        part = D._bits(pairs).astype(m.counter, copy=False).view(np.uint64)
        ones = np.concatenate([np.zeros((1, part.shape[1]), np.uint64), np.cumsum(part, axis=0)])
        starts, classes, prints = m.windows([len(pairs)], ones)
        for s, c, p in zip(starts.tolist(), classes.tolist(), prints.tolist()):
            e = min(len(pairs), s + m.classes[c >> 16][0])
            assert p == D.fingerprint(w[s : e + 1])


def test_query_against_weighted_brute_force(spark, tmp_path):
    """Items whose shingles repeat, in windows of the item's size: every item in every text, by counting."""
    r = np.random.default_rng(7)
    items = [(i, " ".join(f"v{x}" for x in r.integers(0, 4, 12 + 4 * i))) for i in range(6)] + [(10, " ".join(words(3, 30))), (11, "a b c")]
    texts = []
    for n in range(40):
        host, item = [f"v{x}" for x in r.integers(0, 4, 60)], items[n % len(items)][1].split()
        for j in r.integers(0, len(item), n % 3):
            item[j] = "edit"
        texts.append((n, " ".join(host[:20] + item + host[20:]) if n % 4 else " ".join(host)))
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, [(*x, "s") for x in items]).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for d, t in texts:
        for k, x in items:
            size = min(5, len(x.split()))
            need, have = shingle_hashes(word_hashes(x), size).tolist(), shingle_hashes(word_hashes(t), size).tolist()
            best = max(sum((Counter(have[a : a + len(need)]) & Counter(need)).values()) for a in range(max(1, len(have) - len(need) + 1)))
            if best >= 0.8 * len(need):
                want.add((d, k))
    assert {(x.doc_id, x.item_id) for x in D.op6_decontamination(spark, str(tmp_path)).collect()} == want and len(want) > 10
