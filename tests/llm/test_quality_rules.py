import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import frame, words
from tidewick.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated)


def test_counts_are_exact():
    r = random.Random(3)
    for _ in range(200):
        t = "".join(r.choice(["a ", "b ", "é", "\n", "\t", "#", "|x ", "\x0b", "a b c ", " ", "\x1c"]) for _ in range(r.randrange(80)))
        assert Q.text_counts(t)[:5] == brute(t)


def test_verdicts(spark, docs, no_docs):
    rows = Q.quality_verdicts(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert not by[5].kept and by[5].base_failed and by[6].base_failed and by[8].base_failed
    assert by[1].kept and by[9].kept and by[4].kept
    assert Q.quality_verdicts(no_docs).count() == 0
    kept = Q.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted((r.doc_id is None, r.doc_id) for r in rows if r.kept)
    assert Q.quality_filter(no_docs).count() == 0


def test_cutoffs_follow_the_corpus(spark):
    clean = [(i, " ".join(words(i, 100))) for i in range(300)]
    noisy = [(1000 + i, " ".join(f"{w}###" for w in words(i, 100))) for i in range(10)]
    normal_there = [(2000 + i, " ".join(f"{w}#" for w in words(i, 100)), "en", "markup") for i in range(300)]
    v = {r.doc_id: r for r in Q.quality_verdicts(frame(spark, clean + noisy + normal_there)).collect()}
    assert all(v[i].kept for i, *_ in clean + normal_there)
    assert not any(v[i].kept for i, *_ in noisy)
    assert "symbol_ratio" in v[1000].failed


def test_cutoffs_follow_the_spread(spark):
    r = random.Random(5)
    # two sources alike in their middle; in one, punctuation and repeats scatter widely, in the other hardly
    marked = lambda i, share: " ".join(w + "," if r.random() < share else w for w in words(i, 300))
    again = lambda i, n: " ".join([*words(i, 300), *words(i, n)])
    even = [(i, marked(i, 0.1), "en", "even") for i in range(300)]
    wide = [(1000 + i, marked(i, 0.2 * r.random()), "en", "wide") for i in range(300)]
    few = [(2000 + i, again(i, 6 + i % 4), "de", "few") for i in range(300)]
    many = [(3000 + i, again(i, 6 + i % 60), "de", "many") for i in range(300)]
    odd = [(5000, marked(1, 0.33), "en", "even"), (5001, marked(1, 0.33), "en", "wide"), (5002, again(1, 70), "de", "few"), (5003, again(1, 70), "de", "many")]
    v = {x.doc_id: x for x in Q.quality_verdicts(frame(spark, even + wide + few + many + odd)).collect()}
    assert [v[i].failed for i in (5000, 5001, 5002, 5003)] == [["punct_ratio"], [], ["repeat_ratio"], []]
    assert all(v[i].kept for i, *_ in even + wide + few + many)
    assert not any(v[i].base_failed for i in v)


def test_sketch_quantiles_are_close_and_merge(spark):
    values = sorted(random.Random(1).lognormvariate(0, 2) for _ in range(5000))
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    log_gamma = __import__("math").log((1 + Q.ACCURACY) / (1 - Q.ACCURACY))
    s = rows.select(F.lit("f").alias("feature"), F.ceil(F.log("v") / log_gamma).cast("int").alias("bucket")).groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("n"))
    q = Q.quantiles(s, ["feature"], {"q": 0.9}).first().q
    assert abs(q / values[4499] - 1) < 2.5 * Q.ACCURACY


def test_a_cell_that_grows_changes_its_cutoffs_bit_by_bit(spark):
    """One more row, from 199 to 200 or from 49 to 50, moves no cutoff by much, and cutoffs differ by cell."""
    r = random.Random(8)
    marked = lambda i, share: " ".join(w + ("," if r.random() < share else " %" if r.random() < share / 4 else "") for w in words(i, 200))
    big = [(i, marked(i, 0.05 + 0.02 * r.random()), "en", "big") for i in range(250)]
    small = [(1000 + i, marked(i, 0.15 + 0.02 * r.random()), "en", "small") for i in range(201)]
    rows = Q.annotate(frame(spark, big + small).select("doc_id", "lang", "source", "text"), keep=["doc_id", "lang", "source"]).cache()
    cuts = {}
    for n in (49, 50, 199, 200, 201):
        for c in Q.cutoffs(Q.sketch(rows.where(F.col("doc_id") < 1000 + n))).collect():
            cuts[c.source, n] = c
    for a, b in ((49, 50), (199, 200), (200, 201)):
        for f in ("punct_ratio_hi", "symbol_ratio_hi", "word_length_hi"):
            x, y = cuts["small", a][f], cuts["small", b][f]
            assert abs(x - y) <= 0.1 * max(x, y), (f, a, x, y)
    assert cuts["small", 200].punct_ratio_hi > 1.3 * cuts["big", 200].punct_ratio_hi and cuts["small", 200].symbol_ratio_hi != cuts["big", 200].symbol_ratio_hi
