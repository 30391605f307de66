import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, key string, n int, counts string, kept string, failed int"


def frame(spark, rows):
    """Documents with columns whose names clash with what operators use inside; rows are (doc_id, text) or more."""
    full = [(i, t, *(r or ["en", "s"]), len(t or ""), "x", "y", 1, "z", "k", 0) for i, t, *r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empties, ties, repeated rows, near copies, and a long text."""
    a, b = words(1, 120), words(2, 300)
    near = list(a)
    near[60] = "changed"
    rows = [
        (1, " ".join(a)),
        (2, " ".join(near)),
        (3, " ".join(a)),
        (3, " ".join(a)),
        (4, " ".join(b) + "\n" + " ".join(words(3, 40)), None, None),
        (5, None),
        (6, ""),
        (7, "  \n\t "),
        (None, " ".join(words(4, 80)), "de", "s"),
        (8, "one two three"),
        (9, " ".join(words(5, 30_000))),
        (10, "Ümläute über alles, ça va? 漢字 " * 20, "fr", None),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [(1, "x")]).where("false")
