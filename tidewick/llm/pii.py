"""Personal data: high-recall candidates, boosted trees over format and context, calibrated thresholds.

DataFrame functions only. Generators propose overlapping spans per kind: the four base patterns before
their checks, looser forms of them (local phone numbers, obfuscated addresses), and secrets (opaque
tokens, values given to names such as password). Matches that pass the base checks (parts of an IP
address, Luhn's digit, digit counts) are always spans. The rest are judged by gradient boosted trees:
features are a candidate's kind and small integers for its format and context.

Labels never come from what the features say. A base pattern's match is positive if a base-valid match of
its kind covers it; features don't hold the outcome of a check. An opaque token is positive if it is given
to a name that says so, which is no feature of it, and negative if it is a word (letters only). All other
candidates have no label: a looser form can't pass a base check, and a token without a name may be either.
They are no examples, and are scored by what labelled ones of like format and context turned out to be,
against thresholds that hold for those.

As the features have few values, training needs only counts by feature vector (at most ``VECTORS``, by
their ranges), aggregated over the whole corpus; the trees become column expressions. For each kind the
threshold is the lowest score at which held-out candidates reach ``PRECISION``; where none does, nothing
is added.

Positions are code points. They come from the lengths of the pieces between matches and of the matches.

Patterns are equal to the stated ones but can't run out of stack or time: runs are possessive, and a
match can only begin where the run before it does, or where the last match ended.

Defined cases: null text is empty and has no spans; repeated rows have equal spans; without candidates to
learn from nothing is added; an empty table gives an empty result; extra columns are kept by ``redact``
and ignored by ``find``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, row_key, written

KINDS = ["email", "ip", "card", "phone", "secret"]
#: the kinds that have a base pattern
BASE_KINDS = KINDS[:4]
PRECISION = 0.95
ROUNDS, DEPTH, RATE = 30, 3, 0.3
CALIBRATION_LEAST = 20

#: fixed values: the base patterns
_PART = "(?=[0-9])0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# a maximal run of 12 to 19 digits: shorter and longer ones fail the base check anyway
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: looser forms
_LOCAL_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
_SPELLED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}){1,5}"
#: opaque tokens, and values given to a name
_TOKEN = r"(?<![A-Za-z0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+"
_NAMES = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|credential|(?:api|access|auth|private)[_-]?key)[\"']? ?[=:] ?[\"']?"
_GIVEN = rf"(?<={_NAMES})[^\s\"',;=:<>]{{6,128}}"
#: words before a candidate that speak for it
_CUES = r"(?i)(?:e-?mail|mail|tel|phone|call|mobile|fax|card|visa|iban|account|ip|host|server|address|contact)[^A-Za-z]{0,4}$"
#: (kind, pattern, what a text must match for it to be worth running, whether a base pattern)
_GENERATORS = [
    (0, _EMAIL, "@", True),
    (1, _IP, "[0-9]", True),
    (2, _CARD, "[0-9]", True),
    (3, _PHONE, "[+]", True),
    (3, _LOCAL_PHONE, "[0-9]", False),
    (0, _SPELLED_EMAIL, "at", False),
    (4, _TOKEN, "[A-Za-z0-9]{16}", False),
    (4, _GIVEN, "[=:]", False),
]
_TOKENS = 6
#: each feature's values are 0 to this, exclusive
FEATURES = {"kind": len(KINDS), "digits": 8, "separator": 5, "before": 5, "after": 5, "cue": 2, "case": 4}
VECTORS = math.prod(FEATURES.values())
_CANDIDATE = "struct<kind:int,s:int,e:int,valid:boolean,labelled:boolean,positive:boolean," + ",".join(f"{f}:int" for f in FEATURES if f != "kind") + ">"


def _matches(text: Column, pattern: str) -> Column:
    """Structs (s, e, m) of all matches: start, end and text."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("m"), pieces.alias("p"))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        more = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))
        return F.struct(F.coalesce(e, s).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], more)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(generator: int, m: Column) -> Column:
    """The base check of a match."""
    kind, _, _, base = _GENERATORS[generator]
    if not base:
        return F.lit(False)
    return [F.lit(True), m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"), F.luhn_check(_digits(m)) if hasattr(F, "luhn_check") else F.call_function("luhn_check", _digits(m)), F.length(_digits(m)).between(9, 15)][kind]


def _char_class(c: Column) -> Column:
    """0 none, 1 blank, 2 letter, 3 digit, 4 other."""
    return F.when(F.length(c) == 0, 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def _described(text: Column, g: int):
    """Turns a match of generator g into a candidate with its features."""
    kind = _GENERATORS[g][0]

    def one(x):
        m, digits = x["m"], F.length(_digits(x["m"]))
        gaps = [m.contains(c).cast("int") for c in (" ", "-", ".")]
        separator = F.when(gaps[0] + gaps[1] + gaps[2] > 1, 4).otherwise(gaps[0] + 2 * gaps[1] + 3 * gaps[2])
        before = F.when(x["s"] > 0, text.substr(x["s"], F.lit(1))).otherwise("")
        ahead = text.substr(x["e"] + 1, F.lit(1))
        context = text.substr(F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
        named = context.rlike(_NAMES + "$")
        if kind == 4:  # a name before a token is its label
            cue, labelled, positive = F.lit(0), F.lit(g == _TOKENS) & (named | (digits == 0)), named
        else:
            cue, labelled, positive = context.rlike(_CUES).cast("int"), F.lit(_GENERATORS[g][3]), F.lit(False)
        case = m.rlike("[a-z]").cast("int") + 2 * m.rlike("[A-Z]").cast("int")
        size = F.when(digits == 0, 0).when(digits < 7, 1).when(digits < 9, 2).when(digits < 11, 3).when(digits < 13, 4).when(digits < 16, 5).when(digits == 16, 6).otherwise(7)
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _valid(g, m).alias("valid"), labelled.alias("labelled"), positive.alias("positive"), size.alias("digits"), separator.alias("separator"), _char_class(before).alias("before"), _char_class(ahead).alias("after"), cue.alias("cue"), case.alias("case"))

    return one


def _candidates(text: Column) -> Column:
    """All generators' spans with features: structs (kind, s, e, valid, labelled, positive, other features...)."""
    found = [F.when(text.rlike(needs), _matches(text, pattern)) for _, pattern, needs, _ in _GENERATORS]
    return F.concat(*[F.coalesce(F.transform(x, _described(text, g)), F.array().cast(f"array<{_CANDIDATE}>")) for g, x in enumerate(found)])


def candidates(docs: DataFrame, keep: list[str], text: str = "text", out: str = "candidates") -> DataFrame:
    """Columns ``keep`` and an array of candidates of each whole text."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(*[F.col(f"`{c}`") for c in keep], _candidates(whole).alias(out))


# ---- the model -----------------------------------------------------------------------------------


def vectors(rows: DataFrame, fold: Column, column: str = "candidates") -> list:
    """Counts of labelled candidates by (held out, features): at most 2 * VECTORS rows. A base pattern's is positive if a valid match of its kind covers it."""
    c = F.col(column)
    covered = F.transform(F.filter(c, lambda x: x["labelled"]), lambda x: F.struct(x.alias("x"), (x["positive"] | F.exists(c, lambda y: y["valid"] & (y["kind"] == x["kind"]) & (y["s"] <= x["s"]) & (y["e"] >= x["e"]))).alias("y")))
    flat = rows.select(fold.alias("held_out"), F.explode(covered).alias("z")).select("held_out", *[f"z.x.{f}" for f in FEATURES], F.col("z.y").cast("long").alias("y"))
    return flat.groupBy("held_out", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive")).collect()


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, value, equal?, yes, no), or a leaf's step."""
    leaf = -RATE * float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 2:
        return leaf
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    best = (1e-6, None)
    for j, (name, many) in enumerate(FEATURES.items()):
        for v in range(many):
            for equal in (False, True) if name == "digits" else (True,):
                yes = x[:, j] == v if equal else x[:, j] <= v
                if yes.any() and not yes.all():
                    gain = score(yes) + score(~yes) - g.sum() ** 2 / (h.sum() + 1.0)
                    if gain > best[0] + 1e-9:
                        best = (gain, (j, v, equal, yes))
    if best[1] is None:
        return leaf
    j, v, equal, yes = best[1]
    return j, v, equal, _tree(x[yes], g[yes], h[yes], depth - 1), _tree(x[~yes], g[~yes], h[~yes], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, v, equal, yes, no = tree
    return np.where(x[:, j] == v if equal else x[:, j] <= v, _apply(yes, x), _apply(no, x))


def boost(rows: list) -> tuple[list, dict[int, float]]:
    """(trees, threshold of each kind on the log-odds scale) from counts by feature vector."""
    rows = sorted(rows, key=lambda r: (r.held_out, r.kind, *(r[f] for f in FEATURES)))
    x = np.array([[r[f] for f in FEATURES] for r in rows]).reshape(-1, len(FEATURES))
    n, y = np.array([r.n for r in rows], float), np.array([r.positive for r in rows], float)
    kind, held = np.array([r.kind for r in rows]), np.array([r.held_out for r in rows], bool)
    fit = ~held
    if not y[fit].sum():
        return [], {}
    margin, trees = np.zeros(int(fit.sum())), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        tree = _tree(x[fit], n[fit] * p - y[fit], n[fit] * p * (1 - p), DEPTH)
        trees.append(tree)
        margin = margin + _apply(tree, x[fit])
    thresholds = {}
    for k in range(len(KINDS)):
        m = held & (kind == k)
        s = sum((_apply(t, x[m]) for t in trees), np.zeros(int(m.sum())))
        for cut in sorted(set(np.round(s, 6))):
            at = s >= cut - 1e-6
            if n[m][at].sum() >= CALIBRATION_LEAST and y[m][at].sum() >= PRECISION * n[m][at].sum():
                thresholds[k] = float(cut) - 1e-6
                break
    return trees, thresholds


def _expression(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    j, v, equal, yes, no = tree
    f = c[list(FEATURES)[j]]
    return F.when(f == v if equal else f <= v, _expression(yes, c)).otherwise(_expression(no, c))


def spans(model: tuple[list, dict[int, float]], column: str = "candidates") -> tuple[Column, Column]:
    """(base spans, all spans): arrays of structs (s, kind, e), in order. Candidates within a base span of their kind add nothing."""
    trees, thresholds = model
    c = F.col(column)
    plain = lambda x: F.struct(x["s"], x["kind"], x["e"])
    base = F.filter(c, lambda x: x["valid"])
    ordered = lambda a: F.array_sort(F.array_distinct(F.transform(a, plain)))
    if not trees or not thresholds:
        return ordered(base), ordered(base)

    def added(x):
        total = F.lit(0.0)
        for t in trees:
            total = total + _expression(t, x)
        cut = F.element_at(F.create_map(*[F.lit(v) for k in range(len(KINDS)) for v in (k, thresholds.get(k, 1e9))]), x["kind"])
        return ~F.exists(base, lambda y: (y["kind"] == x["kind"]) & (y["s"] <= x["s"]) & (y["e"] >= x["e"])) & (total >= cut)

    return ordered(base), ordered(F.concat(base, F.filter(F.filter(c, lambda x: ~x["valid"]), added)))


def listed(a: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def fit(rows: DataFrame, key: Column, column: str = "candidates") -> tuple[list, dict[int, float]]:
    return boost(vectors(rows, F.pmod(key, F.lit(5)) == 0, column))


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base spans and all spans as arrays."""
    key = free_name(docs, "content_key")
    rows = written(candidates(docs.select("doc_id", "text", row_key("doc_id", "text").alias(key)), ["doc_id", key]))
    base, every = spans(fit(rows, F.col(key)))
    return rows.select("doc_id", base.alias("base"), every.alias("every"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets, overlapping spans by the first one's."""
    key, c, a = (free_name(docs, x) for x in ("content_key", "pii_candidates", "pii_spans"))
    keyed = docs.withColumn(key, row_key(text))
    model = fit(candidates(keyed, [key], text, c), F.col(key), c)
    rows = candidates(docs, docs.columns, text, c)
    _, every = spans(model, c)
    names, t = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.col(f"`{text}`")

    def step(acc, x):
        apart = x["s"] >= acc["at"]
        more = F.concat(acc["out"], F.when(apart, F.concat(t.substr(acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["kind"] + 1))).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(F.col(a), start, step, lambda acc: F.concat(acc["out"], t.substr(acc["at"] + 1, F.length(t))))
    rows = rows.withColumn(a, every)
    return rows.withColumn(text, F.when(F.size(a) > 0, clean).otherwise(t)).select(*docs.columns)


def _base_columns() -> list[Column]:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return [*[count(k) for k in range(len(BASE_KINDS))], F.sha2(listed(F.col("base")), 256).alias("base_sha256")]


def pii_base(spark, sf_dir: str) -> DataFrame:
    """What the base patterns alone find, which SQL can say too."""
    rows = candidates(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return rows.select("doc_id", spans(([], {}))[0].alias("base")).select("doc_id", *_base_columns())


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *_base_columns(), listed(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))
