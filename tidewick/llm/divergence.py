"""How far each source of a language lies from its others and from the language: a relational audit of term shares.

Terms are exploded from regular-expression matches and counted by (lang, source, term) in one shuffle with partial sums, together with
the number of documents that hold them. A language keeps the terms that enough of its documents hold. Each of its
groups is then crossed with that vocabulary to make zeros dense: an equi-join on language and a salt of the term, so that a large
vocabulary is dealt to all tasks and only the (few) groups are repeated. A self-join on (lang, term) meets each two sources of a language once;
sums by pair have partial sums, and windows rank. The output itself is quadratic in a language's sources, linear in its vocabulary.

Shares are integers of a billionth and all arithmetic is in whole numbers: a quotient is taken digit group by digit group, so it
is exact for counts up to 9e15 without decimals.

Defined cases: null text, lang or source is the empty string; a group without terms takes part with counts of zero; a
language without kept terms has pairs of value 0 and no terms; rows that are equal count each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import partitions, written

#: a term is a longest run of characters other than these, that is, a match of [^\x00-\x40\x5B-\x60\x7B-\x7F]+
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, SMOOTH, SCALE_DIGITS, TOP = 10, 2, 3, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term; a text's matches and then its distinct ones go through one shuffle."""
    found = F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), BETWEEN)
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), found.alias("found"))
    terms = rows.select("lang", "source", F.size("found").alias("k"), F.posexplode(F.concat("found", F.array_distinct("found"))).alias("pos", "term")).where("term <> ''")  # an empty piece lies before a text's first or after its last separator
    match = F.col("pos") < F.col("k")
    return terms.groupBy("lang", "source", "term").agg(F.sum(match.cast("long")).alias("n"), F.sum((~match).cast("long")).alias("docs"))


def div(a: Column, b: Column) -> Column:
    """Whole quotient of whole numbers."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)) by long division in base 1000: what is left stays below the divisor, so nothing overflows."""
    below = total + SMOOTH * terms
    left = count + SMOOTH
    out, left = div(left, below), left % below
    for _ in range(SCALE_DIGITS):
        out, left = out * 1000 + div(left * 1000, below), (left * 1000) % below
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), p + q)


def _meet(rows: DataFrame, by: str, groups: DataFrame) -> DataFrame:
    """Rows with every group of their language. Rows are dealt by a hash of ``by``, groups repeated for each share, so that no language is one task."""
    k = partitions(rows.sparkSession)
    shares = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(k)).cast("int")).join(shares, ["lang", "salt"]).drop("salt")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between a language's sources, and the terms in which a source exceeds its language."""
    counts = written(term_counts(docs))
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n"))
    known = written(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"))
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = written(named.join(known.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").na.fill(0, ["group_n"]))

    terms = kept.join(langs, "lang").select("lang", "term", "terms", share(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q"))
    zeros = _meet(terms, "term", groups).select("lang", "term", "source", "terms", "q", "group_n", F.lit(0).cast("long").alias("n"))
    none = F.lit(None).cast("long")
    found = known.select("lang", "term", "source", none.alias("terms"), none.alias("q"), none.alias("group_n"), "n")
    n = partitions(docs.sparkSession)
    dense = zeros.unionByName(found).repartition(n, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("terms", "q", "group_n")])
    shares = written(dense.select("lang", "term", "source", "n", "q", share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p")))

    one, two = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa")), shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"))
    sums = written(one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(distance(F.col("pa"), F.col("pb"))).alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    others = _meet(groups.select("lang", F.col("source").alias("a")), "a", groups.select("lang", F.col("source").alias("b"))).where("a <> b")
    pairs = others.join(both, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    leading = shares.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    ranked = leading.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
m AS (SELECT id, lang, source, unnest(found) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM m GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (SELECT m.lang, m.source, m.term, count(*) AS n FROM m JOIN k ON m.lang = k.lang AND m.term = k.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  CAST(1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.n + 2 * v.v) AS HUGEINT) AS p, CAST(1 + (1000000000 * (k.n + 2)::HUGEINT) // (v.n + 2 * v.v) AS HUGEINT) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM s WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10"""
