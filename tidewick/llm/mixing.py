"""Mix sources to target weights: sizes by source, repetition rates, and a seeded draw for the fraction.

A source's target is its weight's share of the mix, at most ``most`` times its own size; what a source can't take is
shared again among the others by weight until none is above. A document of a source with rate r is taken floor(r)
times, and once more where a number drawn from its own content falls below the fraction of r. So a
rerun, a retry or another partitioning takes the same rows, and no document is taken more than ``most`` times.

Sizes and draws are column expressions in the scan. Sources are summed with partial sums, so a hot source is a
few rows after the map side; ranks for the weights go by ranges of source names (``operators.scan``). The table of sources is
broadcast while it has at most SOURCES rows; beyond that, sources with very many rows are, and the others are joined by a shuffle.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; sources of size 0 and documents in them
are taken 0 times; rows that are equal in doc_id and text share a draw; an empty table gives no rows; extra columns of
any name pass through ``mixture`` and are not used.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scan
from ._common import free_name, join_hot, written

#: repeating weights of sources in order of their names, the mix's share of all sizes, and the highest rate
WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
SEED = "mix"
#: so many sources are broadcast
SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def size() -> Column:
    """Words of the whole text."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str = SEED) -> Column:
    """A number from 0 up to 1 that follows from seed, doc_id and text: the first 52 bits of their digest."""
    content = F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(content.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _key() -> Column:
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))


def sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """(key, n_docs, source_size, weight, target, rate) for each source."""
    sums = docs.groupBy("source").agg(F.sum(size()).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = scan.running(scan.dealt(sums, [], order, written), [], order, {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    table = written(ranked.select(_key().alias("key"), "n_docs", "source_size", weight.alias("weight")))
    total, size_, w = int(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]), F.col("source_size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    above, level, n = F.lit(False), 0.0, -1
    while True:  # each round gives the rest to the sources that aren't at their limit; at least one more reaches it
        s = table.agg(F.count(F.when(above, 1)).alias("n"), F.coalesce(F.sum(F.when(above, size_ * most)), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~above, w)), F.lit(0)).alias("w")).first()
        if s.n == n or not int(s.w):
            break
        n, held, open_ = s.n, int(s.held), int(s.w)
        level = (float(share) * total - held) / open_
        rest = share * total - held
        # the shared rest by weight is above the limit: compared in whole numbers
        above = w * F.lit(rest.numerator).cast("decimal(38,0)") > size_ * F.lit(most * open_ * rest.denominator).cast("decimal(38,0)")
    target = F.when(above, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return written(table.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))


def planned(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """Each row with a struct ``mix`` (size, source_size, target, copies); another name where the rows have one of that name already."""
    table = sources(docs, **kw)
    key, plan = free_name(docs, "mix_key"), free_name(docs, "mix")
    facts = table.select(F.col("key").alias(key), F.struct("source_size", "target", "rate", "n_docs").alias(plan))
    rows = docs.withColumn(key, _key())
    if table.count() <= SOURCES:
        joined = rows.join(F.broadcast(facts), key)
    else:
        weight = free_name(docs, "mix_rows")
        joined = join_hot(rows, facts.withColumn(weight, F.col(f"{plan}.n_docs")), key, weight, int(table.agg(F.sum("n_docs")).first()[0])).drop(weight)
    whole = F.floor(F.col(f"{plan}.rate"))
    copies = (whole + (draw(seed) < F.col(f"{plan}.rate") - whole).cast("long")).cast("int")
    return joined.withColumn(plan, F.struct(size().alias("size"), F.col(f"{plan}.source_size"), F.col(f"{plan}.target"), copies.alias("copies"))).select(*docs.columns, plan)


def mixture(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    rows = planned(docs, seed, **kw)
    plan, copy = rows.columns[-1], free_name(rows, "mix_copy")
    taken = rows.where(F.col(f"{plan}.copies") > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{plan}.copies")))).select(*docs.columns)


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    rows = planned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^ \x09-\x0D]+')) AS BIGINT) AS size,
  CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || t), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) AS u FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM e GROUP BY source),
o AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
l AS (SELECT min(level) FILTER (w * level <= 2 * source_size) AS level FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY w * level <= 2 * source_size ORDER BY source_size / w, source NULLS LAST) = 1)),
g AS (SELECT source, source_size, CASE WHEN w * l.level > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE w * l.level END AS target FROM s, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source"""
