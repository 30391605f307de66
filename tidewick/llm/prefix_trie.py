"""The prefix trie of rebuilt conversations, from digests and joins; no trie is built in memory.

Each rebuilt turn gets the digest of all turns up to it: a sum of the digests of (place, role, text), taken as a running sum over
ranges of (conversation, place), so that a conversation of any length is spread over tasks. The least conversation with a prefix
owns that node. Whoever owns a prefix owns all longer ones of its own, so a conversation's first owned depth is found by binary search: each
round probes one depth of every conversation that is still open, in one batched join against the minima by digest.

Owned depths form a chain; a chain hangs below the owner of the prefix before its first. Totals of chains (leaves, saved bytes) go
bottom-up by pointer doubling: in round k a chain hands what lies less than 2^k chains below it to the chain 2^k above, so that rounds
grow with the logarithm of the nesting. A last running sum, from a chain's end, gives each node its subtree.

A prefix or parent that very many conversations share is broadcast, of which there is a bounded number (``join_hot``); sums and minima are partial
before any shuffle. The digest of the members that end at a node is sequential by its definition: their sorted
ids are streamed through it, in bounded memory.

Defined cases: null role or text is the empty string; a null turn comes first; turns that are equal in number follow one another by the digest of
role and text; a row without conv_id belongs to no conversation and is left out; c % 5 has the sign of c; an empty table has no
nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import scan
from ._common import join_hot, partitions, written

#: a conversation begins with up to SHARED turns of the one that begins its FAMILY
FAMILY, SHARED = 5, 8
NO_ENDS = hashlib.sha256(b"").hexdigest()


def shared_turns(conv: Column) -> Column:
    """How many turns conversation c takes from its family's first: crc32(decimal c) % 9."""
    return F.crc32(conv.cast("string").cast("binary")) % (SHARED + 1)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, digest, bytes, id): texts are read once, all else works on their digests."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where(F.col("conv_id").isNotNull())
    return written(rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.unhex(digest).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("id")))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations: (conv, section, turn, digest, bytes, id), in order by section, turn, digest and id."""
    order = Window.partitionBy("conv").orderBy("turn", "digest", "id")
    # only a conversation's first turns are ranked, and partial ranks come before the shuffle
    lead = written(rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SHARED))
    replaced = lead.where(F.col("place") <= shared_turns(F.col("conv"))).select("id")
    own = rows.join(replaced, "id", "left_anti").select("conv", F.lit(1).alias("section"), "turn", "digest", "bytes", "id")
    c = F.expr("try_add(conv, step)")
    near = lead.withColumn("step", F.explode(F.sequence(F.lit(1 - FAMILY).cast("long"), F.lit(FAMILY - 1).cast("long")))).withColumn("c", c)
    taken = near.where((F.col("c") - F.col("c") % FAMILY == F.col("conv")) & (F.col("place") <= shared_turns(F.col("c"))))
    known = rows.select(F.col("conv").alias("c")).distinct()
    first = taken.join(known, "c", "left_semi").select(F.col("c").alias("conv"), F.lit(0).alias("section"), F.col("place").cast("long").alias("turn"), "digest", "bytes", "id")
    return first.unionByName(own)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, node, bytes) for each turn in order: ``node`` names the turns up to it, by depth and 120 bits of digest."""
    order = [F.col(c) for c in ("section", "turn", "digest", "id")]
    dealt = scan.dealt(rows, ["conv"], order, written)
    placed = scan.running(dealt, ["conv"], order, {"depth": F.lit(1).cast("long")})
    mark = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("digest")).cast("binary"), 256)
    lane = lambda at: F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(20,0)")
    summed = scan.running(placed.withColumns({"x": lane(1), "y": lane(16)}), ["conv"], order, {"a": F.col("x"), "b": F.col("y")})
    return written(summed.select("conv", "depth", F.concat_ws(":", "depth", "a", "b").alias("node"), "bytes"))


def first_owned(lengths: DataFrame, paths: DataFrame, minima: DataFrame, least: int, total: int) -> DataFrame:
    """(conv, length, first): the least depth whose prefix no smaller conversation has, or length + 1."""
    root = F.col("conv") == least
    state = written(lengths.select("conv", "length", F.when(root, 0).otherwise(1).cast("long").alias("lo"), F.when(root, 0).otherwise(F.col("length") + 1).cast("long").alias("hi")))
    done = [state.where("lo >= hi")]
    while True:
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        probe = open_.withColumn("depth", F.expr("(lo + hi) div 2")).join(paths.select("conv", "depth", "node"), ["conv", "depth"])
        seen = join_hot(probe, minima.select("node", "owner", "n_convs"), "node", "n_convs", total)
        mine = F.col("owner") == F.col("conv")
        state = written(seen.select("conv", "length", F.when(mine, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi")))
        done.append(state.where("lo >= hi"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return written(out.select("conv", "length", F.col("lo").alias("first")))


def owners_at(rows: DataFrame, paths: DataFrame, minima: DataFrame, least: int, total: int) -> DataFrame:
    """Add ``owner``: who owns the node at ``depth`` of each row's conversation."""
    top = rows.where("depth = 0").withColumn("owner", F.lit(least).cast("long"))
    below = rows.where("depth > 0").join(paths.select("conv", "depth", "node"), ["conv", "depth"])
    return top.unionByName(join_hot(below, minima.select("node", "owner", "n_convs"), "node", "n_convs", total).select(*top.columns))


def chain_totals(chains: DataFrame, minima: DataFrame, least: int) -> DataFrame:
    """(conv, leaves, saved) of everything in and below each chain (conv, length, depth, owner), which hangs at depth of its owner's chain."""
    hung = chains.where("owner is not null")
    taken = hung.select(F.col("owner").alias("conv"), F.col("depth").alias("length"), F.lit(0).alias("end_leaf")).distinct()
    own = minima.groupBy(F.col("owner").alias("conv")).agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    start = chains.join(taken, ["conv", "length"], "left").join(own, "conv", "left")
    state = written(start.select("conv", F.col("owner").alias("up"), F.coalesce("end_leaf", F.lit(1)).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved")))
    while True:
        low = state.where("up is not null")
        if low.isEmpty():
            return state.drop("up")
        handed = low.groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count(F.lit(1)).alias("n"))
        summed = state.join(handed, "conv", "left").select("conv", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        inner = summed.where(F.col("up").isNotNull() & (F.col("up") != least))
        facts = handed.where(F.col("conv") != least).join(state.select("conv", F.col("up").alias("next")), "conv").select(F.col("conv").alias("up"), "next", "n")
        jumped = join_hot(inner, facts, "up", "n", state.count()).select("conv", F.col("next").alias("up"), "leaves", "saved")
        ended = summed.where(F.col("up").isNull() | (F.col("up") == least)).withColumn("up", F.lit(None).cast("long"))
        state = written(jumped.unionByName(ended.select(*jumped.columns)))


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends): SHA-256 of the comma-joined ids that end at each node (owner, depth), streamed in order."""

    def run(batches):
        key, h = None, None
        for b in batches:
            owner, depth, conv = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])]) if len(owner) else []
            out = []
            for s, e in zip(at, [*at[1:], len(owner)]):
                here = (int(owner[s]), int(depth[s]))
                ids = ",".join(map(str, conv[s:e].tolist())).encode()
                if here == key:
                    h.update(b"," + ids)
                    continue
                if key is not None:
                    out.append((*key, h.hexdigest()))
                key, h = here, hashlib.sha256(ids)
            yield pa.RecordBatch.from_pylist([{"conv": o, "depth": d, "ends": x} for o, d, x in out], schema=_ENDS)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"conv": key[0], "depth": key[1], "ends": h.hexdigest()}], schema=_ENDS)

    n = partitions(ends.sparkSession)
    return ends.select("owner", "depth", "conv").repartition(n, "owner", "depth").sortWithinPartitions("owner", "depth", "conv").mapInArrow(run, "conv long, depth long, ends string")


_ENDS = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("ends", pa.string())])


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    rows = turns(conversations)
    paths = prefixes(rebuilt(rows))
    known = rows.select("conv").distinct()
    lengths = written(known.join(paths.groupBy("conv").agg(F.max("depth").alias("length")), "conv", "left").na.fill(0, ["length"]))
    total, least = lengths.agg(F.count(F.lit(1)), F.min("conv")).first()
    least = -1 if least is None else least
    minima = written(paths.groupBy("node").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes")))

    owned = first_owned(lengths, paths, minima, least, total)
    heads = owned.where("first <= length and first > 0").select("conv", "length", "first", (F.col("first") - 1).alias("depth"))
    top = owned.where("first = 0").select("conv", "length", "first", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("owner"))
    chains = written(owners_at(heads, paths, minima, least, total).unionByName(top))
    totals = chain_totals(chains, minima, least)

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    fields = ("conv", "depth", "n_convs", "bytes", "kids", "leaves", "saved", "ends_chain", "parent")

    def part(df, **given):
        return df.select(*[given[f].alias(f) if f in given else (none if f == "parent" else zero).alias(f) for f in fields])

    c = F.col
    hung = chains.where("owner is not null")
    pieces = [
        part(minima, conv=c("owner"), depth=c("depth"), n_convs=c("n_convs"), bytes=c("bytes")),
        part(lengths.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0"), conv=c("conv"), n_convs=c("n")),
        part(hung.join(totals, "conv"), conv=c("owner"), depth=c("depth"), kids=F.lit(1).cast("long"), leaves=c("leaves"), saved=c("saved")),
        part(hung, conv=c("conv"), depth=c("first"), parent=c("owner")),
        part(chains, conv=c("conv"), depth=c("length"), ends_chain=F.lit(1).cast("long")),
    ]
    nodes = pieces[0]
    for p in pieces[1:]:
        nodes = nodes.unionByName(p)
    nodes = nodes.groupBy("conv", "depth").agg(*[F.sum(f).alias(f) for f in fields[2:-1]], F.max("parent").alias("parent"))
    leaf = ((c("ends_chain") == 1) & (c("kids") == 0)).cast("long")
    down = [c("depth").desc()]
    sums = scan.running(scan.dealt(nodes, ["conv"], down, written), ["conv"], down, {"n_leaves": c("leaves") + leaf, "saved_tokens": c("saved") + (c("n_convs") - 1) * c("bytes")})

    at_end = lengths.select("conv", F.col("length").alias("depth"))
    ends = end_digests(owners_at(at_end, paths, minima, least, total))
    out = sums.join(ends, ["conv", "depth"], "left")
    return out.select(c("conv").alias("conv_id"), "depth", F.when(c("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"), "n_convs", (c("kids") + 1 - c("ends_chain")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS i FROM t),
k AS (SELECT c, c - c % 5 AS base, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(CAST(c AS VARCHAR), '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) % 9 AS BIGINT) AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT k.c, 0 AS section, o.i, digest, bytes FROM k JOIN o ON o.c = k.base AND o.i <= k.h UNION ALL SELECT k.c, 1, o.i, digest, bytes FROM k JOIN o ON o.c = k.c AND o.i > k.h),
q AS (SELECT c, row_number() OVER w AS d, bytes, sha256(string_agg(digest, '') OVER w) AS node FROM r WINDOW w AS (PARTITION BY c ORDER BY section, i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT * FROM q UNION ALL SELECT c, 0, 0, '' FROM k),
l AS (SELECT c, max(d) AS len FROM p GROUP BY c),
n AS (SELECT d, node, min(p.c) AS owner, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (len = d), '')) AS ends FROM p JOIN l ON p.c = l.c GROUP BY d, node),
m AS (SELECT p.c, p.d, n.owner FROM p JOIN n ON p.d = n.d AND p.node = n.node),
e AS (SELECT n.*, u.owner AS up FROM n LEFT JOIN m u ON u.c = n.owner AND u.d = n.d - 1),
s AS (SELECT e.*, coalesce(kids, 0) AS kids FROM e LEFT JOIN (SELECT up, d - 1 AS d, count(*) AS kids FROM e WHERE up IS NOT NULL GROUP BY ALL) x ON x.up = e.owner AND x.d = e.d)
SELECT a.owner AS conv_id, CAST(a.d AS BIGINT) AS depth, a.up AS parent_conv_id, a.n_convs, a.kids AS n_children, CAST(count_if(b.kids = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.bytes) AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM s a JOIN m ON m.owner = a.owner AND m.d = a.d JOIN s b ON b.owner = m.c AND b.d >= m.d GROUP BY ALL"""
