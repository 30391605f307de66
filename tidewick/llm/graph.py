"""Connected components by alternating large and small stars, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

#: a node with more edges than this, or than a MOST_HUBSth of all, is a hub, of which there are then at most MOST_HUBS
HUB, MOST_HUBS = 256, 100_000


def _stars(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """Hang each node's larger (large) or smaller neighbours on its smallest one; the minimum is aggregated before the join.

    A hub's minimum is broadcast, so that its edges stay where they are; the others meet theirs in a shuffle.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("a", F.col("m").alias("hub_m")))  # at most MOST_HUBS rows
    marked = both.join(hubs, "a", "left")
    hung = marked.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")).unionByName(marked.where("hub_m is null").join(least.where(F.col("n") <= hub), "a").select("a", "b", "m"))
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for each node of edges (a, b), where root is the smallest node of its component, the root itself included.

    Rounds grow with the logarithm of a component's size; RuntimeError if they don't suffice. Each round's
    edges are written, so that a lost executor costs no earlier round.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    size = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = size(edges)
    for _ in range(rounds):
        hub = max(HUB, 2 * mark[0] // MOST_HUBS)
        edges = written(_stars(_stars(edges, True, hub), False, hub))
        before, mark = mark, size(edges)
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
