"""The room store over batches of recordings: what is remembered, forgotten, and found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory, scan
from ..sources import room_store
from .registry import query, r
from .tables import rounded, table

ROOMS, BATCHES, BUCKETS = 97, 3, 16


def seen(spark: SparkSession, d: str) -> DataFrame:
    """Each recording shows a room again, three in four with its label."""
    k = F.col("vec_id")
    label = F.when(k % 4 != 0, F.concat(F.lit("room "), F.col("label").cast("string")))
    return table(spark, d, "embeddings").select((k % BATCHES).alias("batch"), F.concat(F.lit("r"), (k % ROOMS).cast("string")).alias("id"), label.alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), k.alias("at"))


def filled(spark: SparkSession, d: str) -> str:
    """A store after all batches; after the second one, a tenth of the rooms is forgotten."""
    folder = scan.shared_folder(spark)
    room_store.create(spark, folder, BUCKETS)
    rows = seen(spark, d)
    for b in range(BATCHES):
        room_store.remember(spark, folder, rows.where(F.col("batch") == b).drop("batch"), b)
        if b == 1:
            room_store.forget(spark, folder, rows.where(F.col("at") % ROOMS % 10 == 3).select("id").distinct())
    return folder


_STORE = f"""k AS (SELECT vec_id % {ROOMS} AS room, vec_id % {BATCHES} AS batch, vec_id, CASE WHEN vec_id % 4 <> 0 THEN 'room ' || label END AS label, embedding::DOUBLE[] AS v FROM embeddings),
kept AS (SELECT * FROM k WHERE NOT (room % 10 = 3 AND batch < 2)),
store AS (SELECT 'r' || room AS id, arg_max(label, {{'b': batch, 'i': vec_id}}) FILTER (label IS NOT NULL) AS label, arg_max(v, {{'b': batch, 'i': vec_id}}) AS vector, count(*) AS observations FROM kept GROUP BY room)"""


@query(f"WITH {_STORE} SELECT id, label, observations, {r('list_dot_product(vector, [i::DOUBLE FOR i IN range(1, 65)])', 4)} AS mark FROM store")
def room_memory(spark: SparkSession, d: str) -> DataFrame:
    """What the store holds in its last version."""
    held = room_store.read(spark, filled(spark, d))
    mark = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return held.select("id", "label", "observations", rounded(mark, 4).alias("mark"))


@query(f"""
WITH {_STORE}, q AS (SELECT id AS query_id, [x + CASE WHEN i % 2 = 0 THEN 0.02 ELSE -0.02 END FOR x, i IN vector] AS v FROM store),
m AS (SELECT query_id, id, list_cosine_similarity(v, vector) AS s, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(v, vector) DESC, id) AS n FROM q, store),
b AS (SELECT query_id, max(id) FILTER (n = 1) AS id, max(s) FILTER (n = 1) AS s, max(s) FILTER (n = 2) AS s2 FROM m WHERE n <= 2 GROUP BY query_id)
SELECT query_id, id, {r("s")} AS similarity, {r("s - s2")} AS margin FROM b WHERE s >= {memory.SIMILAR!r} AND s - s2 >= {memory.MARGIN!r}""")
def room_memory_recall(spark: SparkSession, d: str) -> DataFrame:
    """Every remembered room, a little changed, recognised in the store."""
    held = room_store.read(spark, filled(spark, d))
    asked = held.select("id", F.transform("vector", lambda x, i: x + F.when(i % 2 == 1, 0.02).otherwise(-0.02)).alias("vector"))
    found = memory.recognize(asked, held)
    return found.select("query_id", "id", rounded(F.col("similarity")).alias("similarity"), rounded(F.col("margin")).alias("margin"))
