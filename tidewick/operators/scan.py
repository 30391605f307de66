"""Running sums in an order, for groups of any size.

A window over a group puts the whole group into one task. Here rows are dealt by ranges of (group, order),
so that a large group lies in several neighbouring partitions. Each partition sums on its own; a group that began in an earlier
partition gets what it had there. Such a group is the first of its partition, so that there are fewer of these carried rows than
partitions, whatever the data.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = "scan_part"


def checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder from ``spark.checkpoint.dir``; only a local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewick-")
    sc.setCheckpointDir(base)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, which driver and executors share."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoints(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, group: list[str], order: list[Column], keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """Rows dealt by ranges, each with its partition's number; kept, so that a retry can't draw other ranges."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keep(df.repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn(PART, F.spark_partition_id()))


def running(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], how: Callable[[Column], Column] = F.sum, before: bool = False) -> DataFrame:
    """Add columns with the running aggregate of each expression over ``rows``, which come from ``dealt`` with the same group and order.

    ``how`` is an aggregate that combines with itself: sum, max or min. The row itself is included, unless ``before``. Rows that are equal in the
    order follow one another in any order.
    """
    both = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.max: F.greatest, F.min: F.least}[how]
    local = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    here = rows.withColumns({name: how(e).over(local) for name, e in sums.items()})
    parts = rows.groupBy(PART, *group).agg(*[how(e).alias(f"scan_of_{name}") for name, e in sums.items()])
    if group:
        # only the first and the last group of a partition can reach into another one
        ends = parts.groupBy(PART).agg(F.min(F.struct(*group)).alias("scan_first"), F.max(F.struct(*group)).alias("scan_last"))
        key = F.struct(*group)
        parts = parts.join(F.broadcast(ends), PART).where(key.eqNullSafe(F.col("scan_first")) | key.eqNullSafe(F.col("scan_last"))).drop("scan_first", "scan_last")
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(F.col(PART).alias("scan_at"), *[F.col(g).alias(f"scan_by_{g}") for g in group], *[how(f"scan_of_{name}").over(before).alias(f"scan_of_{name}") for name in sums])
    on = F.col(PART) == F.col("scan_at")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"scan_by_{g}"))
    joined = here.join(F.broadcast(carried), on, "left")  # at most two rows for each partition
    return joined.withColumns({name: both(F.col(name), F.col(f"scan_of_{name}")) for name in sums}).drop("scan_at", *[f"scan_of_{name}" for name in sums], *[f"scan_by_{g}" for g in group])
