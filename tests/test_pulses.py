"""Pulses of a small table are made in many tasks."""

from pyspark.sql import functions as F

from tidewick.plans import catalog


def test_parts_of_one_small_file_lie_in_many_tasks(spark, tmp_path):
    spark.range(0, 234 * 60, 234).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size"), F.lit(1.0).alias("p_retailprice")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = catalog.pulse_samples(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    kept = [(r.id, r.n, r.sample, r.task) for r in rows.collect()]
    samples = {}
    for i, n, x, _ in kept:
        samples.setdefault(i, {})[n] = x
    assert len(samples) == 60 and all(list(sorted(x)) == list(range(241)) for x in samples.values())
    assert all(x == samples[0] for x in samples.values())
    assert len({t for *_, t in kept}) > 1  # one small file was one task
