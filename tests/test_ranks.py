"""Ranks tell only the values of a small range apart."""

import random

from pyspark.sql import functions as F

from tidewick.operators import cfar


def test_ranks_of_many_values_and_of_far_apart_ones(spark):
    r = random.Random(2)
    groups = {"even": [r.random() for _ in range(3000)], "far": [10.0 ** r.uniform(-9, 300) for _ in range(500)], "one": [4.0], "equal": [2.0] * 50, "two": [1.0, 3.0] * 7}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double").repartition(3)
    q = cfar.grouped_ranks(rows, ["g"], "x", {"low": lambda n: F.floor((n - 1) / 4), "high": lambda n: F.ceil((n - 1) * 0.9)}, 16)
    got = {x.g: (x.low, x.high) for x in q.collect()}
    assert got == {g: (sorted(xs)[(len(xs) - 1) // 4], sorted(xs)[-int(-(len(xs) - 1) * 0.9 // 1)]) for g, xs in groups.items()}
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    by_value = [line for line in plan.splitlines() if "Aggregate [" in line and "_v#" in line.split("],")[0]]
    assert by_value and all("_c#" in x.split("],")[0] for x in by_value)  # no aggregate over all distinct values
