"""Running aggregates and clamped folds over ordered groups, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.operators import clamped, scan, scoring


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k string, at long, v long")


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_over_a_group_in_many_partitions(spark, how):
    r = random.Random(2)
    rows = [("hot", i, r.randrange(-9, 10)) for i in range(4000)] + [(r.choice(["a", "b", None]), i, r.randrange(-9, 10)) for i in range(300)]
    order = [F.col("at")]
    dealt = scan.dealt(rows_of(spark, rows).repartition(5), ["k"], order)
    assert dealt.where("k = 'hot'").select(scan.PART).distinct().count() > 1
    got = {(x.k, x.at): x.run for x in scan.running(dealt, ["k"], order, {"run": F.col("v")}, {"sum": F.sum, "max": F.max}[how]).collect()}
    want = {}
    for k in ("hot", "a", "b", None):
        acc = None
        for _, at, v in sorted(x for x in rows if x[0] == k and x[0] is not None) if k is not None else sorted((x for x in rows if x[0] is None), key=lambda x: x[1]):
            acc = v if acc is None else acc + v if how == "sum" else max(acc, v)
            want[(k, at)] = acc
    assert got == want


def test_running_over_all_rows(spark):
    rows = rows_of(spark, [("x", i, i) for i in range(1000)])
    dealt = scan.dealt(rows, [], [F.col("at")])
    got = scan.running(dealt, [], [F.col("at")], {"run": F.col("v")}).orderBy("at").collect()
    assert [x.run for x in got] == np.cumsum(range(1000)).tolist()
    assert scan.running(scan.dealt(rows.where("false"), [], [F.col("at")]), [], [F.col("at")], {"run": F.col("v")}).count() == 0


def folded(steps, low, high):
    x = 0.0
    for d in steps:
        x = max(low, min(high, x + d))
    return x


def test_compose_equals_the_fold():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 64, 1000):
        cuts = np.unique(np.r_[0, r.integers(0, n, 5)])
        d = r.normal(size=n)
        lo, hi, shift = clamped.compose(np.full(n, -1.5), np.full(n, 2.0), d, cuts)
        for s, e, got in zip(cuts, [*cuts[1:], n], np.maximum(lo, np.minimum(hi, shift))):
            assert abs(got - folded(d[s:e], -1.5, 2.0)) < 1e-9


def test_fold_of_random_groups(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), i * 700 - 9000, r.randrange(-3, 4)) for i in range(600)] + [("a", 10**9, None)]
    got = {x.k: x.out for x in clamped.fold(rows_of(spark, rows).repartition(7), ["k"], F.col("at"), F.col("v") / 2, -2, 2.5, "out").collect()}
    assert got == {k: folded([v / 2 for kk, _, v in rows if kk == k and v is not None], -2, 2.5) for k in ("a", "b", None)}
    assert clamped.fold(rows_of(spark, []), ["k"], F.col("at"), F.col("v"), -1, 1, "out").count() == 0


def test_a_voxel_that_a_million_pings_hit(spark):
    n = 1_000_000
    pings = spark.range(n, numPartitions=8).select(F.lit("s").alias("k"), F.col("id").alias("at"), ((F.col("id") * 7919) % 1001 - 499).alias("v"))
    steps = clamped.fold(pings, ["k"], F.col("at"), F.col("v") / 128, -4, 4, "out")
    d = ((np.arange(n) * 7919) % 1001 - 499) / 128
    assert steps.collect() == [("s", folded(d.tolist(), -4, 4))]
    # blocks of the voxel, not the voxel, are what is dealt out
    assert "fold_block" in steps._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("leaf", [6, 64])
def test_nearest_in_a_dense_cloud_with_outliers(spark, monkeypatch, leaf):
    """Clouds of very different density, copies of one place, and points far away: every distance is brute force's."""
    monkeypatch.setattr(scoring, "LEAF", leaf)
    r = np.random.default_rng(5)
    b = np.concatenate([r.normal(size=(400, 3)) * 1e-3, r.normal(size=(150, 3)) * 5, np.repeat([[7.0, 7.0, 7.0]], 200, axis=0)])
    a = np.concatenate([r.normal(size=(60, 3)) * 1e-3, r.normal(size=(60, 3)) * 5, [[1e6, -1e6, 3.0], [7.0, 7.0, 7.0], [-1e-9, 0.0, 1e5]]])
    points = lambda x: spark.createDataFrame([(i, tuple(map(float, v))) for i, v in enumerate(x)], "id int, p struct<x:double,y:double,z:double>")
    got = {x.id: x.d for x in scoring.nearest(points(a), points(b)).collect()}
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    assert len(got) == len(a) and all(abs(got[i] - d) <= 1e-9 * max(1, d) for i, d in enumerate(want))
