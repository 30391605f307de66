"""The bucketed store against one table held in memory."""

import pytest

from tidewick.sources import room_store as S

SEEN = "id string, label string, vector array<double>, at long"


def rows(spark, *items):
    return spark.createDataFrame([(i, label, [float(v)], at) for i, label, v, at in items], SEEN)


def content(df):
    return {r.id: (r.label, r.vector, r.observations) for r in df.collect()}


def test_versions_of_a_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    S.create(spark, folder, 8)
    assert S.read(spark, folder).count() == 0
    S.remember(spark, folder, rows(spark, *[(f"r{i}", "x", i, 1) for i in range(40)]), 0)
    before = S.manifest(spark, folder)
    S.remember(spark, folder, rows(spark, ("r1", None, 5, 2), ("r1", "y", 4, 1)), 1)
    after = S.manifest(spark, folder)
    changed = {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)}
    assert len(changed) == 1 and len(after["folders"]) == len(before["folders"])  # other buckets stay where they were
    assert content(S.read(spark, folder))["r1"] == ("y", [5.0], 3) and S.read(spark, folder).count() == 40
    assert content(S.read(spark, folder, 1))["r1"] == ("x", [1.0], 1)  # an earlier version can still be read

    assert S.remember(spark, folder, rows(spark, ("r2", "z", 9, 9)), 1) == 2  # a batch that is tried again
    assert content(S.read(spark, folder))["r2"] == ("x", [2.0], 1)
    S.forget(spark, folder, spark.createDataFrame([("r3",), ("nobody",)], "id string"))
    assert "r3" not in content(S.read(spark, folder)) and S.read(spark, folder).count() == 39
    assert S.vacuum(spark, folder) > 0 and S.read(spark, folder).count() == 39
    with pytest.raises(ValueError):
        S.read(spark, folder, 1)


def test_two_writers_of_one_version(spark, tmp_path):
    folder = str(tmp_path / "store")
    S.create(spark, folder, 2)
    with pytest.raises(RuntimeError):
        S.create(spark, folder, 2)
    S.remember(spark, folder, rows(spark, ("a", "x", 1, 1)))
    m = S.manifest(spark, folder)
    with pytest.raises(RuntimeError):
        S._commit(spark, folder, m)
    assert content(S.read(spark, folder)) == {"a": ("x", [1.0], 1)}


def test_a_stream_fills_the_store(spark, tmp_path):
    folder, inputs = str(tmp_path / "store"), str(tmp_path / "in")
    S.create(spark, folder, 4)
    for part in range(3):
        rows(spark, *[(f"r{i % 5}", None, i, i) for i in range(part * 10, part * 10 + 10)]).coalesce(1).write.mode("append").parquet(inputs)
    stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(inputs)
    stream.writeStream.foreachBatch(S.sink(folder)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert S.manifest(spark, folder)["version"] == 3
    assert {k: v[2] for k, v in content(S.read(spark, folder)).items()} == {f"r{i}": 6 for i in range(5)}
