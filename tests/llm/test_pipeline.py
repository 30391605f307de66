from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.conftest import frame, words


def test_stages(spark, tmp_path):
    good = [(i, " ".join(words(i, 90))) for i in range(40)]
    item = " ".join(words(999, 40))
    near = good[3][1].split()
    near[70] = "other"
    rows = [*good, (100, " ".join(near)), (101, good[5][1]), (101, good[5][1]), (102, " ".join(words(500, 60)) + " " + item), (103, " ".join(words(501, 70)) + " mail a.b@example.org now"), (104, None), (105, "short"), (106, "loop loop " * 60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "packing"]
    at, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = sorted(r.doc_id for r in at.collect())
    want = [*range(40), 100, 101, 101, 102, 103]
    assert left["quality_rules"] == want
    assert len(left["near_duplicates"]) == 42 and {3, 100} & set(left["near_duplicates"]) and not {3, 100} <= set(left["near_duplicates"])
    assert set(left["decontamination"]) == set(left["near_duplicates"]) - {102}
    row = at.where("doc_id = 103").first()
    assert row.text.endswith(" mail [EMAIL] now") and row.n_chars == len(row.text)
    packed = P.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in packed.select("doc_id").distinct().collect()) == sorted(set(left["personal_data"]))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    """Columns named as the stages' own ones, null lang and source, repeated rows; then no documents and no items at all."""
    rows = [(i, " ".join(words(i, 90)), "en" if i % 2 else None, None if i % 3 else "s") for i in range(30)]
    near = rows[4][1].split()
    near[80] = "other"
    rows += [(30, " ".join(near), None, None), rows[5], (None, " ".join(words(77, 80)) + " write to a.b@example.org", None, None), (31, None, None, None), (32, "short", None, "s")]
    docs = frame(spark, rows)
    for name, keep in (("some", "true"), ("none", "false")):
        docs.where(keep).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, " ".join(words(8, 90)))], "item_id long, text string").where(keep).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    d = docs
    for name, stage in P.STAGES[:-1]:
        d = P.written(stage(spark, d, f"{tmp_path}/some"))
        assert d.columns == docs.columns, name
    left = {r.doc_id: r for r in d.collect()}
    assert set(left) == {*range(30), None} - {8} and d.count() == len(left)
    assert left[None].text.endswith("write to [EMAIL]") and left[None].lang is None
    assert {r.doc_id for r in P.run(spark, f"{tmp_path}/some").collect()} == set(left)
    assert P.run(spark, f"{tmp_path}/none").count() == 0
