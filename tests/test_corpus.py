"""Line numbers of split files, and the order check across ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_engine import PAIR
from tidewick.sources import presence


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "9"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_of_files_that_are_read_in_ranges(spark, small_splits, tmp_path):
    r = random.Random(4)
    files = {}
    for name in ("a.txt", "b.txt"):
        files[name] = [r.choice(["", "x", "é" * 40, "word " * r.randrange(60), "q" * 3000]) for _ in range(150)]
        (tmp_path / name).write_text("\n".join(files[name]) + "\n")
    got = presence.lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    assert [tuple(x) for x in got.orderBy("line").collect()] == list(enumerate(files["a.txt"] + files["b.txt"], 1))


def dwell(i, start, device="dev"):
    x = json.loads(json.dumps(PAIR))
    shift = start - x["clock"]["ultrasonic_unix_s"]
    x["provenance"] |= {"sequence": i, "device_id": device}
    x["clock"]["ultrasonic_unix_s"] = start
    x["clock"]["offset_s"] += shift
    return json.dumps(x)


def test_the_first_wrong_line_is_named(spark, small_splits, tmp_path):
    start = PAIR["clock"]["ultrasonic_unix_s"]
    rows = [dwell(i, start + 20 * i) for i in range(60)]
    rows[20:20] = ["", ""]
    path = tmp_path / "corpus.jsonl"
    path.write_text("\n".join(rows) + "\n")
    assert presence.read(spark, str(path)).count() == 60
    rows[47] = dwell(45, start + 20 * 3)  # begins before line 47 of another range has ended
    rows[52] = rows[52][:100]
    path.write_text("\n".join(rows) + "\n")
    with pytest.raises(ValueError, match="non_monotonic at line 48$"):
        presence.read(spark, str(path))
    found = presence.parse(presence.lines(spark, str(path))).where(F.col("error").isNotNull()).orderBy("line").select("line", "error").collect()
    assert [tuple(x) for x in found] == [(48, "non_monotonic"), (53, "parse")]


def test_a_corpus_of_nothing(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("\n\n")
    with pytest.raises(ValueError, match="empty"):
        presence.read(spark, str(tmp_path / "none.jsonl"))
