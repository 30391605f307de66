"""A live scan that is killed and goes on, and state that was altered."""

import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewick.operators import occupancy
from tidewick.plans import live
from tidewick.streaming import session

PING = "session_id string, ping long, timestamp double, saturated boolean, sanitized long, blast_amplitude double, n_detections long, evidence array<struct<voxel:long,delta:double>>"


@pytest.fixture
def rocks(spark):
    key, provider = session.ROCKS
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    yield
    spark.conf.set(key, before)


def add(spark, folder, pings, delta=0.9):
    rows = [(s, i, float(i), False, 0, 1.0, 1, [(v, delta if (v + i) % 3 else -0.4) for v in range(6)]) for s in ("a", "b", "c") for i in pings]
    spark.createDataFrame(rows, PING).coalesce(1).write.mode("append").parquet(folder)


def start(spark, folder, seal=None, sink=None, state="state"):
    stream = spark.readStream.schema(PING).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    w = session.resume(stream, f"{folder}/{state}", seal)
    w = w.foreachBatch(sink) if sink else w.format("parquet").option("path", f"{folder}/out")
    return w.trigger(availableNow=True).start()


def test_a_killed_stream_goes_on_where_it_was(spark, rocks, tmp_path):
    folder, seen = str(tmp_path), []

    def sink(batch, i):
        if i == 1 and len(seen) == 1:
            seen.append("killed")
            raise RuntimeError("killed after the state of this batch was written")
        batch.write.mode("overwrite").parquet(f"{folder}/out/{i}")
        seen.append(i)

    for part in (range(0, 5), range(5, 9), range(9, 14)):
        add(spark, f"{folder}/in", part)
    with pytest.raises(StreamingQueryException):
        start(spark, folder, sink=sink).awaitTermination()
    start(spark, folder, sink=sink).awaitTermination()
    assert seen == [0, "killed", 1, 2]
    out = spark.read.parquet(f"{folder}/out/*")
    assert out.count() == 3 * 14 and out.where("not accepted").count() == 0  # the killed batch counts once
    rows = spark.read.schema(PING).parquet(f"{folder}/in")
    deltas = rows.select("session_id", "ping", F.inline("evidence"))
    want = {(r.session_id, r.voxel): r.log_odds for r in occupancy.fold(deltas).collect()}
    state = session.held(spark, f"{folder}/state").where("log_odds <> 0").collect()
    assert {(r.session_id, r.voxel) for r in state} == set(want) and all(abs(want[(r.session_id, r.voxel)] - r.log_odds) < 1e-9 for r in state)
    summary = {r.session_id: (r.occupied, r.known) for r in occupancy.summary(occupancy.fold(deltas)).collect()}
    assert {r.session_id: (r.occupied, r.known) for r in out.where("ping = 13").collect()} == summary


def test_sealed_state(spark, rocks, tmp_path):
    folder = str(tmp_path)
    add(spark, f"{folder}/in", range(5))
    start(spark, folder).awaitTermination()
    seal = session.seal(spark, f"{folder}/state")
    assert session.sealed(spark, f"{folder}/state", seal) and sum(p[1] for p in seal["partitions"]) == 3 * 6 + 3
    assert not session.sealed(spark, f"{folder}/state", seal | {"batch": seal["batch"] + 1})
    shutil.copytree(f"{folder}/state", f"{folder}/kept")

    # a later batch leaves the sealed one readable, and a new seal differs
    add(spark, f"{folder}/in", range(5, 8))
    start(spark, folder, seal).awaitTermination()
    assert session.sealed(spark, f"{folder}/state", seal) and session.seal(spark, f"{folder}/state")["partitions"] != seal["partitions"]

    # another scan's state in the sealed one's place
    add(spark, f"{folder}/other/in", range(5), delta=0.8)
    start(spark, f"{folder}/other").awaitTermination()
    shutil.rmtree(f"{folder}/kept/state")
    shutil.copytree(f"{folder}/other/state/state", f"{folder}/kept/state")
    with pytest.raises(ValueError):
        start(spark, folder, seal, state="kept")


class _Counted:
    """State that counts how often it is asked and told."""

    def __init__(self):
        self.value, self.held, self.calls = None, {}, 0

    def _told(self, x=None):
        self.calls += 1
        return x

    def exists(self):
        return self._told(self.value is not None)

    def get(self):
        return self._told(self.value)

    def update(self, x):
        self.value = self._told(x)

    def containsKey(self, k):  # noqa: N802
        return self._told(k in self.held)

    def getValue(self, k):  # noqa: N802
        return self._told(self.held.get(k))

    def updateValue(self, k, v):  # noqa: N802
        self._told()
        self.held[k] = v


def test_a_batch_of_a_session_takes_few_messages():
    """F6, F8, F9: a session's 24 voxels took 75 messages to the state for each batch."""
    scan = session.Scan()
    scan.facts, scan.cells = _Counted(), _Counted()
    steps = []
    for part in (range(0, 30), range(30, 60)):
        frame = pd.DataFrame([(i, float(i), False, 0, 1.0, 1, np.array([(i * 7 + k) % 24 for k in range(3)]), np.array([-0.75, 0.25, 0.25])) for i in reversed(part)], columns=["ping", "timestamp", "saturated", "sanitized", "blast_amplitude", "n_detections", "voxels", "deltas"])
        before = scan.facts.calls + scan.cells.calls
        steps.append(pd.concat(scan.handleInputRows(("a",), iter([frame.iloc[:9], frame.iloc[9:]]), None)))
        assert scan.facts.calls + scan.cells.calls - before <= 5
    odds, g = {}, scan.grid
    for i in range(60):
        for k in range(3):
            v = (i * 7 + k) % 24
            odds[v] = max(g.low, min(g.high, odds.get(v, 0.0) + (0.25 if k else -0.75)))
    got = {v: x for voxels, values in scan.cells.held.values() for v, x in zip(voxels, values)}
    assert got == pytest.approx(odds)
    last = pd.concat(steps).iloc[-1]
    assert last.ping == 59 and last.known == sum(x != 0 for x in odds.values()) and last.occupied == sum(x >= g.occupied for x in odds.values())


def test_sessions_of_a_key_step_together():
    """F8, F9: a call for each session took 14 ms of a task; one call now takes many sessions, and each goes its own way."""
    columns = ["session_id", "ping", "timestamp", "saturated", "sanitized", "blast_amplitude", "n_detections", "voxels", "deltas"]
    r = np.random.default_rng(8)
    rows = [(s, i, float(r.integers(0, 60)), bool(r.random() < 0.2 + 0.5 * (s == "b")), 0, 1.0, int(r.random() < 0.5), r.integers(0, 130, 3 * (i % 4 > 0)), np.full(3 * (i % 4 > 0), r.choice([-0.5, 0.75]))) for i in range(60) for s in ("a", "b", None, "d")]
    parts = [pd.DataFrame(rows[:100], columns=columns), pd.DataFrame(rows[100:], columns=columns)]

    def scanned(keep):
        scan, out = session.Scan(), []
        scan.facts, scan.cells = _Counted(), _Counted()
        for part in parts:
            mine = part[[keep(s) for s in part["session_id"]]]
            out += [pd.concat(scan.handleInputRows((7,), iter([mine.iloc[:30], mine.iloc[30:]]), None))]
        found = pd.concat(out).astype(object)
        return {repr(x) for x in found.where(found.notna(), None).itertuples(index=False, name=None)}, scan.facts.held | scan.cells.held

    together, state = scanned(lambda s: True)
    alone = [scanned(lambda s, x=x: s == x or s is x) for x in ("a", "b", None, "d")]
    assert len(together) == len(rows) and together == set().union(*(x for x, _ in alone))
    assert state == {k: v for _, held in alone for k, v in held.items()} and {k[0] for k in state} == {"a", "b", None, "d"}


def test_a_session_without_a_name(spark, rocks, tmp_path):
    """F8, F9: its state is held and found again under null."""
    rows = [(s, i, float(i), False, 0, 1.0, 1, [(5, 0.5)]) for s in (None, "a") for i in range(2)]
    for part in range(2):
        spark.createDataFrame([(s, i + 2 * part, t + 2 * part, *x) for s, i, t, *x in rows], PING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start(spark, str(tmp_path)).awaitTermination()
    state = session.held(spark, f"{tmp_path}/state")
    assert {(x.session_id, x.facts.pings) for x in state.where("voxel is null").collect()} == {(None, 4), ("a", 4)}
    assert {(x.session_id, x.voxel, x.log_odds) for x in state.where("voxel is not null").collect()} == {(None, 5, 2.0), ("a", 5, 2.0)}


def _plainly(data, starts, before):
    """The steps of pings, one after the other."""
    out, after = [], []
    for start, end, state in zip(starts, [*starts[1:], len(data["timestamp"])], before):
        at, pings, saturated, silent, _, _, last, repeats = state or (float("-inf"), 0, 0, 0, 0, 0, None, 0)
        for i in range(start, end):
            time, full, bad, heard, blast = (data[c][i] for c in ("timestamp", "saturated", "sanitized", "n_detections", "blast_amplitude"))
            halt = "iteration-budget" if pings >= session.MOST_PINGS else "repeated-failure" if repeats >= session.REPEATED_FAILURES else None
            ok, why = time > at and halt is None, None
            if ok:
                at, pings = time, pings + 1
                saturated, silent = saturated + 1 if full else 0, 0 if heard else silent + 1
                why = "saturated" if full else "non-finite" if bad else "no-direct-path" if blast <= 0 else "silent" if silent >= 5 else None
                repeats = repeats + 1 if why and why == last else int(bool(why))
                last = why
            out.append((ok, saturated, silent, why, halt))
        after.append((at, pings, saturated, silent, last, repeats))
    return out, after


@pytest.mark.parametrize("seed", range(40))
def test_steps_of_a_batch_are_those_of_its_pings_in_turn(seed):
    """the pings of a batch took their steps one by one in Python."""
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 30, 60)
    starts, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    rate = r.choice([0.02, 0.2, 0.7], 3)
    time = np.concatenate([np.sort(r.integers(0, 40, k)).astype(float) for k in sizes])
    time[starts[3] + sizes[3] - 1] = np.nan
    data = {"timestamp": time, "saturated": r.random(n) < rate[0], "sanitized": (r.random(n) < rate[1]).astype(int), "n_detections": (r.random(n) < rate[2]).astype(int), "blast_amplitude": r.choice([np.nan, -1.0, 0.0, 1.0, 2.0, 3.0], n)}
    state = lambda: (float(r.integers(-5, 45)), int(r.choice([1, 590, 599, 600])), int(r.integers(0, 3)), int(r.integers(0, 6)), 0, 0, *[(None, 0), ("saturated", 1), ("non-finite", 2), ("silent", 1), ("no-direct-path", 3)][r.integers(0, 5)])
    before = [state() if r.random() < 0.6 else None for _ in sizes]
    steps, after = session.Scan._steps(data, starts, before)
    want, then = _plainly(data, starts.tolist(), before)
    assert list(zip(*(np.asarray(steps[c]).tolist() for c in ("accepted", "saturated_streak", "silent_streak", "failure", "halt")))) == want
    assert after == then


def test_a_new_key_is_asked_once():
    """each session of a new key was asked for, though none could be there."""
    scan = session.Scan()
    scan.seen, scan.facts, scan.cells = _Counted(), _Counted(), _Counted()
    calls = lambda: scan.seen.calls + scan.facts.calls + scan.cells.calls
    rows = lambda at: pd.DataFrame([(f"s{i}", i, np.array([at, 0.0, 1.0, i % 24, (i + 1) % 24, 0.5, -0.5])) for i in range(50)], columns=["session_id", "ping", "numbers"])
    out = pd.concat(scan.handleInputRows((1,), iter([rows(1.0)]), None))
    assert out.accepted.all() and calls() <= 2 * 50 + 2
    out = pd.concat(scan.handleInputRows((1,), iter([rows(1.0), rows(2.0)]), None))
    assert out.accepted.sum() == 50 and (out.known == 2).all() and calls() <= 2 * 50 + 2 + 4 * 50 + 1
    assert scan.facts.held[("s7",)][1] == 2 and dict(zip(*scan.cells.held[("s7", 0)])) == {7: 1.0, 8: -1.0}


def test_outcomes_read_each_part_of_the_state_once(spark, monkeypatch):
    """the voxels were read a second time, for nothing, beside the facts; and steps that nobody reads were written."""
    folders, streamed = [], live.streamed
    monkeypatch.setattr(live, "streamed", lambda *a, **b: folders.append(streamed(*a, **b)) or folders[-1])
    found = live.live_outcomes(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("user_map_key") and plan.count("RelationV2") == 2
    path = spark._jvm.org.apache.hadoop.fs.Path(folders[0][0])
    assert found.count() and not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
