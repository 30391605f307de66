"""Live scans: per-session state, windows over event time, and rejection of what doesn't advance."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..config import Grid
from ..operators import clamped

#: budgets of a session
MOST_PINGS, REPEATED_FAILURES, STALLED_SWEEPS, RING = 600, 3, 4, 64
#: voxels that lie in one entry of a session's state
BLOCK = 64
#: keys that sessions are dealt to, which a stream keeps for good: a call of the scan costs some 10 ms, however few sessions it is for
SHARDS = 4096
#: why a ping failed, by its number in the scan
FAILURES = (None, "saturated", "non-finite", "no-direct-path", "silent")
#: fixed values: what each reason to stop means
MEANING = {"no-progress": "complete", "iteration-budget": "budget-exhausted", "repeated-failure": "capture-failed"}

STEP = "session_id string, ping long, accepted boolean, saturated_streak long, silent_streak long, failure string, occupied long, known long, halt string"


def windows(stream: DataFrame, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """Counts and maxima by tumbling or sliding window of ``ts``, with a watermark for late rows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top")).select(by, F.col("w.start").alias("start"), "n", "top")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def _unpacked(frame: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The columns of pings without their evidence; how many voxels each writes, and the voxels and deltas of all of them, one ping behind the other."""
    if "numbers" not in frame:
        lengths = np.array([0 if v is None else len(v) for v in frame["voxels"]])
        return {c: frame[c].to_numpy() for c in frame if c not in ("voxels", "deltas")}, lengths, *(np.concatenate([np.zeros(0, int), *(v for v in frame[c] if v is not None)]) for c in ("voxels", "deltas"))
    numbers = frame["numbers"].to_numpy()
    sizes, flat = np.array([len(x) for x in numbers]), np.concatenate(numbers)
    at, lengths = np.cumsum(sizes) - sizes, (sizes - 3) // 2
    flags = flat[at + 1].astype(int)
    data = {c: frame[c].to_numpy() for c in ("session_id", "ping")} | {"timestamp": flat[at], "saturated": flags & 1, "sanitized": flags & 2, "n_detections": flags & 4, "blast_amplitude": flat[at + 2]}
    voxels = np.arange(lengths.sum()) + np.repeat(at + 3 - np.cumsum(lengths) + lengths, lengths)
    return data, lengths, flat[voxels].astype(int), flat[voxels + np.repeat(lengths, lengths)]


def _streak(reset: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows since the last one that is ``reset``, which has 0; ``before`` is what each run of rows, from ``starts`` on, begins with."""
    i, sizes = np.arange(len(reset)), np.diff(np.append(starts, len(reset)))
    last, first = np.maximum.accumulate(np.where(reset, i, -1)), np.repeat(starts, sizes)
    return np.where(last >= first, i - last, i - first + 1 + np.repeat(before, sizes))


class Scan(StatefulProcessor):
    """Live state of sessions: last time, streaks, the map's voxels, and whether to halt.

    Input rows: session_id, ping, timestamp, saturated, sanitized, blast_amplitude, n_detections, and
    ``voxels`` and ``deltas``, arrays with a place for each voxel that the ping writes; or session_id, ping and ``numbers``, as ``scans`` makes them. A key may have
    many sessions; rows without session_id are one session's, the key.

    A ping whose time doesn't advance, or that comes after a halt, is refused and changes nothing. The steps and the evidence of a
    batch are taken for all sessions and voxels of a key at once. State lies by sessions, and their voxels by blocks of BLOCK neighbouring ones;
    each entry is read and written once in a batch, as every access is a message to Spark. A session that is new has no voxels to read, and where the
    key is new (``seen``) all its sessions are.
    """

    def __init__(self, grid: Grid = Grid()):
        self.grid, self.seen = grid, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")
        self.facts = handle.getMapState("facts", "session_id string", "timestamp double, pings long, saturated long, silent long, occupied long, known long, failure string, repeats long")
        self.cells = handle.getMapState("cells", "session_id string, block long", "voxels array<long>, log_odds array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        data, lengths, voxels, deltas = _unpacked(frame)
        code, names = pd.factorize(data["session_id"], use_na_sentinel=False) if "session_id" in data else (np.zeros(len(frame), int), [key[0]])
        names = [None if pd.isna(x) else x for x in names]
        order = np.lexsort((data["ping"], data["timestamp"], code))
        code = code[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        new = self.seen is not None and not self.seen.exists()
        before = [None if new else self.facts.getValue((name,)) for name in names]
        steps, after = self._steps({c: x[order] for c, x in data.items()}, starts, before)
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        gained = self._fold(np.repeat(rank, lengths), voxels, deltas, steps["accepted"], code, names, [s is None for s in before])
        ends = np.append(starts[1:], len(code)) - 1
        for name, place, change in zip(("occupied", "known"), (4, 5), gained):
            upto = np.cumsum(change)
            base = np.array([s[place] if s else 0 for s in before]) - (upto - change)[starts]
            steps[name] = upto + np.repeat(base, ends - starts + 1)
        for name, (*first, last, repeats), occupied, known in zip(names, after, steps["occupied"][ends].tolist(), steps["known"][ends].tolist()):
            self.facts.updateValue((name,), (*first, occupied, known, last, repeats))
        if new:
            self.seen.update((True,))
        steps |= {"session_id": np.array(names, object)[code], "ping": data["ping"][order]}
        yield pd.DataFrame({c: steps[c] for c in (x.split()[0] for x in STEP.split(", "))})

    @staticmethod
    def _steps(data: dict[str, np.ndarray], starts: np.ndarray, before: list[tuple | None]) -> tuple[dict, list[tuple]]:
        """What becomes of each ping, and each session's facts in the end; pings come by session, time and number.

        Streaks are counted as if nothing halted. A session halts behind the first ping that reaches a limit, and what was counted after it doesn't hold.
        """
        n = len(data["timestamp"])
        state = [s or (float("-inf"), 0, 0, 0, 0, 0, None, 0) for s in before]
        at, pings0, saturated0, silent0, _, _, last0, repeats0 = map(np.array, zip(*((*s[:6], FAILURES.index(s[6]), s[7]) for s in state)))
        sizes = np.diff(np.append(starts, n))
        session, first = np.repeat(np.arange(len(starts)), sizes), np.repeat(starts, sizes)
        time = data["timestamp"].astype(float)
        earlier = np.fmax(np.r_[-np.inf, time[:-1]], at[session])
        earlier[starts] = at
        ok = np.flatnonzero(time > earlier)
        begin = np.flatnonzero(np.diff(session[ok], prepend=-1))
        whose = session[ok][begin]
        true = lambda name: data[name][ok].astype(bool)
        saturated, silent = _streak(~true("saturated"), begin, saturated0[whose]), _streak(true("n_detections"), begin, silent0[whose])
        why = np.select([true("saturated"), true("sanitized"), data["blast_amplitude"][ok] <= 0, silent >= 5], [1, 2, 3, 4], 0)
        same = np.r_[0, why[:-1]]
        same[begin] = last0[whose]
        repeats = np.where(why > 0, _streak(why != same, begin, repeats0[whose] - 1) + 1, 0)
        pings = _streak(np.zeros(len(ok), bool), begin, pings0[whose])

        # what stands after each ping: the last accepted one's, or what the session began with
        here = np.full(n, -1)
        here[ok] = np.arange(len(ok))
        limit = np.zeros(n, int)
        limit[ok] = np.where(pings >= MOST_PINGS, 1, np.where(repeats >= REPEATED_FAILURES, 2, 0))
        limit0 = np.where(pings0 >= MOST_PINGS, 1, np.where(repeats0 >= REPEATED_FAILURES, 2, 0))
        stopped = np.cumsum(limit > 0)
        stopped = stopped - (limit > 0) - (stopped - (limit > 0))[first] + (limit0 > 0)[session]  # limits reached before each ping
        accepted = (here >= 0) & (stopped == 0)
        last = np.maximum.accumulate(np.where(accepted, np.arange(n), -1))
        old = last < first
        upto = here[last]  # where old, it isn't looked at
        now = lambda new, begun: np.where(old, begun[session], new[upto] if len(new) else 0)
        halted = np.where(stopped > 0, np.where(old, limit0[session], limit[last]), 0)
        steps = {"accepted": accepted, "saturated_streak": now(saturated, saturated0), "silent_streak": now(silent, silent0)}
        steps["failure"] = np.array(FAILURES, object)[np.where(accepted, now(why, last0), 0)]
        steps["halt"] = np.array((None, "iteration-budget", "repeated-failure"), object)[halted]
        ends = starts + sizes - 1
        facts = [now(time[ok], at), now(pings, pings0), steps["saturated_streak"], steps["silent_streak"], now(why, last0), now(repeats, repeats0)]
        return steps, [(*x, FAILURES[w], r) for *x, w, r in zip(*(x[ends].tolist() for x in facts))]

    def _fold(self, ping: np.ndarray, voxel: np.ndarray, delta: np.ndarray, accepted: np.ndarray, code: np.ndarray, names: list, new: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """By how much each ping changes its session's numbers of occupied and of known voxels."""
        g = self.grid
        occupied, known = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        some = accepted[ping]
        ping, voxel, delta = ping[some], voxel[some], delta[some]
        if not len(ping):
            return occupied, known
        order = np.lexsort((ping, voxel, code[ping]))
        ping, voxel, delta = ping[order], voxel[order], delta[order].astype(float)
        whose = code[ping]
        starts = np.flatnonzero((np.diff(voxel, prepend=voxel[0] - 1) != 0) | (np.diff(whose, prepend=-1) != 0))
        keys = list(zip(whose[starts].tolist(), voxel[starts].tolist()))
        blocks: dict[tuple[int, int], dict] = {(s, v // BLOCK): {} for s, v in keys}
        for s, b in blocks:
            if not new[s]:
                blocks[s, b] = dict(zip(*(self.cells.getValue((names[s], b)) or ((), ()))))
        first = np.array([blocks[s, v // BLOCK].get(v, 0.0) for s, v in keys])
        after = clamped.prefixes(delta, starts, first, g.low, g.high)
        before = np.r_[0.0, after[:-1]]
        before[starts] = first
        np.add.at(occupied, ping, (after >= g.occupied).astype(int) - (before >= g.occupied))
        np.add.at(known, ping, (after != 0).astype(int) - (before != 0))
        for (s, v), odds in zip(keys, after[np.append(starts[1:], len(after)) - 1].tolist()):
            blocks[s, v // BLOCK][v] = odds
        for (s, b), held in blocks.items():
            self.cells.updateValue((names[s], b), (list(held), list(held.values())))
        return occupied, known

    def close(self) -> None:
        pass


def scans(stream: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """A row for each ping of a stream of processed pings; needs the RocksDB state store.

    What a step needs of a ping goes there as one array of numbers (time, flags, blast, voxels, deltas), since Python pays for each column of each
    row; voxels are below 2^53. Flags that are null count as not raised. The sessions of one of SHARDS keys take their steps in one call.
    """
    flags = F.coalesce(F.col("saturated").cast("int"), F.lit(0)) + F.when(F.col("sanitized") > 0, 2).otherwise(0) + F.when(F.col("n_detections") > 0, 4).otherwise(0)
    step = F.array(F.col("timestamp").cast("double"), flags.cast("double"), F.col("blast_amplitude").cast("double"))
    evidence = [F.coalesce(F.col(f"evidence.{c}").cast("array<double>"), F.array().cast("array<double>")) for c in ("voxel", "delta")]
    shard = F.pmod(F.xxhash64("session_id"), F.lit(SHARDS)).alias("shard")
    rows = stream.select(shard, F.col("session_id").cast("string"), F.col("ping").cast("long"), F.concat(step, *evidence).alias("numbers"))
    return rows.groupBy("shard").transformWithStateInPandas(Scan(grid), StructType.fromDDL(STEP), "append", "none")


# ---- control --------------------------------------------------------------------------------------


def progress(signature: str, coverage: float) -> str:
    """What must change for a sweep to count as progress: the map, or coverage in sixtieths."""
    return f"{signature}|cov{int(coverage * 60 + 0.5)}"


def progress_of(signature: Column, coverage: Column) -> Column:
    """The same for columns."""
    return F.concat(signature, F.lit("|cov"), F.floor(coverage * 60 + 0.5).cast("string"))


def halt_of(pings: Column, repeats: Column) -> Column:
    """Why a session takes no more pings, or null."""
    return F.when(pings >= MOST_PINGS, "iteration-budget").when(repeats >= REPEATED_FAILURES, "repeated-failure")


def outcome(reason: Column) -> Column:
    """What a reason to stop means, or null."""
    return F.coalesce(*[F.when(reason == k, v) for k, v in MEANING.items()])


def halt(sweeps: list[dict], pings: int) -> str | None:
    """Why to stop before the next sweep: the ping budget first, then the same failure again and again, then sweeps without progress.

    This reducer is our own; it sees one summary for each sweep of a session, {progress, failures}.
    """
    if pings >= MOST_PINGS:
        return "iteration-budget"
    streak = 0
    for a, b in zip([None, *(f for s in sweeps for f in s["failures"])], (f for s in sweeps for f in s["failures"])):
        streak = 0 if b is None else streak + 1 if a == b else 1
        if streak >= REPEATED_FAILURES:
            return "repeated-failure"
    last = [s["progress"] for s in sweeps[-STALLED_SWEEPS:]]
    return "no-progress" if len(last) == STALLED_SWEEPS and len(set(last)) == 1 else None


def checkpoint(state: dict) -> dict:
    """State with a digest of it."""
    return state | {"digest": hashlib.sha256(json.dumps(state, sort_keys=True).encode()).hexdigest()}


def verify(saved: dict) -> bool:
    return checkpoint({k: v for k, v in saved.items() if k != "digest"})["digest"] == saved.get("digest")


def restore(saved: dict) -> dict:
    if not verify(saved):
        raise ValueError("checkpoint doesn't match its digest")
    return {k: v for k, v in saved.items() if k != "digest"}


# ---- snapshots of a stream's state ----------------------------------------------------------------

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _source(spark: SparkSession, location: str, name: str, batch: int | None) -> DataFrame:
    return spark.read.format("statestore").options(stateVarName=name, **({} if batch is None else {"batchId": batch})).load(location)


def held_facts(spark: SparkSession, location: str, batch: int | None = None) -> DataFrame:
    """What the state of a stream of ``scans`` says of each session: session_id, partition_id, ``facts``. Its voxels aren't read."""
    return _source(spark, location, "facts", batch).select(F.col("user_map_key.session_id"), "partition_id", F.col("user_map_value").alias("facts"))


def held_voxels(spark: SparkSession, location: str, batch: int | None = None) -> DataFrame:
    """The voxels that it holds: session_id, partition_id, voxel, log_odds."""
    return _source(spark, location, "cells", batch).select(F.col("user_map_key.session_id"), "partition_id", F.inline(F.arrays_zip("user_map_value.voxels", "user_map_value.log_odds")).alias("voxel", "log_odds"))


def held(spark: SparkSession, location: str, batch: int | None = None) -> DataFrame:
    """The state of a stream of ``scans``, as its last (or a stated) batch left it: session_id, partition_id, voxel with log_odds, or ``facts`` without a voxel."""
    facts = held_facts(spark, location, batch)
    cells = held_voxels(spark, location, batch).withColumn("facts", F.lit(None).cast(facts.schema["facts"].dataType))
    return facts.select("session_id", "partition_id", F.lit(None).cast("long").alias("voxel"), F.lit(None).cast("double").alias("log_odds"), "facts").unionByName(cells)


def _sums(rows: DataFrame) -> list[list]:
    """(partition, entries, sum of their digests) of each state partition: sums need no order and merge across tasks."""
    mark = F.sha2(F.to_json(F.struct("session_id", "voxel", "log_odds", "facts")), 256)
    lane = lambda at: F.sum(F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(38,0)"))
    parts = rows.groupBy("partition_id").agg(F.count(F.lit(1)), lane(1), lane(16)).orderBy("partition_id").collect()  # one row for each state partition
    return [[r[0], r[1], str(r[2]), str(r[3])] for r in parts]


def seal(spark: SparkSession, location: str) -> dict:
    """What a stream's state holds after its last batch, partition by partition, with a digest of it all."""
    batch = spark.read.format("state-metadata").load(location).agg(F.max("maxBatchId")).first()[0]
    return checkpoint({"batch": batch, "partitions": _sums(held(spark, location, batch))})


def sealed(spark: SparkSession, location: str, seal: dict) -> bool:
    """Whether the state of the sealed batch is still what was sealed."""
    return verify(seal) and _sums(held(spark, location, seal["batch"])) == seal["partitions"]


def resume(stream: DataFrame, location: str, seal: dict | None, grid: Grid = Grid()) -> DataStreamWriter:
    """Go on with a stream of scans whose state lies at ``location``; ValueError where it isn't what was sealed."""
    if seal is not None and not sealed(stream.sparkSession, location, seal):
        raise ValueError("state doesn't match its seal")
    return scans(stream, grid).writeStream.option("checkpointLocation", location)
