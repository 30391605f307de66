import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.config import Grid
from tidewick.functions import geometry as G
from tidewick.functions import numbers as N
from tidewick.operators import memory, micromotion, occupancy, policy, scoring
from tidewick.sources import presence, wire
from tidewick.streaming import session

PING = "session_id string, ping long, origin struct<x:double,y:double,z:double>, beam struct<x:double,y:double,z:double>, saturated boolean, sanitized long, blast_amplitude double, range_step_m double, detections array<struct<range_m:double,amplitude:double,snr_db:double,width_m:double>>"


def ping(n, beam=(0.0, 1.0, 0.0), detections=(), saturated=False, blast=1.0, sanitized=0):
    return ("s", n, (0.0, 0.0, 0.0), beam, saturated, sanitized, blast, 0.003575, [tuple(map(float, d)) for d in detections])


def test_cone_voxels_equal_brute_force(spark):
    g = Grid(extent_m=1.0, voxel_m=0.1)
    beam = np.array([0.3, 0.8, -0.2])
    beam = beam / np.linalg.norm(beam)
    rows = spark.createDataFrame([("s", 1, (0.05, 0.0, 0.0), tuple(map(float, beam)), 0, 0.3, 0.8, 1.0)], "session_id string, ping long, origin struct<x:double,y:double,z:double>, beam struct<x:double,y:double,z:double>, order int, lo double, hi double, delta double")
    got = {r.voxel for r in occupancy.cone_voxels(rows, g).select("voxel").collect()}
    c = (np.arange(g.dim) + 0.5) * g.voxel_m - g.extent_m
    z, y, x = np.meshgrid(c, c, c, indexing="ij")
    d = np.stack([x - 0.05, y, z], -1)
    r2, along = (d**2).sum(-1), d @ beam
    want = np.flatnonzero(((r2 >= 0.09) & (r2 <= 0.64) & (along > 0) & (along**2 >= math.cos(math.radians(30)) ** 2 * r2)).ravel())
    assert got == set(want.tolist())


def test_first_writer_wins_and_order_matters(spark):
    wall = [(2.0, 0.1, 25.0, 0.07)]
    pings = spark.createDataFrame([ping(1, detections=wall), ping(2, detections=wall), ping(3)], PING)
    once = occupancy.evidence(pings.where("ping = 1"), 0.6, 6.0)
    assert once.groupBy("voxel").count().where("count > 1").count() == 0
    signs = {r.s for r in once.select(F.signum("delta").alias("s")).distinct().collect()}
    assert signs == {1.0, -1.0}
    m = occupancy.integrate(pings, 0.6, 6.0)
    s = occupancy.summary(m).first()
    assert s.occupied == 0 and s.known > 1000 and s.signature.startswith("bv1:")
    assert occupancy.summary(occupancy.integrate(pings.where("ping < 3"), 0.6, 6.0)).first().occupied > 100
    # a saturated ping writes no echo but still clears to the full range
    sat = occupancy.evidence(spark.createDataFrame([ping(1, detections=wall, saturated=True)], PING), 0.6, 6.0)
    assert sat.where("delta > 0").count() == 0 and sat.count() > once.count()


def test_failures_are_ranked(spark):
    rows = spark.createDataFrame([ping(1, saturated=True), ping(2, sanitized=3), ping(3, blast=0.0), *[ping(i) for i in range(4, 7)], ping(7, detections=[(1, 1, 9, 0.1)])], PING)
    got = [r.failure for r in occupancy.failure(rows).orderBy("ping").collect()]
    assert got == ["saturated", "non-finite", "no-direct-path", None, "silent", "silent", None]


def test_geometry(spark):
    rows = spark.range(1).select(G.cone_rays(G.vec(F.lit(0.2), F.lit(1.0), F.lit(0.1)), 0.5, 200).alias("rays"), G.normalize(G.vec(F.lit(0.2), F.lit(1.0), F.lit(0.1))).alias("axis"), G.beam_direction(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("b"), G.normalize(G.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("zero"), G.quaternion_to(G.vec(F.lit(0.0), F.lit(0.0), F.lit(-1.0))).alias("q")).first()
    v, a = np.array([tuple(r) for r in rows.rays]), np.array(tuple(rows.axis))
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and (v @ a >= math.cos(0.5) - 1e-9).all()
    assert tuple(rows.b) == (0.0, -1.0, 0.0) and tuple(rows.zero) == (0.0, 0.0, 0.0) and rows.q == [1.0, 0.0, 0.0, 0.0]
    back = spark.range(0, 1728, 7).select("id", G.voxel_of(G.centre_of(F.col("id"), 0.6, 0.1, 12), 0.6, 0.1, 12).alias("v"))
    assert back.where("id <> v").count() == 0


def test_numbers(spark):
    assert spark.range(1).select(N.round_up_half(F.lit(-2.5)), N.round_up_half(F.lit(float("nan"))), N.significant(F.lit(123456.789), 3), N.clamp01(F.lit(7.0))).first()[:] == (-2.0, 0.0, 123000.0, 1.0)
    r = random.Random(1)
    pairs = [(r.randrange(1 << 32),) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a long").select("a", N.multiply32(F.col("a"), 0x85EBCA6B).alias("p")).collect()
    assert all(x.p == x.a * 0x85EBCA6B % (1 << 32) for x in got)


def test_micromotion_finds_a_tone_and_refuses(spark):
    n, prf, lam = 600, 15.0, 343 / 19_000
    r = np.random.default_rng(1)
    t = np.arange(n) / prf
    phase = 4 * math.pi / lam * 0.002 * np.sin(2 * math.pi * 0.3 * t)
    rows = []
    for b in range(12):
        z = 0.15 * np.exp(1j * (phase if b == 5 else 0)) + 0.001 * (r.standard_normal(n) + 1j * r.standard_normal(n))
        rows += [("d", i, b, float(v.real), float(v.imag)) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "dwell_id string, ping int, bin int, re double, im double")
    floor = spark.createDataFrame([("d", 0.002)], "dwell_id string, noise_floor double")
    out = {x.bin: x for x in micromotion.analyze(df, n, prf, lam, common_mode=False, floor=floor).collect()}
    assert out[5].status == "ok" and abs(out[5].rate_hz - 0.3) <= prf / n / 2 + 1e-9 and out[5].p_value < 1e-6 and abs(out[5].displacement_m - 0.002) < 1e-4
    assert sum(out[b].p_value < 0.001 for b in out if b != 5) == 0
    assert {x.status for x in micromotion.analyze(df, 30, prf, lam).collect()} == {"insufficient_dwell"}
    none = spark.createDataFrame([("d", 0.0)], "dwell_id string, noise_floor double")
    assert {x.status for x in micromotion.analyze(df, n, prf, lam, floor=none).collect()} == {"no_noise_floor"}
    loud = spark.createDataFrame([("d", 5.0)], "dwell_id string, noise_floor double")
    assert {x.status for x in micromotion.analyze(df, n, prf, lam, floor=loud).collect()} == {"no_return"}


def test_fisher_is_exact_for_two_and_calibrated():
    assert math.isclose(micromotion.fisher_p(0.8, 2), 2 * (1 - 0.8))
    r = np.random.default_rng(2)
    x = r.exponential(size=(20_000, 21))
    g = x.max(axis=1) / x.sum(axis=1)
    cut = micromotion.fisher_threshold(0.05, 21)
    assert abs((g >= cut).mean() - 0.05) < 3 * math.sqrt(0.05 * 0.95 / 20_000)
    assert micromotion.band_bins(600, 15.0, 0.1, 0.6) == list(range(4, 25))


def test_signatures_dont_depend_on_heading(spark):
    g = Grid()
    n = g.dim

    def room(turn, width):
        rows = set()
        for k in range(2000):
            az = k / 2000 * 2 * math.pi
            r = min(width / max(abs(math.cos(az)), 1e-6), 2.0 / max(abs(math.sin(az)), 1e-6))
            x, y, z = r * math.sin(az + turn), r * math.cos(az + turn), (k % 5 - 2) * 0.2
            i, j, q = (math.floor((v + 6) / 0.1) for v in (x, y, z))
            rows.add((q * n + j) * n + i)
        return rows

    data = [(name, v, 2.0) for name, turn, w in (("a", 0.0, 1.5), ("b", 2 * math.pi / 64 * 10, 1.5), ("c", 0.0, 4.0)) for v in room(turn, w)]
    sig = memory.signatures(spark.createDataFrame(data, "session_id string, voxel long, log_odds double"))
    v = {r.session_id: np.array(r.vector) for r in sig.collect()}
    assert all(len(x) == memory.DIM and abs(np.linalg.norm(x) - 1) < 1e-5 for x in v.values())
    assert v["a"] @ v["b"] > 0.97 > v["a"] @ v["c"]


def test_memory(spark):
    e = lambda *x: [float(i) for i in x] + [0.0] * (memory.DIM - len(x))
    store = spark.createDataFrame([("a", "A", e(1, 0), 2), ("b", None, e(0.999, 0.04), 1), ("c", "C", e(0, 1), 1)], "id string, label string, vector array<double>, observations long")
    q = spark.createDataFrame([("q", e(0, 1)), ("r", e(1, 0))], "id string, vector array<double>")
    assert [r.id for r in memory.recognize(q, store).collect()] == ["c"]  # the other's margin is too small
    text = memory.dump(store)
    assert memory.load(text).count() == 3
    bad = text.select(F.regexp_replace("value", '"version":2', '"version":1').alias("value"))
    with pytest.raises(Exception, match="room store"):
        memory.load(bad).collect()
    seen = spark.createDataFrame([("a", None, e(0, 0, 1), 5), ("z", "Z", e(1), 6)], "id string, label string, vector array<double>, at long")
    m = {r.id: r for r in memory.remember(store, seen).collect()}
    assert m["a"].observations == 3 and m["a"].label == "A" and m["a"].vector[2] == 1 and m["z"].observations == 1
    assert memory.forget(store, spark.createDataFrame([("b",)], "id string")).count() == 2


def test_levers_are_refused(spark):
    rows = spark.createDataFrame([("f0=1;f1=2", None), ("f0=1; ;f1 = 2", None), ("f0", "malformed entry"), ("=3", "malformed entry"), ("f9=1", "unknown key"), ("f0=x", "not a finite number"), ("f0=NaN", "not a finite number"), (None, "missing lever")], "t string, want string")
    got = rows.select("want", policy.lever_error(F.col("t"), ["f0", "f1"], ("f0",)).alias("why"), "t").collect()
    assert all(r.why == r.want for r in got)
    ok = rows.where("want is null").select(policy.decode_lever(F.col("t"), ["f0", "f1"], ("f0",)).alias("m")).collect()
    assert all(r.m == {"f0": "1", "f1": "2"} for r in ok)
    with pytest.raises(Exception, match="malformed"):
        rows.where("t = 'f0'").select(policy.decode_lever(F.col("t"))).collect()
    assert policy.next_detector_rung("band", "off", 1) == policy.DETECTOR_LADDERS["band"][0]
    assert policy.describe_detector("dwell", *policy.DETECTOR_LADDERS["dwell"][:2]) == "dwell: dwell_s 2 -> 12, min_cycles 1 -> 2"


def test_detector_policies_are_searched(spark):
    """Captures with and without a moving bin: the foot of the ladders decides nothing, the search finds rungs that do."""
    n, prf, lam, r = 600, 15.0, 0.018, np.random.default_rng(4)
    rows, caps = [], []
    for k, (room, body, suite) in enumerate([("r1", True, "holdout"), ("r1", False, "holdout"), ("r2", True, "anchor"), ("r2", False, "anchor")]):
        phase = 4 * math.pi / lam * 0.002 * np.sin(2 * math.pi * 0.25 * np.arange(n) / prf)
        for b in range(6):
            z = 0.15 * np.exp(1j * (phase if body and b == 3 else 0)) + 0.002 * (r.standard_normal(n) + 1j * r.standard_normal(n))
            rows += [(k, i, b, float(v.real), float(v.imag)) for i, v in enumerate(z)]
        caps.append((k, room, True, body, 0.6 + 3 * 0.02 if body else None, 6, 0.003, suite))
    dwells = spark.createDataFrame(rows, "dwell_id long, ping int, bin int, re double, im double").cache()
    captures = spark.createDataFrame(caps, "dwell_id long, room_id string, consent boolean, body_in_scene boolean, body_range_m double, bins int, noise_floor double, suite string")
    evaluate = policy.detector_evaluator(captures, dwells, prf, lam, n, 0.6, 0.02)
    root, better = evaluate(policy.bad_root_detector(), "holdout"), evaluate({"dwell": 3, "band": 4, "periodicity": 3, "common_mode": 0}, "holdout")
    assert (root["primary"], root["noop"]) == (0.0, 1.0) and better["primary"] == 1.0 and better["noop"] == 0.0 and not better["regressed"]
    with pytest.raises(ValueError, match="empty"):
        evaluate(policy.bad_root_detector(), "none")
    assert {x.abstain_reason for x in policy.evaluate_captures(captures, dwells, {"error": None, "dwell_s": 40.0, "band_low_hz": 0.1, "band_high_hz": 8.0, "alpha": 0.1, "min_snr_db": 3.0, "min_cycles": 1.0, "rejection": "off", "max_peak_m": 1.0}, prf, lam, n, 0.6, 0.02).collect()} == {"band_above_nyquist"}


def test_rooms_are_evaluated(spark):
    """One recorded wall, mapped and scored under a policy."""
    from tests.test_kernels import record

    p = {"waveform": 3, "detector": 2, "mapping": 2}
    s, _ = policy.resolve(p)
    x = record([(2.0, 0.4)], s).tolist()
    pings = spark.createDataFrame([("room", i, x, (0.0, 0.0, 0.0), (math.cos(a), math.sin(a), 0.0)) for i, a in enumerate((0.0, 1.0, 2.0) * 3)], "session_id string, ping long, samples array<double>, origin struct<x:double,y:double,z:double>, beam struct<x:double,y:double,z:double>")

    def truth(grid, reach):
        v = spark.range(grid.dim**3).select(F.lit("room").alias("session_id"), F.col("id").alias("voxel"), G.norm(G.centre_of(F.col("id"), grid.extent_m, grid.voxel_m, grid.dim)).alias("d")).where(F.col("d") <= reach)
        return v.select("session_id", "voxel", (F.col("d") >= 2).alias("solid"), (F.abs(F.col("d") - 2) <= grid.voxel_m).alias("surface"))

    row = policy.evaluate_rooms(pings, truth(policy.resolve(p)[1], s.max_range_m), p).first()
    assert row.pings == 9 and row.broken == 0 and row.emission == "allow" and 0 < row.free_iou < 1 and row.precision > 0.3 and not row.regressed
    score = policy.room_evaluator(pings, truth, {"holdout": ["room"], "anchor": []})
    assert score(p, "holdout")["primary"] == row.primary
    assert score(p, "anchor") == {"primary": 0.0, "noop": 1.0, "cost": float("inf"), "regressed": True}


def test_field_embeddings(spark):
    v = [1.0] + [0.0] * (memory.DIM - 1)
    rows = spark.createDataFrame([(v, memory.VERSION)], "vector array<double>, version int")
    e = memory.field_embeddings(rows, F.lit("event-1")).first()
    assert (e.modality, e.privacy_class, e.source_event_id, len(e.vector)) == ("ultrasonic", "P3", "event-1", memory.DIM)
    for bad, event in ((rows.withColumn("version", F.lit(1)), "x"), (rows.withColumn("vector", F.slice("vector", 1, 5)), "x"), (rows.withColumn("vector", F.transform("vector", lambda x: F.lit(float("nan")))), "x"), (rows, " ")):
        with pytest.raises(Exception, match="signature|event id"):
            memory.field_embeddings(bad, F.lit(event)).collect()


def test_policy_and_emission(spark):
    s, g = policy.resolve({"waveform": 3, "detector": 2, "mapping": 2})
    assert s.problem() is None and s.cfar_guard == 41 and g == Grid()
    for w in range(5):
        for d in range(5):
            assert policy.resolve({"waveform": w, "detector": d, "mapping": 0})[0].problem() is None
    log = policy.climb(lambda p, _: {"primary": sum(p.values()), "noop": -sum(p.values())}, dict.fromkeys(policy.LADDERS, 0), 6)
    assert all(x["promoted"] for x in log) and [x["primary"] for x in log] == sorted(x["primary"] for x in log)
    c = "fs double, f0 double, f1 double, duration_s double, amplitude double, ping_rate_hz double, tx_window string, tukey_alpha double"
    rows = [(48e3, 17_500.0, 20_500.0, 0.005, 0.6, 15.0, "hann", 1.0), (48e3, float("nan"), 20_500.0, 0.005, 0.6, 15.0, "hann", 1.0), (48e3, 17_500.0, 20_500.0, 0.005, 0.6, 26.0, "hann", 1.0), (48e3, 17_500.0, 20_500.0, 0.005, 0.6, 15.0, "hann", float("nan"))]
    assert [r.verdict for r in policy.emission(spark.createDataFrame(rows, c)).collect()] == ["allow", "deny", "gate", "allow"]


def test_scores(spark):
    p = spark.createDataFrame([(1, [(2.0, 9.0), (2.05, 12.0), (4.0, 5.0)], [2.04, 5.0]), (2, [], [])], "ping long, detections array<struct<range_m:double,snr_db:double>>, truth_ranges_m array<double>")
    a, b = scoring.score_ranges(p, 0.1).orderBy("ping").collect()
    assert (a.tp, a.fp, a.fn) == (1, 2, 1) and abs(a.rmse - 0.01) < 1e-9 and b.f1 == 1.0
    c = spark.createDataFrame([("r1", "s1"), ("r1", "s2"), ("r2", "s2"), ("r3", "s3"), ("r3", "s3"), ("r4", "s4")], "room_id string, subject_id string")
    got = scoring.split_by_component(c).collect()
    suite = {}
    for r in got:
        suite.setdefault(r.suite, set()).update({r.room_id, r.subject_id})
    assert len(suite) == 2 and not suite["holdout"] & suite["anchor"]
    with pytest.raises(ValueError):
        scoring.split_by_component(c.where("room_id = 'r4'"))
    fields = "dwell_id string, room_id string, subject_id string, consent boolean, body_in_scene boolean, body_range_m double, pings int, bins int, prf_hz double, lambda_m double, n_samples int"
    cap = lambda i, room, who, body, **kw: tuple({"dwell_id": i, "room_id": room, "subject_id": who, "consent": True, "body_in_scene": body, "body_range_m": 2.0 if body else None, "pings": 4, "bins": 2, "prf_hz": 15.0, "lambda_m": 0.018, "n_samples": 16, **kw}.values())
    corpus = lambda *rows: spark.createDataFrame(rows, fields)
    good = [cap("a", "r1", "s1", True), cap("b", "r1", None, False), cap("c", "r2", "s2", True), cap("d", "r2", None, False)]
    assert scoring.attest(corpus(*good)).count() == 4
    for bad, why in ((good[:1], "no negative"), (good[1:2], "no positive"), ([], "empty"), ([*good, cap("e", "r1", "s1", True, consent=None)], "consent"), ([*good, cap("e", "r1", "s1", True, pings=0)], "usable dwell"), ([*good, cap("e", "r1", "s1", True, n_samples=15)], "wrong length"), ([cap("a", "r", "s", True, body_range_m=float("nan")), good[1]], "no positive")):
        with pytest.raises(ValueError, match=why):
            scoring.attest(corpus(*bad))
    assert {(r.room_id, r.suite) for r in scoring.split_by_component(corpus(*good)).collect()} == {("r1", "holdout"), ("r2", "anchor")}
    with pytest.raises(ValueError, match="no negative"):  # a side that can't measure both rates
        scoring.split_by_component(corpus(*good[:3]))
    empty = spark.createDataFrame([], "id long, p struct<x:double,y:double,z:double>")
    assert scoring.chamfer(empty, empty).first().chamfer == float("inf")
    r = np.random.default_rng(1)
    pts = [r.normal(size=(n, 3)) * 3 for n in (60, 40)]
    pts[0][0] = [90.0, 0.0, 0.0]
    a, b = (spark.createDataFrame([(i, tuple(map(float, v))) for i, v in enumerate(x)], "id long, p struct<x:double,y:double,z:double>") for x in pts)
    d = np.linalg.norm(pts[0][:, None] - pts[1][None], axis=2)
    assert abs(scoring.chamfer(a, b).first().chamfer - (d.min(axis=1).mean() + d.min(axis=0).mean()) / 2) < 1e-9
    far = spark.createDataFrame([(1, (float("nan"), 0.0, 0.0))], "id long, p struct<x:double,y:double,z:double>")
    assert scoring.nearest(far, b).first().d == float("inf")


def test_outcomes(spark):
    rows = spark.createDataFrame([("hit", 5, "ok", 0.001, 0.999, 0.0), ("miss", 5, "ok", 0.6, 0.4, 0.0), ("alarm", 1, "ok", 0.001, 0.999, 0.0), ("quiet", 1, "ok", 0.7, 0.3, 0.0), ("far", 1, "ok", 0.001, 0.999, 0.0), ("moving", 5, "ok", 0.001, 0.999, 0.9), ("short", 1, "insufficient_dwell", None, None, None), ("denied", 5, "ok", 0.001, 0.999, 0.0)], "dwell_id string, bin int, status string, p_value double, micromotion_band double, common_mode_peak_m double")
    caps = spark.createDataFrame([(d, d != "denied", d not in ("alarm", "quiet"), 2.1 if d not in ("alarm", "quiet") else None, 8) for d in ("hit", "miss", "alarm", "quiet", "far", "moving", "short", "denied")], "dwell_id string, consent boolean, body_in_scene boolean, body_range_m double, bins int")
    got = {r.dwell_id: (r.outcome, r.abstain_reason) for r in scoring.outcomes(caps, rows, 0.01, 7.5, 0.6, 0.05, 1.0, 0.2).collect()}
    assert got == {"hit": ("hit", None), "miss": ("miss", None), "alarm": ("false_alarm", None), "quiet": ("correct_rejection", None), "far": ("abstain", "no_return"), "moving": ("abstain", "sensor_motion"), "short": ("abstain", "insufficient_dwell"), "denied": ("abstain", "no_consent")}


LINE = {"timestamp": 1.7e9, "source": "simulated", "device_id": "d", "beam": [0.0, 1.0, 0.0], "start_range_m": 0.3, "range_step_m": 0.02, "profile": [0.1, 0.5, 0.2], "detections": [{"range_m": 0.31, "snr_db": 12.0, "width_m": 0.05}], "noise_floor": 0.01, "blast_amplitude": 0.5, "saturated": False}


@pytest.mark.parametrize("change,rule", [({}, None), ({"timestamp": 5e9}, "timestamp"), ({"source": "x"}, "source"), ({"device_id": " "}, "device_id"), ({"device_id": "a\u0001"}, "device_id"), ({"beam": [0, 0, 0]}, "beam"), ({"range_step_m": 0}, "range_step_m"), ({"profile": []}, "profile"), ({"range_step_m": 40.0}, "span"), ({"detections": [{"range_m": 9.0, "snr_db": 1.0, "width_m": 0.1}]}, "inside"), ({"noise_floor": -1}, "levels"), ({"saturated": None}, "saturated")])
def test_wire_rules(spark, change, rule):
    row = wire.parse(spark.createDataFrame([(json.dumps(LINE | change),)], "value string")).first()
    assert row.broken == [] if rule is None else rule in row.broken


def test_wire_round_trip(spark, tmp_path):
    lines = wire.parse(spark.createDataFrame([(json.dumps(LINE),), (" ",)], "value string"))
    wire.write(lines, f"{tmp_path}/lines")
    again = wire.read(spark, f"{tmp_path}/lines")
    assert again.first() == lines.first() and again.count() == 1
    big = wire.parse(spark.createDataFrame([("x" * 300_000,)], "value string")).first()
    assert big.broken == ["bytes"]
    e = wire.field_events(lines.withColumn("seq", F.lit(7))).first()
    assert e.confidence == 0.6 and e.label == "surface_echo" and len(e.surface) == 3 and e.event_id == "d-000007"


PAIR = {
    "type": presence.TYPE,
    "consent": {"receipt_id": "r", "subject_ref": "s", "scope": presence.SCOPE, "privacy_max": presence.PRIVACY, "granted_unix_s": 1.7e9, "expires_unix_s": 1.7e9 + 3600, "withdrawal_ref": "w"},
    "provenance": {"schema": presence.TYPE, "device_id": "dev", "sequence": 1, "source": "simulated", "synthetic": True},
    "clock": {"ultrasonic_unix_s": 1.7e9 + 10, "lidar_timestamp_ns": 4_000_000_000, "lidar_domain": "arkit_uptime", "offset_s": 1.7e9 + 7, "skew_s": 0.01},
    "measurement": {"beam": [0, 2, 0], "calibration_id": "c", "prf_hz": 15.0, "lambda_m": 0.018, "pings": 4, "bins": 2, "start_range_m": 0.6, "range_step_m": 0.02, "iq": [0.1] * 16, "noise_floor": 0.01, "saturated": False},
    "teacher": {"frame_type": "lidar_depth", "sensor": "l", "sequence": 1, "range_m": 0.61, "range_confidence": 2, "sample_count": 5, "body_in_scene": True, "body_on_beam": True, "pose": [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], "intrinsics": {"fx": 1.0, "fy": 1.0, "cx": 0.0, "cy": 0.0, "image_width": 2, "image_height": 2}},
}
PAIR["clock"]["lidar_timestamp_ns"] = 3_100_000_000


@pytest.mark.parametrize("path,value,code", [("", None, None), ("type", "x", "schema_mismatch"), ("provenance.schema", "1", "schema_mismatch"), ("consent", None, "consent_missing"), ("consent", "yes", "consent_missing"), ("consent.receipt_id", ..., "consent_missing"), ("consent.scope", "x", "consent_invalid"), ("consent.expires_unix_s", 1.7e9 + 10, "consent_invalid"), ("consent.extra", 1, "unknown_field"), ("measurement.extra", 1, "unknown_field"), ("measurement.bins", ..., "unknown_field"), ("teacher.intrinsics.extra", 1, "unknown_field"), ("presence", True, "unknown_field"), ("provenance.synthetic", False, "synthetic_mismatch"), ("measurement.iq", [0.1], "invalid"), ("measurement.prf_hz", 0.0, "invalid"), ("teacher.frame_type", "x", "schema_mismatch"), ("teacher.range_m", 30.0, "invalid"), ("clock.skew_s", 0.5, "clock_skew"), ("clock.lidar_timestamp_ns", 9_000_000_000, "teacher_outside_dwell")])
def test_presence_checks(spark, path, value, code):
    pair = json.loads(json.dumps(PAIR))
    if path:
        *outer, last = path.split(".")
        at = pair
        for k in outer:
            at = at[k]
        at[last] = value
        if value is ...:
            del at[last]
    rows = presence.parse(spark.createDataFrame([(1, json.dumps(pair))], "line long, value string"))
    assert rows.first().error == code
    assert presence.verdict(rows).first().accepted == (code is None)


def test_presence_projection(spark):
    two = json.loads(json.dumps(PAIR))
    two["provenance"]["sequence"] = 2
    lines = spark.createDataFrame([(1, json.dumps(PAIR)), (2, json.dumps(two)), (3, "")], "line long, value string")
    rows = presence.parse(lines)
    assert [r.error for r in rows.orderBy("line").collect()] == [None, "non_monotonic"]
    two["provenance"]["device_id"] = "other"
    mixed = presence.parse(spark.createDataFrame([(1, json.dumps(PAIR)), (2, json.dumps(two)), (3, "{")], "line long, value string"))
    assert [r.error for r in mixed.orderBy("line").collect()] == [None, "device_mismatch", "parse"]
    assert presence.verdict(rows.where("false")).first().error == "empty"
    good = rows.where("error is null")
    d, t = presence.dwells(good), presence.labels(good)
    assert not {"body_in_scene", "body_on_beam", "range_m"} & set(d.columns) and d.first().beam == [0.0, 1.0, 0.0]
    assert presence.captures(d, t).first().body_range_m == 0.61
    assert presence.long_dwells(d).count() == 8
    assert presence.parse(presence.encode(good).withColumn("line", F.lit(1))).first().error is None


def test_session_control():
    assert session.halt([], 600) == "iteration-budget"
    assert session.halt([{"progress": "a", "failures": ["x", "x", "x"]}], 3) == "repeated-failure"
    assert session.halt([{"progress": "a", "failures": [None]}] * 4, 40) == "no-progress"
    assert session.halt([{"progress": str(i), "failures": [None]} for i in range(4)], 40) is None
    saved = session.checkpoint({"pings": 3})
    assert session.restore(saved) == {"pings": 3}
    with pytest.raises(ValueError):
        session.restore(saved | {"pings": 4})


def test_stream_equals_batch(spark, tmp_path):
    schema = "session_id string, ping long, timestamp double, saturated boolean, sanitized long, blast_amplitude double, n_detections long, evidence array<struct<voxel:long,delta:double>>"
    rows = [("s", i, float(t), False, 0, 1.0, int(i % 3 > 0), [(v, 0.9 if (v + i) % 3 else -0.4) for v in range(4)]) for i, t in enumerate([1, 2, 2, 3, 4])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = session.scans(stream).writeStream.format("memory").queryName("scan_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("scan_out").orderBy("ping").collect()
    assert [r.accepted for r in out] == [True, True, False, True, True]  # a time that doesn't advance is refused
    deltas = spark.createDataFrame([("s", i, v, d) for i, (_, _, _, _, _, _, _, e) in enumerate(rows) if i != 2 for v, d in e], "session_id string, ping long, voxel long, delta double")
    s = occupancy.summary(occupancy.fold(deltas)).first()
    assert (out[-1].occupied, out[-1].known) == (s.occupied, s.known)


def test_event_windows_of_a_stream(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 3).alias("user_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 600).alias("ts"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df in (("tumbling", session.windows(stream, "value")), ("sliding", session.windows(stream, "value", slide="15 minutes")), ("sessions", session.sessions(stream, "20 minutes")), ("once", session.once(stream, ["user_id", "ts"]))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() > 0
    assert spark.table("once").count() == 100
