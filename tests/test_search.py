"""A search whose generations are one job each says what the search policy by policy says."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.operators import micromotion, policy


@pytest.mark.parametrize("seed", range(6))
def test_same_log_as_one_by_one(seed):
    r = random.Random(seed)
    ladders = {"a": ["x"] * 4, "b": ["x"] * 3, "c": ["x"] * 5}
    scores, jobs = {}, []

    def score(p, suite):
        return scores.setdefault((policy.policy_key(p), suite), {"primary": r.random() + 0.2 * sum(p.values()), "noop": r.random() - 0.2 * sum(p.values()), "regressed": r.random() < 0.1})

    def many(policies):
        jobs.append(len(policies))
        return {(policy.policy_key(p), s): score(p, s) for p in policies for s in ("holdout", "anchor")}

    step = lambda lever, a, b: f"{lever} {a}>{b}"
    root = dict.fromkeys(ladders, 0)
    log = policy.climb_generations(many, root, 12, ladders, step)
    assert log == policy.climb(score, root, 12, ladders, step)
    asked = len({k for k, _ in scores})
    assert len(jobs) < asked and max(jobs) <= 9


def test_all_policies_in_one_plan_equal_each_alone(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(d, b, p, r.gauss(0, 1) + 3, r.gauss(0, 1)) for d in range(3) for b in range(2) for p in range(32)], "dwell_id int, bin int, ping int, re double, im double")
    policies = {
        "short": dict(take=8, low_hz=0.1, high_hz=1.0, min_snr_db=0.0, min_cycles=2.0, common_mode=True),
        "half": dict(take=16, low_hz=0.5, high_hz=2.0, min_snr_db=-9.0, min_cycles=1.0, common_mode=False),
        "whole": dict(take=32, low_hz=0.3, high_hz=3.5, min_snr_db=3.0, min_cycles=1.0, common_mode=True),
    }
    fields = ["bin", "status", "p_value", "rate_hz", "displacement_m", "common_mode_peak_m"]
    together = micromotion.analyze_all(rows, policies, 8.0, 0.02)
    for name, p in policies.items():
        mine = together.where(F.col("policy") == name).select("dwell_id", *fields)
        alone = micromotion.analyze(rows.where(F.col("ping") < p["take"]), p["take"], 8.0, 0.02, p["low_hz"], p["high_hz"], p["min_snr_db"], p["min_cycles"], p["common_mode"]).select("dwell_id", *fields)
        close = lambda rows: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows.collect())
        for x, y in zip(close(mine), close(alone), strict=True):
            assert x == y
        statuses = {x.status for x in alone.collect()}
        assert statuses == {"insufficient_dwell"} if name == "short" else statuses <= {"ok", "no_return"}


def test_a_generation_is_analysed_once_for_what_its_policies_share(spark):
    """policies that differ in nothing but alpha and peak add no rows to windows and spectra, and no text to the plan."""
    rows = spark.createDataFrame([(0, b, p, 1.0 + p % 3, 0.5) for b in range(2) for p in range(32)], "dwell_id int, bin int, ping int, re double, im double")
    caps = spark.createDataFrame([(0, True, True, 0.5, 2, 0.02, "holdout")], "dwell_id int, consent boolean, body_in_scene boolean, body_range_m double, bins int, noise_floor double, suite string")
    one = dict(dwell_s=4.0, min_cycles=1.0, band_low_hz=0.3, band_high_hz=2.0, min_snr_db=6.0, rejection="on")
    many = {f"policy number {i}": one | {"alpha": 0.01 * (i + 1), "max_peak_m": 1.0 + i} for i in range(40)}
    scores = policy.evaluate_generation(caps, rows, many, 8.0, 2.0, 32, 0.5, 0.2, ["suite"])
    assert scores.count() == 40
    assert "policy number" not in scores._jdf.queryExecution().optimizedPlan().toString()
    plan = micromotion.analyze_all(rows, {n: dict(take=32, low_hz=0.3, high_hz=2.0, min_snr_db=6.0, min_cycles=1.0, common_mode=True) for n in many}, 8.0, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert all("policy" not in line for line in plan.splitlines() if "Window" in line or "cos(" in line.lower())


def test_short_ladders_are_scored_by_one_job():
    """a search over 24 policies took a job over all dwells for each of four generations."""
    ladders, jobs = {"a": ["x"] * 6, "b": ["x"] * 4}, []
    score = lambda p, suite: {"primary": p["a"] + p["b"], "noop": -p["a"] - p["b"], "regressed": p["a"] == 2}

    def many(policies):
        jobs.append({policy.policy_key(p) for p in policies})
        return {(policy.policy_key(p), s): score(p, s) for p in policies for s in ("holdout", "anchor")}

    step = lambda lever, a, b: f"{lever} {a}>{b}"
    root = dict.fromkeys(ladders, 0)
    assert policy.climb_generations(many, root, 8, ladders, step) == policy.climb(score, root, 8, ladders, step)
    assert len(jobs) == 1 and len(jobs[0]) == 24


def test_strongest_bins_of_series_with_gaps():
    """a whole series is transformed at once; pings may be missing, and their order is of no matter."""
    r = np.random.default_rng(5)
    take, ks, metres = 32, [3, 4, 7, 9], 0.1
    pings = [r.permutation(take)[:n] for n in (32, 20, 1)]
    phases, common = [r.normal(size=len(p)) for p in pings], [r.normal(size=take), np.zeros(0), r.normal(size=take)]
    flat = lambda places, values: (np.repeat(np.arange(3), [len(v) for v in values]), np.concatenate(places), np.concatenate(values))
    got = micromotion.strongest(flat(pings, phases), flat([np.arange(len(c)) for c in common], common), 3, take, ks, metres)
    for i, (p, x) in enumerate(zip(pings, phases)):
        x = (x - (common[i][p] if len(common[i]) else 0)) * metres
        x = x - x.mean()
        power = [sum(x * np.cos(2 * np.pi * k * p / take)) ** 2 + sum(x * np.sin(2 * np.pi * k * p / take)) ** 2 for k in ks]
        assert got[0][i] == pytest.approx(sum(power), rel=1e-9, abs=1e-20) and got[1][i] == pytest.approx(max(power), rel=1e-9, abs=1e-20)
        assert got[2][i] == ks[int(np.argmax(power))] or i == 2
