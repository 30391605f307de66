"""Emission rules, policy levers, and a search over policies."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PING_RATE_HZ, EmissionLimits, Grid, Sonar
from ..functions.numbers import finite
from . import micromotion, occupancy, profiles, scoring

VERDICTS = ["allow", "gate", "deny"]


def emission(configs: DataFrame, limits: EmissionLimits = EmissionLimits()) -> DataFrame:
    """Add ``verdict`` (the severest finding's) and ``findings`` (check, verdict) to rows with fs, f0, f1, duration_s, amplitude, ping_rate_hz, tx_window, tukey_alpha. What isn't finite is always denied."""
    c = {k: F.col(k).cast("double") for k in ("fs", "f0", "f1", "duration_s", "amplitude", "ping_rate_hz", "tukey_alpha")}
    low, high = F.least(c["f0"], c["f1"]), F.greatest(c["f0"], c["f1"])
    duty = F.greatest(c["duration_s"], F.lit(0.0)) * F.greatest(c["ping_rate_hz"], F.lit(0.0))
    tukey = F.col("tx_window") == "tukey"
    unknown = F.lit(False)
    for k in c:
        unknown = unknown | (~finite(c[k]) if k != "tukey_alpha" else tukey & ~finite(c[k]))
    rules = [
        ("finite", "deny", unknown),
        ("amplitude", "deny", ~finite(c["amplitude"]) | (c["amplitude"] < 0) | (c["amplitude"] > limits.max_amplitude)),
        ("band", "deny", low < limits.min_frequency_hz),
        ("band", "gate", high > limits.max_frequency_hz),
        ("nyquist", "deny", high >= c["fs"] / 2),
        ("duration", "deny", ~(c["duration_s"] > 0)),
        ("duration", "gate", c["duration_s"] > limits.max_pulse_s),
        ("ping-rate", "deny", ~finite(c["ping_rate_hz"]) | (c["ping_rate_hz"] < 0)),
        ("ping-rate", "gate", c["ping_rate_hz"] > limits.max_ping_rate_hz),
        ("duty-cycle", "deny", ~finite(duty) | (duty > limits.max_duty_cycle)),
        ("taper", "gate", (F.col("tx_window") == "rect") | tukey & (c["tukey_alpha"] < 0.05)),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(check).alias("check"), F.lit(verdict).alias("verdict"))) for check, verdict, rule in rules]))
    order = F.create_map(*[x for i, v in enumerate(VERDICTS) for x in (F.lit(v), F.lit(i))])
    worst = F.coalesce(F.array_max(F.transform(found, lambda x: F.element_at(order, x["verdict"]))), F.lit(0))
    return configs.withColumn("findings", found).withColumn("verdict", F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), worst + 1))


def _entries(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")


def _key(p: Column) -> Column:
    return F.trim(F.substring_index(p, "=", 1))


def _value(p: Column) -> Column:
    return F.trim(F.regexp_replace(p, "^[^=]*=", ""))


def lever_error(text: Column, allowed: list[str] | None = None, numeric: tuple[str, ...] = ()) -> Column:
    """Why a lever's text is refused, or null: an entry without a key or value sign, a key of another lever, a number that isn't finite."""
    entries = _entries(text)
    known = F.array(*[F.lit(k) for k in allowed or []]).cast("array<string>")
    number = lambda p: F.coalesce(finite(_value(p).try_cast("double")), F.lit(False))
    bad = F.when(F.exists(entries, lambda p: ~p.contains("=") | (_key(p) == "")), "malformed entry")
    if allowed is not None:
        bad = bad.when(F.exists(entries, lambda p: ~F.array_contains(known, _key(p))), "unknown key")
    if numeric:
        bad = bad.when(F.exists(entries, lambda p: _key(p).isin(*numeric) & ~number(p)), "not a finite number")
    return F.when(text.isNull(), "missing lever").otherwise(bad)


def decode_lever(text: Column, allowed: list[str] | None = None, numeric: tuple[str, ...] = ()) -> Column:
    """``k=v;k=v`` to a map; what ``lever_error`` names is an error. Of a key given twice the last counts."""
    entries = _entries(text)
    last = F.filter(entries, lambda p, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda q: _key(q) == _key(p)))
    fields = F.map_from_entries(F.transform(last, lambda p: F.struct(_key(p), _value(p))))
    why = lever_error(text, allowed, numeric)
    return F.when(why.isNull(), fields).otherwise(F.raise_error(F.concat(F.lit("lever refused: "), why)).cast("map<string,string>"))


def encode_lever(fields: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def unknown_keys(fields: Column, allowed: list[str]) -> Column:
    return F.array_except(F.map_keys(fields), F.array(*[F.lit(k) for k in allowed]))


def same_keys(have: Column, want: list[str]) -> Column:
    """Whether two key sets are equal."""
    w = F.array(*[F.lit(k) for k in want])
    return (F.size(F.array_except(have, w)) == 0) & (F.size(F.array_except(w, have)) == 0)


# ---- the search ----------------------------------------------------------------------------------

#: fixed values: the rungs of each lever
LADDERS = {
    "waveform": [
        dict(f0=19_000, f1=20_000, duration_s=0.004, tx_window="rect", tukey_alpha=0.0, amplitude=0.45, rx_taper="rect"),
        dict(f0=18_500, f1=20_500, duration_s=0.004, tx_window="tukey", tukey_alpha=0.3, amplitude=0.5, rx_taper="rect"),
        dict(f0=18_000, f1=20_500, duration_s=0.005, tx_window="tukey", tukey_alpha=0.6, amplitude=0.55, rx_taper="rect"),
        dict(f0=17_500, f1=20_500, duration_s=0.005, tx_window="hann", tukey_alpha=1.0, amplitude=0.6, rx_taper="rect"),
        dict(f0=17_500, f1=21_500, duration_s=0.006, tx_window="hann", tukey_alpha=1.0, amplitude=0.6, rx_taper="rect"),
    ],
    "detector": [
        dict(cfar_kind="ca", guard_lobes=1.02, train_ratio=1.0, cfar_pfa=1e-2, cfar_os_rank=0.75, gap_lobes=0.25, cfar_min_prominence_db=1.0, min_snr_db=2.0),
        dict(cfar_kind="ca", guard_lobes=1.2, train_ratio=1.5, cfar_pfa=1e-3, cfar_os_rank=0.75, gap_lobes=0.6, cfar_min_prominence_db=4.0, min_snr_db=4.0),
        dict(cfar_kind="ca", guard_lobes=1.5, train_ratio=2.0, cfar_pfa=1e-4, cfar_os_rank=0.75, gap_lobes=1.0, cfar_min_prominence_db=6.0, min_snr_db=6.0),
        dict(cfar_kind="os", guard_lobes=1.5, train_ratio=2.0, cfar_pfa=1e-4, cfar_os_rank=0.6, gap_lobes=1.0, cfar_min_prominence_db=6.0, min_snr_db=6.0),
        dict(cfar_kind="os", guard_lobes=2.2, train_ratio=2.0, cfar_pfa=1e-5, cfar_os_rank=0.5, gap_lobes=1.2, cfar_min_prominence_db=8.0, min_snr_db=8.0),
    ],
    "mapping": [
        dict(beam_half_angle_deg=60.0, hit=0.3, miss=0.1, occupied=0.25, free_margin_m=0.02, snr_reference_db=40.0),
        dict(beam_half_angle_deg=45.0, hit=0.6, miss=0.25, occupied=1.0, free_margin_m=0.08, snr_reference_db=30.0),
        dict(beam_half_angle_deg=30.0, hit=0.85, miss=0.4, occupied=1.4, free_margin_m=0.15, snr_reference_db=20.0),
        dict(beam_half_angle_deg=22.0, hit=0.95, miss=0.5, occupied=1.8, free_margin_m=0.18, snr_reference_db=18.0),
        dict(beam_half_angle_deg=16.0, hit=1.1, miss=0.6, occupied=2.2, free_margin_m=0.2, snr_reference_db=15.0),
    ],
}


def resolve(policy: dict[str, int]) -> tuple[Sonar, Grid]:
    """Settings for a policy, which names a rung of each lever; detector windows are in main lobes."""
    w, d, m = (LADDERS[k][policy[k]] for k in ("waveform", "detector", "mapping"))
    s = replace(Sonar(), **w)
    guard = max(4, math.ceil(d["guard_lobes"] * s.mainlobe))
    s = replace(s, cfar_guard=guard, cfar_train=max(16, math.ceil(d["train_ratio"] * guard)), cfar_merge_gap=max(2, math.ceil(d["gap_lobes"] * s.mainlobe)), **{k: d[k] for k in ("cfar_kind", "cfar_pfa", "cfar_os_rank", "cfar_min_prominence_db", "min_snr_db")})
    return s, replace(Grid(), **m)


def next_rung(policy: dict[str, int], lever: str, stride: int = 1) -> dict[str, int]:
    return policy | {lever: min(policy[lever] + max(1, stride), len(LADDERS[lever]) - 1)}


def describe(lever: str, a: int, b: int) -> str:
    x, y = LADDERS[lever][a], LADDERS[lever][b]
    changed = [f"{k} {x[k]} -> {y[k]}" for k in y if x[k] != y[k]]
    return f"{lever}: " + (", ".join(changed) or "unchanged (ladder exhausted)")


#: fixed values: the rungs of the motion detector's levers, and which fields are numbers
DETECTOR_LADDERS = {
    "dwell": ["dwell_s=2;min_cycles=1", "dwell_s=12;min_cycles=2", "dwell_s=20;min_cycles=3", "dwell_s=30;min_cycles=3", "dwell_s=45;min_cycles=4"],
    "band": ["band_low_hz=0.2;band_high_hz=7.0", "band_low_hz=0.15;band_high_hz=4.0", "band_low_hz=0.12;band_high_hz=2.0", "band_low_hz=0.1;band_high_hz=1.2", "band_low_hz=0.1;band_high_hz=0.7"],
    "periodicity": ["alpha=0.5;min_snr_db=0", "alpha=0.1;min_snr_db=4", "alpha=0.05;min_snr_db=8", "alpha=0.01;min_snr_db=10", "alpha=0.001;min_snr_db=12"],
    "common_mode": ["rejection=off;max_peak_m=1.0", "rejection=on;max_peak_m=0.05", "rejection=on;max_peak_m=0.02", "rejection=on;max_peak_m=0.01", "rejection=on;max_peak_m=0.005"],
}
DETECTOR_FIELDS = {"dwell": ["dwell_s", "min_cycles"], "band": ["band_low_hz", "band_high_hz"], "periodicity": ["alpha", "min_snr_db"], "common_mode": ["rejection", "max_peak_m"]}
_DETECTOR_NUMBERS = ("dwell_s", "min_cycles", "band_low_hz", "band_high_hz", "alpha", "min_snr_db", "max_peak_m")


def resolve_detector(policies: DataFrame) -> DataFrame:
    """Detector policies (a column of text for each lever) with their settings, score_threshold, and ``error``: why a policy is refused, or null.

    Nothing has a default: a lever or a field that is missing refuses the policy.
    """
    why = F.coalesce(*[lever_error(F.col(k), f, tuple(x for x in f if x in _DETECTOR_NUMBERS)) for k, f in DETECTOR_FIELDS.items()])
    rows = policies.withColumn("_why", why)
    for lever, fields in DETECTOR_FIELDS.items():
        held = F.when(F.col("_why").isNull(), decode_lever(F.when(F.col("_why").isNull(), F.col(lever)).otherwise("")))
        for f in fields:
            v = F.try_element_at(held, F.lit(f))
            rows = rows.withColumn(f, v.try_cast("double") if f in _DETECTOR_NUMBERS else v)
    c = F.col
    rules = [
        ("missing field", F.greatest(*[c(f).isNull() for x in DETECTOR_FIELDS.values() for f in x])),
        ("dwell must be positive", c("dwell_s") <= 0),
        ("at least one cycle", c("min_cycles") < 1),
        ("band must be 0 < low < high", ~((c("band_low_hz") > 0) & (c("band_high_hz") > c("band_low_hz")))),
        ("alpha must lie in (0, 1)", ~((c("alpha") > 0) & (c("alpha") < 1))),
        ("SNR gate must not be negative", ~(c("min_snr_db") >= 0)),
        ("peak must be positive", ~(c("max_peak_m") > 0)),
        ("rejection must be on or off", ~c("rejection").isin("on", "off")),
    ]
    error = F.coalesce("_why", *[F.when(bad, name) for name, bad in rules])
    return rows.withColumn("error", error).withColumn("score_threshold", F.when(error.isNull(), 1 - c("alpha"))).drop("_why")


def next_detector_rung(lever: str, now: str, stride: int = 1) -> str:
    """The rung ``stride`` further up; a value off the ladder starts at its foot."""
    ladder = DETECTOR_LADDERS[lever]
    return ladder[min(ladder.index(now) + max(1, stride), len(ladder) - 1)] if now in ladder else ladder[0]


def describe_detector(lever: str, a: str, b: str) -> str:
    x, y = (dict(p.split("=") for p in t.split(";")) for t in (a, b))
    changed = [f"{k} {x.get(k)} -> {y[k]}" for k in y if x.get(k) != y[k]]
    return f"{lever}: " + (", ".join(changed) or "unchanged (ladder exhausted)")


def bad_root_detector() -> dict[str, int]:
    """The foot of every ladder."""
    return dict.fromkeys(DETECTOR_LADDERS, 0)


def aggregate(details: DataFrame) -> DataFrame:
    """One row from evaluations (primary, noop_rate, cost_per_win, regressed): means, and whether any regressed; without evaluations the worst score."""
    mean = lambda c, none: F.coalesce(F.avg(c), F.lit(none)).alias(c)
    return details.agg(mean("primary", 0.0), mean("noop_rate", 1.0), mean("cost_per_win", float("inf")), F.coalesce(F.bool_or("regressed"), F.lit(True)).alias("regressed"))


def evaluate_rooms(pings: DataFrame, truth: DataFrame, policy: dict[str, int]) -> DataFrame:
    """A row for each room (session_id) of recorded pings scored under a policy.

    pings: session_id, ping, samples, origin, beam; truth: session_id, voxel, solid, surface on the policy's
    grid. Pings are processed and mapped as the policy says; a broken ping counts as undecided, and a policy
    that may not be emitted, or that calls solid space free, regresses. Cost is pings for each point of score.
    """
    s, grid = resolve(policy)
    p = profiles.profiles(pings, s, ["session_id", "ping"])
    broken = F.col("saturated") | (F.col("sanitized") > 0) | (F.col("blast_amplitude") <= 0)
    facts = p.groupBy("session_id").agg(F.count(F.lit(1)).alias("pings"), F.count_if(broken).alias("broken"), F.count_if(F.size("detections") == 0).alias("silent"))
    cells = occupancy.integrate(p, s.min_range_m, s.max_range_m, grid)
    rate = min(PING_RATE_HZ, 1 / s.min_pri_s)
    one = pings.sparkSession.createDataFrame([(s.fs, float(s.f0), float(s.f1), s.duration_s, s.amplitude, rate, s.tx_window, s.tukey_alpha)], "fs double, f0 double, f1 double, duration_s double, amplitude double, ping_rate_hz double, tx_window string, tukey_alpha double")
    j = scoring.score_map(truth, cells, ["session_id"]).join(facts, "session_id", "left").fillna(0, ["pings", "broken", "silent"])
    share = F.when(F.col("pings") > 0, F.col("broken") / F.col("pings")).otherwise(1.0)
    return j.withColumn("noop_rate", F.least(F.lit(1.0), F.col("uncommitted") + share)).withColumn("cost_per_win", F.col("pings") / F.greatest(F.col("primary") * 100, F.lit(0.5))).join(F.broadcast(emission(one).select(F.col("verdict").alias("emission")))).withColumn("regressed", (F.col("emission") == "deny") | (F.col("false_free") > 0.15))


def room_evaluator(pings: DataFrame, truth_on: Callable[[Grid, float], DataFrame], suites: dict[str, list[str]]) -> Callable[[dict[str, int], str], dict]:
    """What ``climb`` asks: the score of a policy on a suite of recorded rooms. ``truth_on`` gives the truth on a grid within a range."""

    def evaluate(policy: dict[str, int], suite: str) -> dict:
        s, grid = resolve(policy)
        mine = F.col("session_id").isin(suites[suite])
        row = aggregate(evaluate_rooms(pings.where(mine), truth_on(grid, s.max_range_m).where(mine), policy)).first()
        return {"primary": row.primary, "noop": row.noop_rate, "cost": row.cost_per_win, "regressed": row.regressed}

    return evaluate


def evaluate_captures(captures: DataFrame, dwells: DataFrame, settings: dict, prf_hz: float, lambda_m: float, pings: int, start_range_m: float | None, range_step_m: float | None) -> DataFrame:
    """Outcomes of captures of one shape under one detector's settings (a row of ``resolve_detector``): as much of each dwell as the policy asks for."""
    if settings.get("error"):
        raise ValueError(f"detector policy refused: {settings['error']}")
    take = min(max(1, math.floor(settings["dwell_s"] * prf_hz + 0.5)), pings)
    high = settings["band_high_hz"]
    floor = captures.select("dwell_id", "noise_floor").where("noise_floor is not null") if "noise_floor" in captures.columns else None
    if high > prf_hz / 2:
        none = dwells.select("dwell_id", "bin").distinct().select("dwell_id", "bin", F.lit("band_above_nyquist").alias("status"), F.lit(1.0).alias("p_value"), F.lit(0.0).alias("micromotion_band"), F.lit(0.0).alias("common_mode_peak_m"))
    else:
        none = micromotion.analyze(scoring.take_pings(dwells, take), take, prf_hz, lambda_m, settings["band_low_hz"], high, settings["min_snr_db"], settings["min_cycles"], settings["rejection"] == "on", floor)
    return scoring.outcomes(captures, none, settings["alpha"], prf_hz / 2, high, settings["max_peak_m"], start_range_m, range_step_m)


def detector_evaluator(captures: DataFrame, dwells: DataFrame, prf_hz: float, lambda_m: float, pings: int, start_range_m: float | None, range_step_m: float | None) -> Callable[[dict[str, int], str], dict]:
    """What ``climb`` asks for detector policies; captures have a ``suite``. A suite without captures is an error, as nothing would be measured."""

    def evaluate(policy: dict[str, int], suite: str) -> dict:
        mine = scoring.attest(captures.where(F.col("suite") == suite), suite)
        texts = {k: DETECTOR_LADDERS[k][policy[k]] for k in DETECTOR_LADDERS}
        row = resolve_detector(captures.sparkSession.createDataFrame([tuple(texts.values())], [*texts])).first().asDict()
        rows = evaluate_captures(mine, dwells.join(mine.select("dwell_id"), "dwell_id", "left_semi"), row, prf_hz, lambda_m, pings, start_range_m, range_step_m)
        s = scoring.suite_score(rows.withColumn("all", F.lit(1)), row["alpha"], ["all"]).first()
        return {"primary": s.primary, "noop": s.noop_rate, "regressed": s.over_budget, "hit_rate": s.hit_rate, "fa_rate": s.fa_rate}

    return evaluate


def evaluate_generation(captures: DataFrame, dwells: DataFrame, policies: dict[str, dict], prf_hz: float, lambda_m: float, pings: int, start_range_m: float | None, range_step_m: float | None, by: list[str]) -> DataFrame:
    """Scores of all policies (settings of ``resolve_detector`` by name) on all suites, one plan for the lot: a row for each policy and ``by``."""
    wrong = {n: p["error"] for n, p in policies.items() if p.get("error")}
    if wrong:
        raise ValueError(f"detector policies refused: {wrong}")
    names = ("alpha", "band_high_hz", "max_peak_m")
    listed = F.broadcast(captures.sparkSession.createDataFrame([(n, *[float(p[k]) for k in names]) for n, p in policies.items()], f"policy string, {', '.join(f'{k} double' for k in names)}"))  # one row for each policy
    asked = captures.crossJoin(listed)
    heard = {n: p for n, p in policies.items() if p["band_high_hz"] <= prf_hz / 2}
    settings = {n: {"take": min(max(1, math.floor(p["dwell_s"] * prf_hz + 0.5)), pings), "low_hz": p["band_low_hz"], "high_hz": p["band_high_hz"], "min_snr_db": p["min_snr_db"], "min_cycles": p["min_cycles"], "common_mode": p["rejection"] == "on"} for n, p in heard.items()}
    floor = captures.select("dwell_id", "noise_floor").where("noise_floor is not null") if "noise_floor" in captures.columns else None
    bins = micromotion.analyze_all(dwells, settings, prf_hz, lambda_m, floor)
    alphas = listed.select("policy", "alpha")
    found = scoring.outcomes(asked, bins.join(alphas, "policy"), F.col("alpha"), prf_hz / 2, F.col("band_high_hz"), F.col("max_peak_m"), start_range_m, range_step_m, ["policy"])
    rows = found.join(captures.select("dwell_id", *by), "dwell_id").join(alphas, "policy")
    return scoring.suite_score(rows, F.col("alpha"), ["policy", *by])


def generation_evaluator(captures: DataFrame, dwells: DataFrame, prf_hz: float, lambda_m: float, pings: int, start_range_m: float | None, range_step_m: float | None, ladders: dict[str, list[str]] = DETECTOR_LADDERS, fixed: dict[str, str] | None = None) -> Callable[[list[dict[str, int]]], dict]:
    """What ``climb`` asks for many policies at once: their scores on every suite, from one job.

    Suites are attested once; levers that the ladders leave out have the text in ``fixed``.
    """
    spark = captures.sparkSession
    for r in captures.select("suite").distinct().collect():  # holdout and anchor
        scoring.attest(captures.where(F.col("suite") == r.suite), r.suite)

    def evaluate(policies: list[dict[str, int]]) -> dict:
        texts = {policy_key(p): (fixed or {}) | {k: ladders[k][p[k]] for k in ladders} for p in policies}
        rows = spark.createDataFrame([(n, *[t[k] for k in DETECTOR_FIELDS]) for n, t in texts.items()], ["policy", *DETECTOR_FIELDS])
        settings = {r.policy: r.asDict() for r in resolve_detector(rows).collect()}  # a row for each policy asked for
        scores = evaluate_generation(captures, dwells, settings, prf_hz, lambda_m, pings, start_range_m, range_step_m, ["suite"])
        return {(s.policy, s.suite): {"primary": s.primary, "noop": s.noop_rate, "regressed": s.over_budget, "hit_rate": s.hit_rate, "fa_rate": s.fa_rate} for s in scores.collect()}

    return evaluate


def policy_key(policy: dict[str, int]) -> str:
    return ";".join(f"{k}={v}" for k, v in sorted(policy.items()))


#: as many policies as a search has in all are scored by one job, as that takes less than a job for each generation
AT_ONCE = 32


def climb_generations(evaluate: Callable[[list[dict[str, int]]], dict], root: dict[str, int], generations: int, ladders: dict[str, list], step_text: Callable[[str, int, int], str]) -> list[dict]:
    """The search of ``climb``, with the same log, where a generation is one job: when a score is missing, all rungs that could be asked for next are evaluated with it.

    Where all ladders together have at most AT_ONCE policies, the first job evaluates them all.
    """
    known: dict = {}
    few = math.prod(map(len, ladders.values())) <= AT_ONCE
    every = [dict(zip(ladders, x)) for x in itertools.product(*(range(len(r)) for r in ladders.values()))] if few else []

    def one(policy: dict[str, int], suite: str) -> dict:
        if (policy_key(policy), suite) not in known:
            near = [policy | x for x in every] or [policy | {k: min(policy[k] + step, len(ladders[k]) - 1)} for k in ladders for step in (0, 1, 2)]
            known.update(evaluate(list({policy_key(p): p for p in near if (policy_key(p), suite) not in known}.values())))
        return known[(policy_key(policy), suite)]

    return climb(one, root, generations, ladders, step_text)


def climb(evaluate: Callable[[dict[str, int], str], dict], root: dict[str, int], generations: int = 5, ladders: dict[str, list] = LADDERS, step_text: Callable[[str, int, int], str] | None = None) -> list[dict]:
    """Hill-climb over levers in turn. Our own gate: a candidate must raise primary, strictly lower noop, not be regressed, and not fall below the root on the anchor suite. Evaluations are cached by policy and suite."""
    cache: dict = {}

    def score(p: dict, suite: str) -> dict:
        k = (tuple(sorted(p.items())), suite)
        if k not in cache:
            cache[k] = evaluate(p, suite)
        return cache[k]

    best, log = root, []
    base = score(root, "anchor")["primary"]
    levers, attempts = list(ladders), dict.fromkeys(ladders, 0)
    for g in range(generations):
        lever = levers[g % len(levers)]
        attempts[lever] += 1  # a rung that was refused is stepped over the next time
        candidate = best | {lever: min(best[lever] + attempts[lever], len(ladders[lever]) - 1)}
        now, new = score(best, "holdout"), score(candidate, "holdout")
        won = candidate != best and new["primary"] > now["primary"] and new["noop"] < now["noop"] and not new.get("regressed") and score(candidate, "anchor")["primary"] >= base
        log.append({"generation": g, "step": (step_text or describe)(lever, best[lever], candidate[lever]), "promoted": won, "primary": (new if won else now)["primary"]})
        if won:
            best, attempts[lever] = candidate, 0
    return log
