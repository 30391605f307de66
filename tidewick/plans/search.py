"""A search over detector policies on recorded dwells: scores of a whole ladder from one plan, and the chain that is promoted.

The SQL evaluates the grid of both levers at once, from the formulas, and climbs it in a recursive query.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy, scan
from .recordings import _FLOOR, _KS, _LAMBDA, _METRES, _P, _PINGS_A_DWELL, _PRF, _TWO_PI, dwells
from .registry import query, r
from .tables import rounded, table

#: the two levers that are searched; the others are fixed
LEVERS = {
    "periodicity": [(0.6, 60.0), (0.3, 18.0), (0.1, 15.0), (0.03, 12.0), (0.01, 10.0), (0.001, 6.0)],
    "common_mode": [("on", 13.8), ("on", 14.6), ("on", 15.4), ("off", 20.0)],
}
LADDERS = {"periodicity": [f"alpha={a};min_snr_db={g}" for a, g in LEVERS["periodicity"]], "common_mode": [f"rejection={x};max_peak_m={m}" for x, m in LEVERS["common_mode"]]}
FIXED = {"dwell": f"dwell_s={_PINGS_A_DWELL / _PRF};min_cycles=2", "band": "band_low_hz=0.3;band_high_hz=2.0"}
GENERATIONS = 8


def captures(spark: SparkSession, d: str) -> DataFrame:
    """A body in two dwells of three; suites by turns."""
    k = F.col("dwell_id")
    suite = F.when(F.floor(k / 3) % 2 == 0, "holdout").otherwise("anchor").alias("suite")
    shape = [F.lit(x).alias(n) for n, x in (("bins", 8), ("pings", _PINGS_A_DWELL), ("n_samples", 2 * 8 * _PINGS_A_DWELL), ("prf_hz", _PRF), ("lambda_m", _LAMBDA), ("noise_floor", _FLOOR))]
    every = table(spark, d, "embeddings").where(F.size("embedding") > 0).select(F.floor(F.col("vec_id") / 8).cast("long").alias("dwell_id")).distinct()
    return every.select("dwell_id", F.lit(True).alias("consent"), (k % 3 != 0).alias("body_in_scene"), (0.5 + (k % 8) * 0.2).alias("body_range_m"), suite, *shape)


def evaluator(spark: SparkSession, d: str):
    return policy.generation_evaluator(scan.checkpointed(captures(spark, d)), dwells(spark, d), _PRF, _LAMBDA, _PINGS_A_DWELL, 0.5, 0.2, LADDERS, FIXED)


_values = lambda rows: ", ".join(f"({i}, {', '.join(map(str, x))})" for i, x in enumerate(rows))
#: CTEs up to score(a, b, suite, p, noop, over): every policy of both ladders
_SCORES = f"""ra AS (SELECT a, alpha::DOUBLE AS alpha, gate::DOUBLE AS gate FROM (VALUES {_values([(a, repr(10 ** (g / 10))) for a, g in LEVERS["periodicity"]])}) t(a, alpha, gate)),
rb AS (SELECT b, rej, most::DOUBLE AS most FROM (VALUES {_values([("true" if x == "on" else "false", m) for x, m in LEVERS["common_mode"]])}) t(b, rej, most)),
dwell AS (SELECT CAST(floor(vec_id / 8) AS BIGINT) AS dwell_id, CAST(vec_id % 8 AS INT) AS bin, CAST(i - 1 AS INT) AS ping, embedding[i]::DOUBLE AS re, embedding[i % 64 + 1]::DOUBLE AS im FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
power AS (SELECT dwell_id, bin, avg(re * re + im * im) - {_FLOOR**2!r} AS signal FROM dwell GROUP BY ALL),
okay AS (SELECT a, dwell_id, bin, signal > 0 AND signal > gate * {_FLOOR**2!r} AS usable FROM power, ra),
stepped AS (SELECT a, d.*, atan2(im, re) AS phase, re * lag(re) OVER w + im * lag(im) OVER w AS cr, im * lag(re) OVER w - re * lag(im) OVER w AS ci FROM dwell d JOIN okay USING (dwell_id, bin) WHERE usable WINDOW w AS (PARTITION BY a, dwell_id, bin ORDER BY ping)),
turned AS (SELECT *, -{_TWO_PI!r} * floor(coalesce(phase - lag(phase) OVER (PARTITION BY a, dwell_id, bin ORDER BY ping), 0) / {_TWO_PI!r} + 0.5) AS turn FROM stepped),
flat AS (SELECT *, phase + sum(turn) OVER (PARTITION BY a, dwell_id, bin ORDER BY ping ROWS UNBOUNDED PRECEDING) AS whole FROM turned),
shared AS (SELECT a, dwell_id, ping, sum(CASE WHEN coalesce(cr, 0) = 0 AND coalesce(ci, 0) = 0 THEN 0 ELSE atan2(ci, cr) END) OVER (PARTITION BY a, dwell_id ORDER BY ping ROWS UNBOUNDED PRECEDING) AS common FROM (SELECT a, dwell_id, ping, sum(cr) AS cr, sum(ci) AS ci FROM stepped GROUP BY ALL)),
peak AS (SELECT a, dwell_id, max(abs(common)) * {_METRES!r} AS peak_m FROM shared GROUP BY ALL),
series AS (SELECT a, rej, dwell_id, bin, ping, x - avg(x) OVER (PARTITION BY a, rej, dwell_id, bin) AS x FROM (SELECT a, rej, f.dwell_id, f.bin, f.ping, (whole - CASE WHEN rej THEN common ELSE 0 END) * {_METRES!r} AS x FROM flat f JOIN shared USING (a, dwell_id, ping), (VALUES (true), (false)) t(rej))),
spectrum AS (SELECT a, rej, dwell_id, bin, k, pow(sum(x * cos(-2 * pi() * k * ping / {_PINGS_A_DWELL})), 2) + pow(sum(x * sin(-2 * pi() * k * ping / {_PINGS_A_DWELL})), 2) AS power FROM series, (SELECT unnest({_KS}) AS k) GROUP BY ALL),
best AS (SELECT a, rej, dwell_id, bin, CASE WHEN sum(power) > 0 THEN max(power) / sum(power) ELSE {1 / len(_KS)!r} END AS g FROM spectrum GROUP BY ALL),
motion AS (SELECT o.a, rb.b, o.dwell_id, o.bin, usable, usable AND CASE WHEN g >= 1 THEN 0 ELSE least(1, greatest(0, {_P})) END <= alpha AS fires, coalesce(peak_m, 0) AS peak_m FROM okay o JOIN ra USING (a), rb LEFT JOIN best ON best.a = o.a AND best.rej = rb.rej AND best.dwell_id = o.dwell_id AND best.bin = o.bin LEFT JOIN peak ON peak.a = o.a AND peak.dwell_id = o.dwell_id),
cap AS (SELECT dwell_id, dwell_id % 3 <> 0 AS body, floor((dwell_id % 8) * 0.2::DOUBLE / 0.2::DOUBLE + 0.5) AS n, CASE WHEN floor(dwell_id / 3) % 2 = 0 THEN 'holdout' ELSE 'anchor' END AS suite FROM (SELECT DISTINCT dwell_id FROM dwell)),
fact AS (SELECT a, b, m.dwell_id, body, suite, count(*) FILTER (usable) AS usable, coalesce(bool_or(fires), false) AS fires, coalesce(bool_or(usable AND abs(bin - n) <= 1), false) AS near_ok, coalesce(bool_or(fires AND abs(bin - n) <= 1), false) AS near_fires, max(peak_m) AS moved, count(*) AS found FROM motion m JOIN cap USING (dwell_id) GROUP BY ALL),
told AS (SELECT a, b, suite, usable, moved > most AS shaken, (8 - usable) / 8.0::DOUBLE AS undecided, CASE WHEN moved > most OR (NOT body AND usable = 0) OR (body AND NOT near_ok) THEN 'abstain' WHEN body THEN CASE WHEN near_fires THEN 'hit' ELSE 'miss' END ELSE CASE WHEN fires THEN 'false_alarm' ELSE 'correct_rejection' END END AS outcome FROM fact JOIN rb USING (b)),
likely AS (SELECT *, CASE WHEN outcome IN ('false_alarm', 'correct_rejection') THEN CASE WHEN usable <= 0 THEN 0 ELSE 1 - pow(1 - alpha, usable) END END AS q FROM told JOIN ra USING (a)),
score AS (SELECT a, b, suite, coalesce(count(*) FILTER (outcome = 'hit') / nullif(count(*) FILTER (outcome IN ('hit', 'miss')), 0), 0) AS hit, coalesce(count(*) FILTER (outcome = 'false_alarm') / nullif(count(*) FILTER (outcome IN ('false_alarm', 'correct_rejection')), 0), 0) AS fa,
  avg(CASE WHEN shaken THEN 1 ELSE undecided END) AS noop, count(*) FILTER (outcome = 'false_alarm') > coalesce(sum(q), 0) + 3 * sqrt(coalesce(sum(q * (1 - q)), 0)) AS over FROM likely GROUP BY ALL)"""


@query(f"""
WITH {_SCORES} SELECT 'common_mode=' || b || ';periodicity=' || a AS policy, suite, {r("hit - fa")} AS "primary", {r("noop")} AS noop_rate, {r("hit")} AS hit_rate, {r("fa")} AS fa_rate, over AS regressed FROM score""")
def detector_generation(spark: SparkSession, d: str) -> DataFrame:
    """The scores of every policy of both ladders on both suites, in one plan."""
    grid = [{"periodicity": a, "common_mode": b} for a in range(len(LADDERS["periodicity"])) for b in range(len(LADDERS["common_mode"]))]
    texts = {policy.policy_key(p): FIXED | {k: LADDERS[k][p[k]] for k in LADDERS} for p in grid}
    rows = spark.createDataFrame([(n, *[t[k] for k in policy.DETECTOR_FIELDS]) for n, t in texts.items()], ["policy", *policy.DETECTOR_FIELDS])
    settings = {x.policy: x.asDict() for x in policy.resolve_detector(rows).collect()}  # a row for each policy of the grid
    s = policy.evaluate_generation(captures(spark, d), dwells(spark, d), settings, _PRF, _LAMBDA, _PINGS_A_DWELL, 0.5, 0.2, ["suite"])
    return s.select("policy", "suite", *[rounded(F.col(c)).alias(c) for c in ("primary", "noop_rate", "hit_rate", "fa_rate")], F.col("over_budget").alias("regressed"))


_LAST_A, _LAST_B = len(LEVERS["periodicity"]) - 1, len(LEVERS["common_mode"]) - 1


@query(f"""
WITH RECURSIVE {_SCORES},
base AS (SELECT hit - fa AS p FROM score WHERE a = 0 AND b = 0 AND suite = 'anchor'),
climb AS (SELECT 0 AS g, 0 AS a, 0 AS b, 0 AS ta, 0 AS tb, '' AS step, false AS won, 0.0::DOUBLE AS p
  UNION ALL SELECT g + 1, CASE WHEN w THEN ca ELSE a END, CASE WHEN w THEN cb ELSE b END, CASE WHEN g % 2 = 0 THEN CASE WHEN w THEN 0 ELSE ta + 1 END ELSE ta END, CASE WHEN g % 2 = 1 THEN CASE WHEN w THEN 0 ELSE tb + 1 END ELSE tb END,
    CASE WHEN g % 2 = 0 THEN 'periodicity ' || a || '>' || ca ELSE 'common_mode ' || b || '>' || cb END, w, CASE WHEN w THEN newp ELSE nowp END FROM (
      SELECT c.g, c.a, c.b, c.ta, c.tb, ca, cb, now.hit - now.fa AS nowp, new.hit - new.fa AS newp, (ca <> c.a OR cb <> c.b) AND new.hit - new.fa > now.hit - now.fa AND new.noop < now.noop AND NOT new.over AND anc.hit - anc.fa >= base.p AS w
      FROM (SELECT *, CASE WHEN g % 2 = 0 THEN least(a + ta + 1, {_LAST_A}) ELSE a END AS ca, CASE WHEN g % 2 = 1 THEN least(b + tb + 1, {_LAST_B}) ELSE b END AS cb FROM climb WHERE g < {GENERATIONS}) c
      JOIN score now ON now.a = c.a AND now.b = c.b AND now.suite = 'holdout' JOIN score new ON new.a = ca AND new.b = cb AND new.suite = 'holdout' JOIN score anc ON anc.a = ca AND anc.b = cb AND anc.suite = 'anchor', base))
SELECT CAST(g - 1 AS BIGINT) AS generation, step, won AS promoted, {r("p")} AS "primary" FROM climb WHERE g > 0""")
def detector_search(spark: SparkSession, d: str) -> DataFrame:
    """Which rungs are promoted, generation by generation; the ladders are short, so that one job scores them all."""
    log = policy.climb_generations(evaluator(spark, d), dict.fromkeys(LADDERS, 0), GENERATIONS, LADDERS, lambda lever, a, b: f"{lever} {a}>{b}")
    rows = spark.createDataFrame([(x["generation"], x["step"], x["promoted"], float(x["primary"])) for x in log], "generation long, step string, promoted boolean, primary double")
    return rows.withColumn("primary", rounded(F.col("primary")))
