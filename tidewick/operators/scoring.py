"""Scores: ranges against truth, point sets, captures against labels, and splits that share no room or subject."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import checkpoints as _checkpoints


def band_pairs(detections: DataFrame, truth: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Pairs of a detection and a truth within tolerance (band join on a grid of cells of that width, then the exact test)."""
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    d = detections.withColumn("cell", F.explode(F.array(cell("range_m") - 1, cell("range_m"), cell("range_m") + 1)))
    t = truth.withColumn("cell", cell("truth_m"))
    return d.join(t, [*key, "cell"]).where(F.abs(F.col("range_m") - F.col("truth_m")) <= tolerance).drop("cell")


def score_ranges(pings: DataFrame, tolerance: float) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, rmse, max_error for each row with detections and truth_ranges_m.

    One to one, greedily: the strongest detection first takes the nearest truth that is left, if that is
    within tolerance. A row's two short arrays are folded where they are.
    """
    some = F.coalesce("detections", F.array().cast(pings.schema["detections"].dataType))
    truth = F.coalesce("truth_ranges_m", F.array().cast("array<double>")).cast("array<double>")
    order = F.transform(F.array_sort(F.transform(some, lambda d, i: F.struct((-d["snr_db"]).alias("s"), i.alias("i"), d["range_m"].alias("r")))), lambda x: x["r"])
    none = F.array().cast("array<double>")

    def take(s, found):
        errors = F.transform(s["left"], lambda t: F.abs(t - found))
        e = F.array_min(errors)
        n = F.array_position(errors, e).cast("int")
        rest = F.concat(F.slice(s["left"], 1, n - 1), F.slice(s["left"], n + 1, F.size(s["left"])))
        return F.when(e <= tolerance, F.struct(rest.alias("left"), F.concat(s["errors"], F.array(e)).alias("errors"))).otherwise(s)

    rows = pings.withColumn("_e", F.aggregate(order, F.struct(truth.alias("left"), none.alias("errors")), take)["errors"])
    tp = F.size("_e").cast("long")
    rows = rows.withColumn("tp", tp).withColumn("fp", F.size(some) - tp).withColumn("fn", F.size(truth) - tp)
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(1.0)
    p, r = share("tp", "fp"), share("tp", "fn")
    squares = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e * e)
    rows = rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    rows = rows.withColumn("rmse", F.coalesce(F.sqrt(F.try_divide(squares, tp)), F.lit(0.0))).withColumn("max_error", F.coalesce(F.array_max("_e"), F.lit(0.0)))
    return rows.drop("_e", "detections", "truth_ranges_m")


#: points that a cell of the tree holds before it is split, how often space is halved at most, and how many cells of a level are broadcast
LEAF, DEPTH, BROADCAST_CELLS = 64, 20, 50_000
_AXES = "xyz"


def _box(p: str) -> tuple[Column, Column]:
    """Squared distances of a point to the nearest and to the farthest place of a cell's bounding box."""
    low = high = F.lit(0.0)
    for x in _AXES:
        v, lo, hi = F.col(f"{p}.{x}"), F.col(f"lo_{x}"), F.col(f"hi_{x}")
        low = low + F.pow(F.greatest(lo - v, v - hi, F.lit(0.0)), F.lit(2))
        high = high + F.pow(F.greatest(F.abs(v - lo), F.abs(v - hi)), F.lit(2))
    return low, high


def nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, d): for each point (id, p) of a the distance to b's nearest point, by a tree over b that is as deep as b is dense.

    Space is halved on each axis level by level, and only cells of more than LEAF points are split. Each point of a goes
    down the tree with the cells that may hold its nearest point: those whose bounding box is not farther than the farthest
    place of the best box so far. So an outlier meets few boxes of a dense cloud, never its points, and a leaf's points are at most LEAF,
    or what no DEPTH of halving tells apart. Levels are as many as the densest place takes, not as far as the farthest point is.

    A point whose place isn't finite is infinitely far, as all are where b is empty.
    """
    spark = a.sparkSession
    _checkpoints(spark)
    good = lambda df: df.where(" and ".join(f"abs(p.{x}) < double('infinity')" for x in _AXES))
    every = a.select("id")
    ends = good(b).agg(F.count(F.lit(1)).alias("n"), *[f(f"p.{x}").alias(f"{k}_{x}") for x in _AXES for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if not ends.n:
        return every.withColumn("d", F.lit(float("inf")))
    width = max(max(ends[f"hi_{x}"] - ends[f"lo_{x}"] for x in _AXES), 1e-300)
    place = {x: F.least(F.floor((F.col(f"p.{x}") - ends[f"lo_{x}"]) / width * float(1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long") for x in _AXES}
    cell = [f"c{x}" for x in _AXES]
    at = lambda level: [F.shiftright(f"k{x}", DEPTH - level).alias(f"c{x}") for x in _AXES]
    open_ = good(b).select("p").distinct().select("p", *[place[x].alias(f"k{x}") for x in _AXES]).checkpoint()
    going = good(a).select("id", F.col("p").alias("pa"), F.lit(float("inf")).alias("bound"), *[F.lit(0).cast("long").alias(f"up{x}") for x in _AXES])
    asked, held, bounds = [], [], []
    for level in range(DEPTH + 1):
        placed = open_.select("p", *[f"k{x}" for x in _AXES], *at(level))
        nodes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *[f(f"p.{x}").alias(f"{k}_{x}") for x in _AXES for k, f in (("lo", F.min), ("hi", F.max))]).withColumn("leaf", (F.col("n") <= LEAF) | F.lit(level == DEPTH)).checkpoint()
        known = nodes.select(*[F.col(c).alias(f"n{c}") for c in cell], *[F.shiftright(f"c{x}", 1).alias(f"up{x}") for x in _AXES], "leaf", *[f"{k}_{x}" for x in _AXES for k in ("lo", "hi")])
        known = F.broadcast(known) if nodes.count() <= BROADCAST_CELLS else known
        low, high = _box("pa")
        met = going.join(known, [f"up{x}" for x in _AXES]).select("id", "pa", "bound", *[F.col(f"n{c}").alias(c) for c in cell], "leaf", low.alias("low"), high.alias("high"))
        best = met.groupBy("id").agg(F.least(F.min("bound"), F.min("high")).alias("bound"))
        met = met.drop("bound", "high").join(best, "id").where(F.col("low") <= F.col("bound") * (1 + 1e-12)).checkpoint()
        bounds.append(met.select("id", "bound"))
        asked.append(met.where("leaf").select("id", "pa", "low", F.lit(level).alias("level"), *cell))
        split = nodes.where("not leaf").select(*cell)
        held.append(placed.join(nodes.where("leaf").select(*cell), cell, "left_semi").select(F.col("p").alias("pb"), F.lit(level).alias("level"), *cell))
        going = met.where("not leaf").select("id", "pa", "bound", *[F.col(f"c{x}").alias(f"up{x}") for x in _AXES])
        if split.isEmpty():
            break
        open_ = placed.join(split, cell, "left_semi").select("p", *[f"k{x}" for x in _AXES]).checkpoint()
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    final = union(bounds).groupBy("id").agg(F.min("bound").alias("bound"))
    last = union(asked).join(final, "id").where(F.col("low") <= F.col("bound") * (1 + 1e-12))
    d = F.sqrt(sum(((F.col(f"pa.{x}") - F.col(f"pb.{x}")) ** 2 for x in _AXES), F.lit(0.0)))
    found = last.join(union(held), ["level", *cell]).groupBy("id").agg(F.min(d).alias("d"))
    return every.join(found, "id", "left").select("id", F.coalesce("d", F.lit(float("inf"))).alias("d"))


def chamfer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of each point's distance to the other set's nearest, both ways; infinite if a set is empty. Rows (id, p)."""
    sides = nearest(a, b).select(F.lit(0).alias("side"), "d").unionByName(nearest(b, a).select(F.lit(1).alias("side"), "d"))
    means = sides.groupBy("side").agg(F.avg("d").alias("m"))
    return means.agg(F.coalesce(F.when(F.count(F.lit(1)) == 2, F.avg("m")), F.lit(float("inf"))).alias("chamfer"))


def score_map(truth: DataFrame, cells: DataFrame, by: list[str], known_odds: float = math.log(0.7 / 0.3)) -> DataFrame:
    """A map (by, voxel, log_odds) against truth (by, voxel, solid, surface), a row for each voxel that could be observed.

    Odds beyond a fixed level are claims, whatever the map's own settings; a voxel without evidence claims nothing.
    """
    j = truth.join(cells.select(*by, F.col("voxel").cast("long").alias("voxel"), "log_odds"), [*by, "voxel"], "left")
    lo = F.coalesce("log_odds", F.lit(0.0))
    occ, free, solid, surface = lo >= known_odds, lo <= -known_odds, F.col("solid"), F.col("surface")
    n = {"free_both": free & ~solid, "free_either": free | ~solid, "occupied": occ, "found": surface & occ, "surface": surface, "solid": solid, "solid_free": solid & free, "known": lo != 0, "open": (lo != 0) & ~occ & ~free}
    c = j.groupBy(*by).agg(*[F.count_if(x).alias(k) for k, x in n.items()])
    div = lambda a, b, other: F.coalesce(F.try_divide(F.col(a), F.col(b)), other)
    p = div("found", "occupied", F.when(F.col("surface") == 0, 1.0).otherwise(0.0))
    r = div("found", "surface", F.lit(1.0))
    s = c.select(*by, div("free_both", "free_either", F.lit(0.0)).alias("free_iou"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), div("solid_free", "solid", F.lit(0.0)).alias("false_free"), div("open", "known", F.lit(1.0)).alias("uncommitted"))
    return s.withColumn("primary", 0.5 * F.col("free_iou") + 0.5 * F.col("f1"))


OUTCOMES = ["hit", "miss", "false_alarm", "correct_rejection", "abstain"]


def bins_covering(range_m: Column, start_m, step_m, bins: Column, around: int = 1) -> tuple[Column, Column]:
    """First and last bin that cover a range, give or take ``around``; null where the dwell has no geometry or doesn't reach it."""
    to = lambda x: F.lit(None).cast("double") if x is None else F.lit(x).cast("double") if isinstance(x, (int, float)) else x
    start, step = to(start_m), to(step_m)
    centre = F.floor((range_m - F.coalesce(start, F.lit(0.0))) / step + 0.5)
    ok = (step > 0) & (centre + around >= 0) & (centre - around < bins)
    return F.when(ok, F.greatest(F.lit(0), centre - around)), F.when(ok, F.least(bins - 1, centre + around))


def take_pings(rows: DataFrame, pings: int) -> DataFrame:
    """The first pings of each dwell."""
    return rows.where(F.col("ping") < pings)


def outcomes(captures: DataFrame, bins: DataFrame, alpha: float | Column, nyquist_hz: float, band_high_hz: float | Column, sensor_motion_m: float | Column, start_range_m: float | None, range_step_m: float | None, by: list[str] | None = None) -> DataFrame:
    """One outcome, a reason for abstaining if any, and the share left undecided, for each capture.

    captures: dwell_id, consent boolean, body_in_scene boolean, body_range_m double, bins; bins: what
    micromotion.analyze returns. First reason that holds: no consent, band above Nyquist, the analysis'
    own refusal, a moving sensor; then negatives without a usable bin, and positives without range
    geometry or without a return near the body. With ``by`` (policy), both sides have such columns too, and settings may be columns:
    ``alpha`` of the bins, the others of the captures.
    """
    key = [*(by or []), "dwell_id"]
    fires = (F.col("status") == "ok") & (F.col("p_value") <= alpha)
    lo, hi = bins_covering(F.col("body_range_m"), start_range_m, range_step_m, F.col("bins"))
    placed = captures.withColumn("_lo", lo).withColumn("_hi", hi)
    seen = bins.join(placed.select(*key, "_lo", "_hi"), key)
    near = F.col("bin").between(F.col("_lo"), F.col("_hi"))
    facts = seen.groupBy(*key).agg(F.count_if(F.col("status") == "ok").alias("usable_bins"), F.bool_or(fires).alias("fires"), F.bool_or(fires & near).alias("fires_near"), F.bool_or((F.col("status") == "ok") & near).alias("usable_near"), F.max("common_mode_peak_m").alias("moved"), F.max(F.when(F.col("status").isin("insufficient_dwell", "no_noise_floor"), F.col("status"))).alias("refused"), F.max(F.when(F.col("status") == "ok", F.col("micromotion_band"))).alias("peak_score"))
    j = placed.join(facts, key, "left")
    positive = is_positive()
    whole = (
        F.when(~F.coalesce("consent", F.lit(False)), "no_consent")
        .when(F.lit(band_high_hz > nyquist_hz), "band_above_nyquist")
        .when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.col("moved") > sensor_motion_m, "sensor_motion")
    )
    usable = F.coalesce("usable_bins", F.lit(0))
    reason = F.coalesce(whole, F.when(~positive & (usable == 0), "no_return").when(positive & F.col("_lo").isNull(), "no_range_geometry").when(positive & ~F.coalesce("usable_near", F.lit(False)), "no_return"))
    outcome = F.when(reason.isNotNull(), "abstain").when(positive, F.when(F.col("fires_near"), "hit").otherwise("miss")).otherwise(F.when(F.col("fires"), "false_alarm").otherwise("correct_rejection"))
    noop = F.when(whole.isNotNull() | (F.col("bins") <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("bins") - usable) / F.col("bins"))))
    return j.select(*key, outcome.alias("outcome"), reason.alias("abstain_reason"), usable.alias("usable_bins"), "peak_score", noop.alias("noop_share"))


def is_positive() -> Column:
    """Whether a capture's label says that a body is there, at a range that can be looked at."""
    return F.coalesce(F.col("body_in_scene") & F.col("body_range_m").isNotNull() & ~F.isnan("body_range_m") & (F.abs("body_range_m") < float("inf")), F.lit(False))


def false_alarm_probability(alpha: float | Column, bins: Column) -> Column:
    """Of at least one false alarm among independent bins."""
    return F.when(bins <= 0, 0.0).otherwise(1 - F.pow(F.lit(1.0) - alpha, bins))


def suite_score(rows: DataFrame, alpha: float | Column, by: list[str]) -> DataFrame:
    """Counts, hit and false alarm rates, their difference, and whether false alarms exceed three standard deviations of what alpha promises."""
    count = {o: F.count_if(F.col("outcome") == o) for o in OUTCOMES}
    p = F.when(F.col("outcome").isin("false_alarm", "correct_rejection"), false_alarm_probability(alpha, F.col("usable_bins")))
    hit = F.coalesce(F.try_divide(count["hit"], count["hit"] + count["miss"]), F.lit(0.0))
    fa = F.coalesce(F.try_divide(count["false_alarm"], count["false_alarm"] + count["correct_rejection"]), F.lit(0.0))
    expected, spread = F.coalesce(F.sum(p), F.lit(0.0)), F.sqrt(F.coalesce(F.sum(p * (1 - p)), F.lit(0.0)))
    noop = [F.avg("noop_share").alias("noop_rate")] if "noop_share" in rows.columns else []
    return rows.groupBy(*by).agg(*[c.alias(o) for o, c in count.items()], hit.alias("hit_rate"), fa.alias("fa_rate"), (hit - fa).alias("primary"), (count["false_alarm"] > expected + 3 * spread).alias("over_budget"), *noop)


#: what each gate of a corpus is called
GATES = ("empty corpus", "a capture without consent", "a capture without a usable dwell", "a dwell of the wrong length", "no positive capture", "no negative capture")


def attest(captures: DataFrame, suite: str | None = None) -> DataFrame:
    """The captures, or ValueError that names the first corpus-level gate that fails.

    Where captures say so (pings, bins, prf_hz, lambda_m, n_samples), dwells must have a positive shape and
    rate, and as many values as that takes, two for each ping and bin.
    """
    has = set(captures.columns)
    shape = F.lit(False)
    for c in {"pings", "bins", "prf_hz", "lambda_m"} & has:
        shape = shape | ~F.coalesce(F.col(c) > 0, F.lit(False))
    length = F.coalesce(F.col("n_samples") != 2 * F.col("pings") * F.col("bins"), F.lit(True)) if {"pings", "bins", "n_samples"} <= has else F.lit(False)
    f = captures.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("consent", F.lit(False))).alias("unconsented"), F.count_if(shape).alias("shape"), F.count_if(length).alias("length"), F.count_if(is_positive()).alias("positive")).first()
    failed = (f.n == 0, f.unconsented > 0, f["shape"] > 0, f["length"] > 0, f.positive == 0, f.positive == f.n)
    for bad, why in zip(failed, GATES):
        if bad:
            raise ValueError(why if suite is None else f"{suite}: {why}")
    return captures


def components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(node, label) of a bipartite graph, nodes prefixed by side: the least label spreads over both sides until nothing changes.

    Labels also jump to their label's label, so rounds grow with the logarithm of a component's diameter.
    """
    e = edges.select(F.concat(F.lit("a:"), F.col(a).cast("string")).alias("x"), F.concat(F.lit("b:"), F.col(b).cast("string")).alias("y")).distinct()
    _checkpoints(e.sparkSession)
    both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).checkpoint()
    labels = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label"))
    labels = labels.checkpoint()
    for _ in range(rounds):
        near = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        step = labels.join(near, "x").select("x", F.least("label", "l").alias("label"))
        jump = step.join(labels.select(F.col("x").alias("label"), F.col("label").alias("up")), "label", "left").select("x", F.least("label", F.coalesce("up", "label")).alias("label")).checkpoint()
        changed = jump.join(labels.withColumnRenamed("label", "old"), "x").where("label <> old").limit(1).count()
        labels = jump
        if not changed:
            return labels.select(F.col("x").alias("node"), "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: components of a labelled corpus that a split can deal out
MOST_COMPONENTS = 100_000


def split_by_component(captures: DataFrame, room: str = "room_id", subject: str = "subject_id") -> DataFrame:
    """Add ``suite`` (holdout or anchor) so that the two share no room and no subject; at least two components are needed.

    Components go, largest first, to the suite that is smaller so far. A capture without a subject joins no
    rooms. Where captures are labelled, each suite must pass ``attest``.
    """
    rooms = captures.select(F.concat(F.lit("a:"), F.col(room).cast("string")).alias("node")).distinct()
    found = components(captures.where(F.col(subject).isNotNull()), room, subject)
    labels = rooms.join(found, "node", "left").select(F.substring("node", 3, 1 << 20).alias("_r"), F.coalesce("label", "node").alias("label"))
    named = captures.join(labels, F.col(room).cast("string") == F.col("_r")).drop("_r")
    counted = named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    if counted.count() > MOST_COMPONENTS:
        raise ValueError(f"more than {MOST_COMPONENTS} components")
    sizes = counted.orderBy(F.col("n").desc(), "label").collect()
    if len(sizes) < 2:
        raise ValueError("fewer than two components")
    totals, suite = {"holdout": 0, "anchor": 0}, []
    for r in sizes:
        to = min(totals, key=lambda k: (totals[k], k != "holdout"))
        totals[to] += r.n
        suite.append((r.label, to))
    out = named.join(captures.sparkSession.createDataFrame(suite, "label string, suite string"), "label").drop("label")
    if {"consent", "body_in_scene", "body_range_m"} <= set(captures.columns):
        for name in totals:
            attest(out.where(F.col("suite") == name), name)
    return out


def latest_before(events: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """As-of join: for each event the last mark of its key at or before it, in one pass over the union (one shuffle, no pairs)."""
    u = events.select(key, at, F.lit(1).alias("_side"), F.struct(*[c for c in events.columns if c not in (key, at)]).alias("_e"), F.lit(None).cast(marks.schema[value].dataType).alias("_v"))
    m = marks.select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(u.schema["_e"].dataType).alias("_e"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return u.unionByName(m).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(key, at, "_e.*", F.col("_v").alias(value))
