import math
import time
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewick.config import WINDOWS, Sonar, half_away
from tidewick.operators import cfar, profiles
from tidewick.operators import kernels as K

S = Sonar()
DATA = "ping long, samples array<double>"


def record(echoes, cfg=S, n=None, latency=0, direct=0.9, noise=0.002, seed=1):
    """A recording of the direct path and of (range, level) echoes."""
    n = n or cfg.record_len
    t = np.arange(n) / cfg.fs
    x = direct / cfg.amplitude * K.pulse(cfg, t - latency / cfg.fs - cfg.speaker_mic_sep_m / cfg.c)
    for r, level in echoes:
        x += level / cfg.amplitude * K.pulse(cfg, t - latency / cfg.fs - 2 * r / cfg.c)
    return x + noise * np.random.default_rng(seed).standard_normal(n)


def ranges(spark, records, cfg=S):
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(records)], DATA)
    return {r.ping: [d.range_m for d in r.detections] for r in profiles.profiles(rows, cfg, ["ping"], max(map(len, records))).select("ping", "detections").collect()}


def test_walls_are_ranged_whatever_the_latency(spark):
    records = [record([(2.4, 0.3)]), record([(1.2, 0.3), (2.6, 0.3)]), record([]), *[record([(3.0, 0.3)], latency=n, n=S.record_len + 10_000) for n in (0, 137, 2048, 9311)]]
    n = max(map(len, records))
    got = ranges(spark, [np.pad(x, (0, n - len(x))) for x in records])
    assert len(got[0]) == 1 and abs(got[0][0] - 2.4) < 0.01
    assert len(got[1]) == 2 and abs(got[1][0] - 1.2) < 0.02 and abs(got[1][1] - 2.6) < 0.02
    assert got[2] == []
    found = [got[i][0] for i in range(3, 7)]
    assert all(abs(f - 3) < 0.02 for f in found) and max(found) - min(found) < 0.01


def test_the_latest_emission_is_picked(spark):
    pri, n = 3200, 24_000
    s = replace(S, pri_samples=pri, max_range_m=3.0)
    one = record([(2.0, 0.1)], s, n, direct=0.5, noise=0.0)
    x = np.zeros(n)
    for k, gain in enumerate((1.8, 1.0, 1.0, 1.0)):
        x[k * pri :] += gain * one[: n - k * pri]
    env = spark.createDataFrame([(1, x.tolist())], DATA)
    env = K.compress(env, s, n).select("envelope")
    at, alone = env.select(profiles.arrival(F.col("envelope"), s), profiles.arrival(F.col("envelope"), replace(s, pri_samples=0))).first()
    assert 2 * pri < at < int(s.direct_search_s * s.fs) and alone < pri


@given(st.lists(st.one_of(st.floats(allow_nan=True, allow_infinity=True, width=32), st.just(0.0)), max_size=600))
@settings(max_examples=60, deadline=None)
def test_any_samples_give_an_envelope(x):
    import pyarrow as pa

    v = K.records(pa.array([x, None, [1.0]], pa.list_(pa.float64())), 2000)
    bad = ~np.isfinite(v)
    assert bad.sum() == sum(not math.isfinite(s) for s in x)
    v[bad] = 0
    assert np.isfinite(K.matched_filter(S, 2000).envelope(v, 2000)).all()


def test_any_input_gives_a_profile(spark):
    rows = spark.createDataFrame([(1, [float("nan")] * 50 + [float("inf"), 0.5]), (2, []), (3, None), (4, [0.0] * 3000)], DATA)
    got = {r.ping: r for r in profiles.profiles(rows, S, ["ping"], 2000).collect()}
    assert [got[i].sanitized for i in (1, 2, 3, 4)] == [51, 0, 0, 0]
    assert all(r.detections == [] or r.ping == 1 for r in got.values()) and len(got) == 4
    assert profiles.profiles(rows.where("false"), S, ["ping"], 2000).count() == 0


def brute_separate(x, prominence_db, separation):
    depth, kept = 10 ** (-prominence_db / 20), []
    maxima = [i for i in range(len(x)) if (i == 0 or x[i] >= x[i - 1]) and (i == len(x) - 1 or x[i] > x[i + 1])]
    for m in sorted(maxima, key=lambda i: (-x[i], i)):
        if all(abs(k - m) >= separation and min(x[min(k, m) : max(k, m) + 1]) <= x[m] * depth for k in kept):
            kept.append(m)
    return sorted(kept)


def test_echoes_of_a_span():
    r = np.random.default_rng(1)
    spans = [[1.0, 1.0, 1.0], [0.1, 5.0, 0.1, 4.0, 0.1, 0.15], [2.0], *[np.round(r.random(n) * 4, 2).tolist() for n in (5, 12, 30, 60, 700)]]
    lengths = np.array([len(x) for x in spans])
    got = {}
    for k, *e in profiles.separate(np.concatenate(spans), np.cumsum(lengths) - lengths, 6.0, 2):
        got.setdefault(k, []).append(tuple(e))
    assert len(got[0]) == 1 and got[1] == [(1, 0, 2), (3, 2, 6)] and got[2] == [(0, 0, 1)]
    for i, x in enumerate(spans):
        assert [e[0] for e in got[i]] == brute_separate(x, 6.0, 2)
        assert got[i][0][1] == 0 and got[i][-1][2] == len(x) and all(a[2] == b[1] for a, b in zip(got[i], got[i][1:]))


def test_a_span_of_very_many_cells():
    """Twelve times the cells take about twelve times as long, not a hundred and forty-four."""
    r, times = np.random.default_rng(3), []
    for n in (10_000, 120_000):
        x = r.random(n) + 1
        t = time.perf_counter()
        assert len(profiles.separate(x, np.array([0]), 1.0, 3)) > n / 20
        times.append(time.perf_counter() - t)
    assert times[1] < 60 * times[0]


def test_cells_of_spans(spark):
    """Only cells from a span's first to its last go on, and each is in the span that ``spans`` says."""
    r = np.random.default_rng(8)
    rows = spark.createDataFrame([(k, i, float(v)) for k in range(3) for i, v in enumerate(r.random(200))], "k int, i int, v double").withColumn("threshold", F.lit(0.7))
    for gap in (0, 1, 4):
        spans = [(s.k, s.first, s["last"]) for s in cfar.spans(rows, "v", ["k"], gap).collect()]
        want = sorted((k, i) for k, a, b in spans for i in range(a, b))
        cells = cfar.span_cells(rows, "v", ["k"], gap)
        assert sorted((c.k, c.i) for c in cells.collect()) == want
        assert sorted((c.k, c.a, c.b + 1) for c in cells.groupBy("k", "span").agg(F.min("i").alias("a"), F.max("i").alias("b")).collect()) == sorted(spans)


@pytest.mark.parametrize("name", WINDOWS)
def test_tapers_are_symmetric(name):
    x = np.linspace(0, 1, 101)
    v = K.taper(name, x, 0.5)
    assert np.allclose(v, v[::-1]) and v.max() <= 1 + 1e-9 and (K.taper(name, np.array([-0.1, 1.1])) == 0).all()


def test_compression_is_a_correlation():
    s = replace(S, rx_taper="rect")
    x = record([(1.5, 0.4)], s, 4000, noise=0.0)
    mf = K.MatchedFilter(s, 4000)
    direct = np.array([abs(np.vdot(K.pulse(s, np.arange(s.pulse_samples) / s.fs, True), x[i : i + s.pulse_samples])) for i in range(0, 3000, 50)])
    fast = mf.envelope(x[None, :], 3000)[0, ::50]
    assert np.corrcoef(direct, fast)[0, 1] > 0.99
    assert int(np.argmax(mf.acf)) == 0 and abs(mf.acf[0] - 1) < 1e-6


def test_ranges_and_lags_are_inverse():
    for r in (0.5, 2.0, 5.9):
        assert abs(S.range_at(S.lag_for(r)) - r) < 1e-9
    assert S.record_len == 13_919 and K.next_pow2(S.record_len + S.pulse_samples) == 16_384
    assert Sonar(tx_window="nope").tx_window == "hann" and Sonar(cfar_kind="nope").cfar_kind == "ca"
    assert [half_away(v) for v in (-2.5, -0.4, 0.5, 1.5)] == [-3, 0, 1, 2]


@pytest.mark.parametrize("kind", ["ca", "os"])
def test_alpha_keeps_the_full_count(spark, kind):
    s = replace(S, cfar_train=8, cfar_guard=2, cfar_kind=kind)
    assert math.isclose(s.alpha, 16 * (s.cfar_pfa ** (-1 / 16) - 1))
    rows = spark.range(30).select(F.lit(1).alias("k"), "id", F.lit(1.0).alias("v"))
    assert all(abs(r.threshold - math.sqrt(s.alpha)) < 1e-9 for r in cfar.threshold(rows, "v", ["k"], ["id"], s).collect())


def test_grouped_ranks(spark):
    r = np.random.default_rng(3)
    data = [("a", float(x)) for x in r.normal(size=501)] + [("b", 2.0)] * 7 + [("c", float(x)) for x in r.integers(0, 3, 40)] + [("d", None)]
    rows = spark.createDataFrame(data, "k string, v double")
    got = {x.k: (x.first, x.mid, x["last"]) for x in cfar.grouped_ranks(rows, ["k"], "v", {"first": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}, 16).collect()}
    for k in "abc":
        v = sorted(x for g, x in data if g == k)
        assert got[k] == (v[0], v[len(v) // 2], v[-1])
    assert set(got) == set("abc")


def test_settings_name_what_is_wrong():
    assert S.problem() is None
    for bad in (dict(fs=-1.0), dict(f1=30_000.0), dict(f0=-5.0), dict(f0=20_500.0), dict(duration_s=1e-5), dict(amplitude=2.0), dict(max_range_m=0.1), dict(cfar_train=0), dict(cfar_guard=3)):
        assert replace(S, **bad).problem()
    assert S.fit_to_rate(44_100).problem() is None


def test_heterodyne_finds_the_offset():
    fs, t = 48_000, np.arange(4800) / 48_000
    y = K.heterodyne(np.sin(2 * np.pi * 19_500 * t), fs, 19_000)
    assert abs(np.argmax(np.abs(np.fft.rfft(y))) * 10 - 500) <= 10


def test_decibels_below_the_peak(spark):
    got = spark.range(1).select(profiles.db_below_peak(F.array(F.lit(0.0), F.lit(0.1), F.lit(1.0)))).first()[0]
    assert got == [-60.0, -20.0, 0.0]
