"""Waveform and range arithmetic as column expressions, over settings held in columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import WINDOWS


def speed_of_sound(t_c: Column) -> Column:
    return 331.3 * F.sqrt(F.greatest(F.lit(0.0), 1 + t_c / 273.15))


def pulse_samples(duration_s: Column, fs: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(duration_s * fs + 0.5))


def compression_gain_db(bandwidth: Column, duration_s: Column) -> Column:
    bt = bandwidth * duration_s
    return F.when(bt <= 1, 0.0).otherwise(10 * F.log10(bt))


def _lookup(name: Column, at: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in WINDOWS.items() for x in (k, v[at])])
    return F.coalesce(F.element_at(table, name), F.lit(WINDOWS["hann"][at]))


def first_sidelobe_db(name: Column) -> Column:
    return _lookup(name, 0)


def widening(name: Column) -> Column:
    return _lookup(name, 1)


def mainlobe(fs: Column, bandwidth: Column, tx: Column, rx: Column) -> Column:
    return fs / F.greatest(F.lit(1.0), bandwidth) * F.greatest(widening(tx), widening(rx))


def guard(lobe: Column) -> Column:
    return F.greatest(F.lit(4), F.ceil(1.5 * lobe))


def train(lobe: Column) -> Column:
    return F.greatest(F.lit(16), 2 * guard(lobe))


def merge_gap(lobe: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(lobe))


def cfar_alpha(train: Column, pfa: Column) -> Column:
    n = F.greatest(F.lit(1.0), 2.0 * train)
    return n * (F.pow(F.least(F.lit(0.5), F.greatest(F.lit(1e-12), pfa)), -1.0 / n) - 1)


def range_at(lag: Column, fs: Column, c: Column, separation: Column) -> Column:
    return (c * lag / fs + separation) / 2


def lag_for(range_m: Column, fs: Column, c: Column, separation: Column) -> Column:
    return (2 * range_m - separation) * fs / c


def pri_samples(fs: Column, rate_hz: Column) -> Column:
    good = ~F.isnan(rate_hz) & (rate_hz > 0) & (fs > 0)
    return F.when(good, F.floor(fs / rate_hz + 0.5)).otherwise(0)


def window_value(name: Column, x: Column, alpha: Column = None) -> Column:
    """A taper at x in [0, 1]; 0 outside."""
    alpha = F.lit(1.0) if alpha is None else alpha
    cos = lambda k: F.cos(2 * math.pi * k * x)
    a = F.least(F.greatest(alpha, F.lit(0.0)), F.lit(1.0))
    edge = F.least(x, 1 - x)
    tukey = F.when((a <= 0) | (edge >= a / 2), 1.0).otherwise(0.5 * (1 - F.cos(2 * math.pi * edge / a)))
    inside = (
        F.when(name == "rect", 1.0)
        .when(name == "hamming", 0.54 - 0.46 * cos(1))
        .when(name == "blackman", 0.42 - 0.5 * cos(1) + 0.08 * cos(2))
        .when(name == "blackman-harris", 0.35875 - 0.48829 * cos(1) + 0.14128 * cos(2) - 0.01168 * cos(3))
        .when(name == "tukey", tukey)
        .otherwise(0.5 - 0.5 * cos(1))
    )
    return F.when(x.between(0, 1), inside).otherwise(0.0)


def phase(f0: Column, f1: Column, duration_s: Column, t: Column) -> Column:
    """Phase of a linear sweep, wrapped to (-2 pi, 2 pi)."""
    return (2 * math.pi * (f0 * t + (f1 - f0) / duration_s * t * t / 2)) % (2 * math.pi)


def instantaneous_freq(f0: Column, f1: Column, duration_s: Column, t: Column) -> Column:
    """The sweep's frequency at time t, in Hz."""
    return f0 + (f1 - f0) / F.greatest(duration_s, F.lit(1e-9)) * t


def pulse_at(amplitude: Column, tx: Column, f0: Column, f1: Column, duration_s: Column, t: Column) -> Column:
    """The emitted pulse at any time; 0 outside."""
    return F.when(t.between(F.lit(0.0), duration_s), amplitude * window_value(tx, t / duration_s) * F.sin(phase(f0, f1, duration_s, t))).otherwise(0.0)


def echo_amplitude(reflectivity: Column, range_m: Column, spreading: Column, absorption: Column) -> Column:
    loss = F.least(F.greatest(2 - spreading, F.lit(0.0)), F.lit(1.0))
    return reflectivity * F.pow(F.lit(0.5), loss) * F.pow(range_m, -spreading) * F.pow(F.lit(10.0), -2 * absorption * range_m / 20)


def direct_amplitude(distance_m: Column, absorption: Column) -> Column:
    return F.pow(F.lit(10.0), -absorption * distance_m / 20) / distance_m


def displacement(amplitude_m: Column, rate_hz: Column, phase_rad: Column, t: Column) -> Column:
    return F.when(amplitude_m == 0, 0.0).otherwise(amplitude_m * F.sin(2 * math.pi * rate_hz * t + phase_rad))


def phase_noise_rad(snr_db: Column) -> Column:
    return 1 / F.sqrt(2 * F.pow(F.lit(10.0), snr_db / 10))


def next_pow2(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(2)))))


def fit_to_rate(f0: Column, f1: Column, rate: Column) -> tuple[Column, Column]:
    """Both ends of a sweep moved below 0.45 of a sample rate, keeping its width and direction."""
    top = F.least(F.greatest(f0, f1), 0.45 * rate)
    low = F.greatest(F.lit(1.0), top - F.abs(f1 - f0))
    return F.when(f0 <= f1, low).otherwise(top), F.when(f0 <= f1, top).otherwise(low)


def min_interval_s(max_range_m: Column, c: Column, duration_s: Column) -> Column:
    """The shortest repetition interval: the farthest echo and the pulse."""
    return 2 * max_range_m / c + duration_s


def record_length(max_range_m: Column, c: Column, fs: Column, search_s: Column, duration_s: Column) -> Column:
    """Samples that hold the search for the direct path, the farthest echo and the pulse."""
    return F.ceil(2 * max_range_m / c * fs + search_s * fs + duration_s * fs)
