"""Settings of a sounding and of the map, with their defaults."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

#: fixed values: window name -> (first sidelobe in dB, main lobe widening)
WINDOWS = {
    "rect": (-13.3, 1.0),
    "hann": (-31.5, 1.67),
    "hamming": (-42.7, 1.5),
    "blackman": (-58.1, 2.0),
    "blackman-harris": (-92.0, 2.66),
    "tukey": (-21.0, 1.35),
}
PING_RATE_HZ = 15.0


@dataclass(frozen=True)
class Sonar:
    """Waveform, detector and range settings of one sounding."""

    fs: float = 48_000.0
    f0: float = 17_500.0
    f1: float = 20_500.0
    duration_s: float = 0.005
    tx_window: str = "hann"
    tukey_alpha: float = 1.0
    amplitude: float = 0.6
    rx_taper: str = "rect"
    cfar_kind: str = "ca"
    cfar_train: int = 82
    cfar_guard: int = 41
    cfar_pfa: float = 1e-4
    cfar_os_rank: float = 0.75
    cfar_min_threshold: float = 1e-6
    cfar_merge_gap: int = 27
    cfar_min_prominence_db: float = 6.0
    temperature_c: float = 20.0
    speaker_mic_sep_m: float = 0.1
    min_range_m: float = 0.6
    max_range_m: float = 6.0
    sync_to_direct_path: bool = True
    direct_search_s: float = 0.25
    min_snr_db: float = 6.0
    blast_cancellation: bool = True
    pri_samples: int = 0

    def __post_init__(self) -> None:
        if self.tx_window not in WINDOWS:
            object.__setattr__(self, "tx_window", "hann")
        if self.rx_taper not in WINDOWS:
            object.__setattr__(self, "rx_taper", "hann")
        if self.cfar_kind not in ("ca", "os"):
            object.__setattr__(self, "cfar_kind", "ca")

    @property
    def c(self) -> float:
        """Speed of sound in air."""
        return 331.3 * math.sqrt(max(0.0, 1 + self.temperature_c / 273.15))

    @property
    def bandwidth(self) -> float:
        return abs(self.f1 - self.f0)

    @property
    def pulse_samples(self) -> int:
        return max(2, half_away(self.duration_s * self.fs))

    @property
    def widening(self) -> float:
        return max(WINDOWS[self.tx_window][1], WINDOWS[self.rx_taper][1])

    @property
    def mainlobe(self) -> float:
        """Half width of the compressed main lobe, in samples."""
        return self.fs / max(1.0, self.bandwidth) * self.widening

    @property
    def range_step(self) -> float:
        return self.c / (2 * self.fs)

    @property
    def alpha(self) -> float:
        n = max(1, 2 * self.cfar_train)
        return n * (min(0.5, max(1e-12, self.cfar_pfa)) ** (-1 / n) - 1)

    @property
    def record_len(self) -> int:
        return math.ceil(2 * self.max_range_m / self.c * self.fs + self.direct_search_s * self.fs + self.duration_s * self.fs)

    @property
    def min_pri_s(self) -> float:
        return 2 * self.max_range_m / self.c + self.duration_s

    def range_at(self, lag: float) -> float:
        return (self.c * lag / self.fs + self.speaker_mic_sep_m) / 2

    def lag_for(self, range_m: float) -> float:
        return (2 * range_m - self.speaker_mic_sep_m) * self.fs / self.c

    def sized(self) -> Sonar:
        """The same sounding with detector windows that follow from the pulse."""
        guard = max(4, math.ceil(1.5 * self.mainlobe))
        return replace(self, cfar_guard=guard, cfar_train=max(16, 2 * guard), cfar_merge_gap=max(2, math.ceil(self.mainlobe)))

    def pri_for(self, rate_hz: float) -> int:
        if not (math.isfinite(rate_hz) and rate_hz > 0 and math.isfinite(self.fs) and self.fs > 0):
            return 0
        return math.floor(self.fs / rate_hz + 0.5)

    def fit_to_rate(self, sample_rate: float) -> Sonar:
        """Move the sweep below 0.45 of another sample rate, keeping its width."""
        top = min(max(self.f0, self.f1), 0.45 * sample_rate)
        low = max(1.0, top - self.bandwidth)
        return replace(self, fs=sample_rate, f0=low if self.f0 <= self.f1 else top, f1=top if self.f0 <= self.f1 else low)

    def problem(self) -> str | None:
        """The first thing wrong with the settings, or None."""
        checks = [
            (not self.fs > 0, "sample rate must be positive"),
            (max(self.f0, self.f1) >= self.fs / 2, "sweep reaches the Nyquist frequency"),
            (not min(self.f0, self.f1) > 0, "frequencies must be positive"),
            (not self.bandwidth >= 1, "bandwidth must be at least 1 Hz"),
            (not self.duration_s > 0 or self.pulse_samples < 8, "pulse is shorter than 8 samples"),
            (not 0 < self.amplitude <= 1, "amplitude must lie in (0, 1]"),
            (not self.max_range_m > self.min_range_m, "max_range_m must exceed min_range_m"),
            (self.cfar_train < 1, "cfar_train must be at least 1"),
            (self.cfar_guard < self.mainlobe, "cfar_guard is narrower than the compressed main lobe"),
        ]
        return next((text for wrong, text in checks if wrong), None)


@dataclass(frozen=True)
class Grid:
    """A cube of voxels around the device and how evidence changes them."""

    extent_m: float = 6.0
    voxel_m: float = 0.1
    hit: float = 0.85
    miss: float = 0.4
    low: float = -4.0
    high: float = 4.0
    occupied: float = 1.4
    beam_half_angle_deg: float = 30.0
    free_margin_m: float = 0.15
    snr_reference_db: float = 20.0

    @property
    def dim(self) -> int:
        return max(1, math.ceil(2 * self.extent_m / self.voxel_m))


@dataclass(frozen=True)
class EmissionLimits:
    """What may be emitted."""

    max_amplitude: float = 0.8
    min_frequency_hz: float = 17_500.0
    max_frequency_hz: float = 23_000.0
    max_duty_cycle: float = 0.35
    max_pulse_s: float = 0.05
    max_ping_rate_hz: float = 25.0


def half_away(v: float) -> int:
    """Round to the nearest whole number, halves away from zero."""
    return int(math.copysign(math.floor(abs(v) + 0.5), v))
