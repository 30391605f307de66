"""Vectors, angles and voxels as column expressions. A vector is a struct of doubles x, y, z."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GOLDEN = math.pi * (3 - math.sqrt(5))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: nested expressions would otherwise grow with each use."""
    return F.transform(F.array(value), f)[0]


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def _zip(a: Column, b: Column, f) -> Column:
    return vec(*(f(a[k], b[k]) for k in "xyz"))


def add(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def scale(a: Column, s) -> Column:
    return vec(*(a[k] * s for k in "xyz"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(*(a[p] * b[q] - a[q] * b[p] for p, q in ("yz", "zx", "xy")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    return let(F.struct(a.alias("a"), norm(a).alias("n")), lambda t: vec(*(F.when(t["n"] < 1e-12, 0.0).otherwise(t["a"][k] / t["n"]) for k in "xyz")))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def angle_between(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(normalize(a), normalize(b)))))


def azimuth(d: Column) -> Column:
    return F.atan2(d["x"], d["y"])


def elevation(d: Column) -> Column:
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d["z"])))


def from_spherical(az: Column, el: Column) -> Column:
    return vec(F.cos(el) * F.sin(az), F.cos(el) * F.cos(az), F.sin(el))


def device_to_world(v: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """A vector of the device in the world: turned about Y by gamma, then X by beta, then Z by alpha (intrinsic Z-X-Y, degrees)."""

    def turn(angle, a, b):
        """The plane (a, b) by an angle, a towards b."""
        c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
        new = lambda p: {a: c * p[a] - s * p[b], b: s * p[a] + c * p[b]}
        return lambda p: vec(*(new(p).get(k, p[k]) for k in "xyz"))

    for angle, a, b in ((gamma, "z", "x"), (beta, "y", "z"), (alpha, "x", "y")):
        v = let(v, turn(angle, a, b))
    return v


def beam_direction(alpha: Column, beta: Column, gamma: Column) -> Column:
    """Where the device's -Y axis points in the world, for an intrinsic Z-X-Y rotation in degrees."""
    a, b = F.radians(alpha), F.radians(beta)
    # -Y doesn't change under the last rotation's axis (Y), so gamma drops out
    return vec(F.sin(a) * F.cos(b), -F.cos(a) * F.cos(b), -F.sin(b))


def spherical_bin(d: Column, az_bins: int = 36, el_bins: int = 18) -> Column:
    a = F.floor((azimuth(d) + math.pi) / (2 * math.pi) * az_bins)
    e = F.floor((elevation(d) + math.pi / 2) / math.pi * el_bins)
    held = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))
    return held(e, el_bins) * az_bins + held(a, az_bins)


def cone_rays(axis: Column, half_angle: float, count: int) -> Column:
    """An array of directions, uniform in solid angle, on a golden-angle spiral around the axis."""

    def frame(z):
        other = F.when(F.abs(z["z"]) < 0.9, vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
        return let(normalize(cross(other, z)), lambda u: F.struct(z.alias("z"), u.alias("u"), cross(z, u).alias("v")))

    def rays(f):
        def ray(i):
            c = 1 - (i + 0.5) / count * (1 - math.cos(half_angle))
            s, t = F.sqrt(F.greatest(F.lit(0.0), 1 - c * c)), i * GOLDEN
            return vec(*(f["z"][k] * c + f["u"][k] * s * F.cos(t) + f["v"][k] * s * F.sin(t) for k in "xyz"))

        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), ray)

    return let(let(normalize(axis), frame), rays)


def quaternion_to(beam: Column) -> Column:
    """The least rotation that turns +Z to the beam, as an array x, y, z, w."""
    w = F.sqrt((1 + beam["z"]) / 2)
    turned = F.array(-beam["y"] / (2 * w), beam["x"] / (2 * w), F.lit(0.0), w)
    return F.when(beam["z"] <= -1 + 1e-6, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(turned)


def voxel_of(p: Column, extent: float, size: float, dim: int) -> Column:
    i, j, k = (F.floor((p[a] + extent) / size) for a in "xyz")
    inside = (i >= 0) & (j >= 0) & (k >= 0) & (i < dim) & (j < dim) & (k < dim)
    return F.when(inside, (k * dim + j) * dim + i).otherwise(F.lit(-1))


def centre_of(index: Column, extent: float, size: float, dim: int) -> Column:
    parts = index % dim, F.floor(index / dim) % dim, F.floor(index / (dim * dim))
    return vec(*((p + 0.5) * size - extent for p in parts))


def cone_reach(cos_angle: Column, half_angle: float, r_min: Column, r_max: Column) -> Column:
    """How far a truncated cone reaches along a direction at this angle to its axis."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_angle))
    best = F.cos(F.greatest(F.lit(0.0), F.acos(c) - half_angle))
    return F.when(best >= 0, r_max * best).otherwise(r_min * best)


def horizontal_sweep(i: Column, count: int, elevation_deg: float = 0.0, start_deg: float = -180.0, end_deg: float = 180.0) -> Column:
    step = (end_deg - start_deg) / max(1, count - 1)
    return from_spherical(F.radians(start_deg + i * step), F.radians(F.lit(elevation_deg)))


def slab(origin: Column, direction: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Distances at which a ray enters and leaves a box. Along an axis it doesn't move on, it is inside for ever or never."""
    near, far = [], []
    for a in "xyz":
        t1, t2 = (F.try_divide(side[a] - origin[a], F.when(F.abs(direction[a]) > 1e-12, direction[a])) for side in (low, high))
        always = F.when(origin[a].between(low[a], high[a]), float("inf")).otherwise(float("-inf"))
        near.append(F.coalesce(F.least(t1, t2), -always))
        far.append(F.coalesce(F.greatest(t1, t2), always))
    return F.greatest(*near), F.least(*far)


def inside(p: Column, low: Column, high: Column) -> Column:
    out = F.lit(True)
    for a in "xyz":
        out = out & p[a].between(low[a], high[a])
    return out
