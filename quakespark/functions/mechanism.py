"""Double couples as Column expressions. Vectors are structs (n, e, d): north, east, down. Angles are degrees."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(n: Column, e: Column, d: Column) -> Column:
    return F.struct(n.alias("n"), e.alias("e"), d.alias("d"))


def dot(a: Column, b: Column) -> Column:
    return a["n"] * b["n"] + a["e"] * b["e"] + a["d"] * b["d"]


def cross(a: Column, b: Column) -> Column:
    return vector(a["e"] * b["d"] - a["d"] * b["e"], a["d"] * b["n"] - a["n"] * b["d"], a["n"] * b["e"] - a["e"] * b["n"])


def scaled(a: Column, k: Column | float) -> Column:
    return vector(a["n"] * k, a["e"] * k, a["d"] * k)


def plus(a: Column, b: Column, sign: int = 1) -> Column:
    return vector(a["n"] + sign * b["n"], a["e"] + sign * b["e"], a["d"] + sign * b["d"])


def normal(strike: Column, dip: Column) -> Column:
    """Unit normal of a plane, pointing up into the hanging wall."""
    s, d = F.radians(strike), F.radians(dip)
    return vector(-F.sin(d) * F.sin(s), F.sin(d) * F.cos(s), -F.cos(d))


def slip(strike: Column, dip: Column, rake: Column) -> Column:
    """Unit slip of the hanging wall."""
    s, d, r = F.radians(strike), F.radians(dip), F.radians(rake)
    return vector(F.cos(r) * F.cos(s) + F.cos(d) * F.sin(r) * F.sin(s), F.cos(r) * F.sin(s) - F.cos(d) * F.sin(r) * F.cos(s), -F.sin(d) * F.sin(r))


def direction(azimuth: Column, takeoff: Column) -> Column:
    """Unit vector of a ray; takeoff from straight down."""
    a, t = F.radians(azimuth), F.radians(takeoff)
    return vector(F.sin(t) * F.cos(a), F.sin(t) * F.sin(a), F.cos(t))


def tensor(n: Column, u: Column) -> Column:
    """struct(nn, ee, dd, ne, nd, ed) of a double couple of unit moment."""
    pair = lambda i, j: n[i] * u[j] + n[j] * u[i]
    return F.struct(*[pair(i, j).alias(i + j) for i, j in ("nn", "ee", "dd", "ne", "nd", "ed")])


def p_radiation(n: Column, u: Column, ray: Column) -> Column:
    """P amplitude along a ray, between -1 and 1."""
    return 2 * dot(n, ray) * dot(u, ray)


def wrap360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def plane_of(n: Column, u: Column) -> Column:
    """struct(strike, dip, rake) of normal and slip, the normal turned upward."""
    up = F.when(n["d"] > 0, -1.0).otherwise(1.0)
    n, u = scaled(n, up), scaled(u, up)
    dip = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -n["d"]))))
    strike = wrap360(F.degrees(F.atan2(-n["n"], n["e"])))
    s = F.radians(strike)
    along = u["n"] * F.cos(s) + u["e"] * F.sin(s)
    # Up-dip direction of the plane: slip's other component.
    d = F.radians(dip)
    updip = u["n"] * F.cos(d) * F.sin(s) - u["e"] * F.cos(d) * F.cos(s) - u["d"] * F.sin(d)
    return F.struct(strike.alias("strike"), dip.alias("dip"), F.degrees(F.atan2(updip, along)).alias("rake"))


def auxiliary_plane(strike: Column, dip: Column, rake: Column) -> Column:
    """The other nodal plane: normal and slip change places."""
    return plane_of(slip(strike, dip, rake), normal(strike, dip))


def axes(n: Column, u: Column) -> tuple[Column, Column, Column]:
    """P, T and B axes as unit vectors."""
    k = 1 / math.sqrt(2)
    t, p = scaled(plus(n, u), k), scaled(plus(n, u, -1), k)
    return p, t, cross(t, p)


def axis_angles(v: Column) -> Column:
    """struct(azimuth, plunge) of an axis, turned downward."""
    down = F.when(v["d"] < 0, -1.0).otherwise(1.0)
    return F.struct(wrap360(F.degrees(F.atan2(v["e"] * down, v["n"] * down))).alias("azimuth"), F.degrees(F.asin(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v["d"] * down)))).alias("plunge"))


def kagan_angle(n1: Column, u1: Column, n2: Column, u2: Column) -> Column:
    """The smallest rotation that turns one double couple into the other, over the four symmetries of its axes."""
    (p1, t1, b1), (p2, t2, b2) = axes(n1, u1), axes(n2, u2)
    t, b, p = dot(t1, t2), dot(b1, b2), dot(p1, p2)
    turn = lambda st, sb, sp: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (st * t + sb * b + sp * p - 1) / 2))))
    return F.least(turn(1, 1, 1), turn(1, -1, -1), turn(-1, 1, -1), turn(-1, -1, 1))


def faulting_style(n: Column, u: Column) -> Column:
    """From the plunges of T, P and B (Frohlich 1992)."""
    p, t, b = axes(n, u)
    return F.when(F.pow(t["d"], 2) > 0.59, "Thrust").when(F.pow(p["d"], 2) > 0.75, "Normal").when(F.pow(b["d"], 2) > 0.75, "Strike-slip").otherwise("Oblique")


def stress_regime(p1: Column, p2: Column, p3: Column) -> Column:
    """From the plunges of the principal stresses (Zoback 1992); 'U' where none fits."""
    rules = [
        ((p1 >= 52) & (p3 <= 35), "NF"),
        ((p1 >= 40) & (p1 < 52) & (p3 <= 20), "NS"),
        (((p1 < 40) & (p3 <= 20) & (p2 >= 45)) | ((p1 <= 20) & (p3 < 40) & (p2 >= 45)), "SS"),
        ((p1 <= 20) & (p3 >= 40) & (p3 < 52), "TS"),
        ((p1 <= 35) & (p3 >= 52), "TF"),
    ]
    return reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0])).otherwise("U")


def shmax_azimuth(see: Column, snn: Column, sen: Column) -> Column:
    """Direction of the largest horizontal compression, 0 to 180 (compression positive)."""
    return F.pmod(F.degrees(F.atan2(2 * sen, snn - see)) / 2, F.lit(180.0))


def corner_range(magnitude: Column, low_hz: float = 0.3, high_hz: float = 40.0, min_mpa: float = 0.1, max_mpa: float = 100.0) -> Column:
    """struct(low, high): corner frequencies that a magnitude allows (Brune), within the settings."""
    m0 = F.pow(F.lit(10.0), 1.5 * magnitude + 9.1)
    fc = lambda mpa: 0.37 * 3500 * F.cbrt(16 * mpa * 1e6 / (7 * m0))
    a, b = F.greatest(F.lit(low_hz), fc(min_mpa)), F.least(F.lit(high_hz), fc(max_mpa))
    known = magnitude.isNotNull() & ~F.isnan(magnitude)
    narrow = known & (b > a * 1.05)
    below = known & ~narrow & (fc(max_mpa) < low_hz)
    return F.struct(F.when(narrow, a).otherwise(F.lit(low_hz)).alias("low"), F.when(narrow, b).when(below, F.lit(low_hz * 1.5)).otherwise(F.lit(high_hz)).alias("high"))


def cosine_prefilter(f: Column, f1: float, f2: float, f3: float, f4: float) -> Column:
    rise = 0.5 * (1 - F.cos(math.pi * (f - f1) / (f2 - f1)))
    fall = 0.5 * (1 + F.cos(math.pi * (f - f3) / (f4 - f3)))
    return F.when((f <= f1) | (f >= f4), 0.0).when(f < f2, rise).when(f > f3, fall).otherwise(1.0)


def tricube(x: Column, limit: Column | float) -> Column:
    """(1 - |x / limit|^3)^3 within the limit, else 0."""
    r = F.abs(x / limit)
    return F.when(r < 1, F.pow(1 - F.pow(r, 3), 3)).otherwise(0.0)


def resolve_stress(s: Column, strike: Column, dip: Column, rake: Column) -> tuple[Column, Column]:
    """(shear along the slip, unclamping) of a stress change struct(ee, nn, uu, en, eu, nu), tension positive, on a plane."""
    a, d, r = F.radians(strike), F.radians(dip), F.radians(rake)
    n = (F.cos(a) * F.sin(d), -F.sin(a) * F.sin(d), F.cos(d))
    down = (F.cos(a) * F.cos(d), -F.sin(a) * F.cos(d), -F.sin(d))
    along = (F.sin(a), F.cos(a), F.lit(0.0))
    v = [F.cos(r) * along[i] - F.sin(r) * down[i] for i in range(3)]
    t = (s["ee"] * n[0] + s["en"] * n[1] + s["eu"] * n[2], s["en"] * n[0] + s["nn"] * n[1] + s["nu"] * n[2], s["eu"] * n[0] + s["nu"] * n[1] + s["uu"] * n[2])
    d3 = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    return d3(t, v), d3(t, n)


def vectors(strike, dip, rake) -> tuple[np.ndarray, np.ndarray]:
    s, d, r = (np.radians(np.asarray(v, float)) for v in (strike, dip, rake))
    n = np.stack([-np.sin(d) * np.sin(s), np.sin(d) * np.cos(s), -np.cos(d)], -1)
    u = np.stack([np.cos(r) * np.cos(s) + np.cos(d) * np.sin(r) * np.sin(s), np.cos(r) * np.sin(s) - np.cos(d) * np.sin(r) * np.cos(s), -np.sin(d) * np.sin(r)], -1)
    return n, u
