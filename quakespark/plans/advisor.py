"""Advice on grids and settings from the data, and the Vp/Vs of a Wadati diagram."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakespark.functions.geo import EARTH_KM, distance_km
from quakespark.functions.grid import Grid
from quakespark.functions.model1d import Model1D
from quakespark.operators import stats


def nearest_station_km(stations: DataFrame, lon: str = "st_lon", lat: str = "st_lat", id: str = "station") -> DataFrame:
    """(station, km): distance to the nearest other station.

    Stations meet in cells of growing size: a station whose nearest partner is nearer than the cell size is settled, the rest go on with
    cells four times larger, until one cell holds all. No join of all with all; the number of turns is logarithmic.
    """
    left = stations.select(F.col(id).alias("s"), F.col(lon).alias("x"), F.col(lat).alias("y"))
    everyone, done = left, None
    n = everyone.count()
    size = 180.0 / max(1.0, math.sqrt(n)) / 8
    while True:
        whole = size >= 180
        cx, cy = (F.lit(0), F.lit(0)) if whole else (F.floor(F.col("x") / size), F.floor(F.col("y") / size))
        near = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]) if not whole else F.array(F.struct(cx.alias("cx"), cy.alias("cy")))
        a = left.withColumn("c", F.explode(near)).select("s", "x", "y", "c.cx", "c.cy")
        b = everyone.select(F.col("s").alias("s2"), F.col("x").alias("x2"), F.col("y").alias("y2"), cx.alias("cx"), cy.alias("cy"))
        j = a.join(b, ["cx", "cy"]).where("s <> s2").groupBy("s", "x", "y").agg(F.min(distance_km("x", "y", "x2", "y2")).alias("km"))
        # Within a ring of one cell every partner nearer than the cell's smaller side is seen.
        reach = math.radians(size) * EARTH_KM * F.cos(F.radians(F.least(F.abs("y") + size, F.lit(89.0))))
        ok = j if whole else j.where(F.col("km") <= reach)
        done = ok.select("s", "km") if done is None else done.unionAll(ok.select("s", "km"))
        if whole:
            break
        left = left.join(ok.select("s"), "s", "left_anti")
        if not left.limit(1).count():
            break
        size *= 4
    return done.select(F.col("s").alias(id), "km")


def nice(x: float) -> float:
    """1, 2, 2.5 or 5 times a power of ten, changing half-way between them; 1 for what is no positive number."""
    if not x > 0:
        return 1.0
    p = 10.0 ** math.floor(math.log10(x))
    return p * next(v for limit, v in ((1.5, 1.0), (2.25, 2.0), (3.75, 2.5), (7.5, 5.0), (math.inf, 10.0)) if x / p < limit)


def turning_depths(model: Model1D, distances_km, max_depth_km: float = 200.0, step_km: float = 0.1) -> np.ndarray:
    """Shallowest depth at which a P ray from the surface turns that comes up again at each distance or beyond, in steps; at most `max_depth_km`.

    The velocity is linear within a step. Rays with their lowest point at a depth have the slowness of the fastest velocity above it.
    """
    n = round(max_depth_km / step_km)
    v = model.at(np.arange(n + 1) * step_km, "P")
    top = np.maximum.accumulate(v)[1:]
    reach = np.empty(n)
    for k in range(n):
        p, a, b = 1 / top[k], v[: k + 1], np.minimum(v[1 : k + 2], top[k])
        c, d = (np.sqrt(np.maximum(0.0, 1 - (p * x) ** 2)) for x in (a, b))
        slope = (b - a) / step_km
        flat = np.abs(slope) <= 1e-9
        reach[k] = 2 * np.where(flat, np.where(c > 1e-6, step_km * p * a / np.maximum(c, 1e-12), 0.0), (c - d) / (p * np.where(flat, 1.0, slope))).sum()
    at = np.searchsorted(np.maximum.accumulate(reach), np.asarray(distances_km, float), "left")
    return np.where(np.asarray(distances_km) <= 0, 0.0, np.minimum((at + 1) * step_km, max_depth_km))


def advise_grid(events: DataFrame, stations: DataFrame, *, margin_km: float = 10.0, top_km: float = -2.0) -> tuple[Grid, dict]:
    """A grid that covers stations and events, spaced by half the stations' distance; only single rows reach the driver."""
    e = events.agg(F.min("ev_lon").alias("a"), F.max("ev_lon").alias("b"), F.min("ev_lat").alias("c"), F.max("ev_lat").alias("d")).first()
    s = stations.agg(F.min("st_lon").alias("a"), F.max("st_lon").alias("b"), F.min("st_lat").alias("c"), F.max("st_lat").alias("d")).first()
    deep = stats.truncated_percentile(events, [], "depth_km", 0.95).first()["value"]
    apart = stats.upper_median(nearest_station_km(stations), [], "km").first()["median"]
    h = max(1.0, nice(apart / 2))
    v = max(1.0, nice(h / 2))
    km = math.radians(1) * EARTH_KM
    lat = (min(e["c"], s["c"]) + max(e["d"], s["d"])) / 2
    mx, my = margin_km / (km * math.cos(math.radians(lat))), margin_km / km
    bottom = math.ceil((deep + margin_km) / v) * v
    g = Grid.from_spacing(min(e["a"], s["a"]) - mx, max(e["b"], s["b"]) + mx, min(e["c"], s["c"]) - my, max(e["d"], s["d"]) + my, top_km, bottom, h, v)
    return g, {"station_spacing_km": apart, "depth_95_km": deep, "horizontal_km": h, "vertical_km": v}


def wadati(pairs: DataFrame, *, min_stations: int = 3, passes: int = 5) -> dict:
    """Vp/Vs from (event, station, p_time, s_time): the slope of demeaned S on demeaned P times of events with enough stations,
    through the origin, with trimming."""
    w = Window.partitionBy("event")
    d = pairs.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= min_stations)
    d = d.select("event", (F.col("p_time") - F.avg("p_time").over(w)).alias("x"), (F.col("s_time") - F.avg("s_time").over(w)).alias("y"))
    slope, used, total = stats.trimmed_slope(d, "x", "y", passes=passes)
    return {"vp_vs": slope, "used": used, "readings": total}
