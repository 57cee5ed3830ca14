"""Synthetic catalogues for tests and resolution studies: stations, events and arrivals of a perturbed model, and simple waveforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.functions.grid import Grid
from quakespark.functions.model1d import LIBRARY
from quakespark.plans.forward import kernel_rows
from quakespark.plans.tomography import checkerboard


def geometry(spark: SparkSession, grid: Grid, stations: int, events: int, *, min_depth: float = 2.0, max_depth: float = 16.0, seed: int = 12345) -> tuple[DataFrame, DataFrame]:
    """(stations, events): places by hash of their number, so they do not depend on partitions."""
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed * 31 + salt), "id"), F.lit(1_000_003)) + 0.5) / 1_000_003
    inside = lambda a, b, salt: a + (b - a) * (0.05 + 0.9 * u(salt))
    st = spark.range(stations).select(F.col("id").alias("station"), inside(grid.min_lon, grid.max_lon, 1).alias("st_lon"), inside(grid.min_lat, grid.max_lat, 2).alias("st_lat"), (u(3) * 1000).alias("elevation_m"))
    ev = spark.range(events).select(F.col("id").alias("event"), inside(grid.min_lon, grid.max_lon, 4).alias("ev_lon"), inside(grid.min_lat, grid.max_lat, 5).alias("ev_lat"), (min_depth + (max_depth - min_depth) * u(6)).alias("depth_km"), (1.5 + 2 * u(7)).alias("magnitude"))
    return st, ev


def start_model(grid: Grid, model: str = "ak135") -> dict[str, np.ndarray]:
    z = grid.axes()[2]
    return {p: np.repeat(LIBRARY[model].at(z, p), grid.nx * grid.ny) for p in ("P", "S")}


def dataset(spark: SparkSession, grid: Grid, *, stations: int = 25, events: int = 150, cell_km: float = 16.0, depth_cell_km: float = 10.0, percent: float = 5.0, noise: tuple[float, float] = (0.03, 0.06), location_error_km: float = 0.0, model: str = "ak135", straight: bool = False, seed: int = 12345) -> tuple[DataFrame, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(arrivals, true velocities, starting velocities). Every event is read at every station, P and S, with noise."""
    st, ev = geometry(spark, grid, stations, events, seed=seed)
    start = start_model(grid, model)
    pattern = checkerboard(grid, cell_km, depth_cell_km, percent).ravel()
    truth = {p: v * (1 + pattern) for p, v in start.items()}
    # Events x stations is the size of the data that is asked for.
    a = ev.crossJoin(st).crossJoin(spark.createDataFrame([("P", noise[0]), ("S", noise[1])], "phase string, sigma_s double")).withColumn("arrival", F.monotonically_increasing_id())
    k = kernel_rows(a, grid, {p: 1 / v for p, v in truth.items()}, straight=straight).select("event", "station", "phase", "t_calc")
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed * 131 + salt), "event", "station", "phase"), F.lit(1_000_003)) + 0.5) / 1_000_003
    out = a.drop("arrival").join(k, ["event", "station", "phase"]).withColumn("time_s", F.col("t_calc") + F.col("sigma_s") * F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * np.pi * u(2))).drop("t_calc")
    if location_error_km:
        w = lambda salt: (F.pmod(F.xxhash64(F.lit(seed * 17 + salt), "event"), F.lit(1_000_003)) / 1_000_003 - 0.5) * 2 * location_error_km
        out = out.withColumns({"ev_lon": F.col("ev_lon") + w(1) / 82.0, "ev_lat": F.col("ev_lat") + w(2) / 111.2, "depth_km": F.greatest(F.lit(0.0), F.col("depth_km") + w(3))})
    return out, truth, start


def waveforms(arrivals: DataFrame, *, rate: float = 100.0, before_s: float = 10.0, after_s: float = 20.0, snr: float = 50.0, seed: int = 1) -> DataFrame:
    """Three components of each (event, station) with a P and an S pulse in noise: rows for `pick_stations`."""
    w = arrivals.groupBy("event", "station").agg(F.max(F.when(F.col("phase") == "P", F.col("time_s"))).alias("p"), F.max(F.when(F.col("phase") == "S", F.col("time_s"))).alias("s")).where("p is not null and s is not null")
    out = "event string, station string, channel string, origin double, start double, rate double, samples array<double>, p_expected double, s_expected double"

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                rng = np.random.default_rng([seed, int(r.event), int(r.station)])
                n = int((before_s + r.s - r.p + after_s) * rate)
                t = np.arange(n) / rate + r.p - before_s
                for c, (ap, as_) in {"HHZ": (1.0, 0.3), "HHN": (0.3, 1.5), "HHE": (0.2, 1.3)}.items():
                    x = rng.normal(0, 1 / snr, n)
                    for at, amp, hz in ((r.p, ap, 8.0), (r.s, as_, 5.0)):
                        d = t - at
                        x += np.where(d >= 0, amp * np.sin(2 * np.pi * hz * d) * np.exp(-3 * d), 0)
                    rows.append((str(r.event), str(r.station), c, 0.0, t[0], rate, x, r.p, r.s))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return w.mapInPandas(run, out)
