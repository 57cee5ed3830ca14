"""Attenuation: t* from spectra, and Q on a grid from t*."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark.common import Scratch
from quakespark.operators import regular, stats
from quakespark.plans.forward import kernel_rows
from quakespark.plans.linalg import solve_rows


def corner_grid(low: float = 0.3, high: float = 40.0, n: int = 61) -> list[float]:
    return [low * (high / low) ** (k / (n - 1)) for k in range(n)]


def fit_tstar(samples: DataFrame, corners: list[float], *, min_samples: int = 3) -> DataFrame:
    """(event, fit, corner_hz, tstar, log_omega0, rss, n) of spectra (event, fit, f, s) of usable samples.

    For each corner of the grid, ln s + ln(1 + (f/fc)^2) is a line in frequency whose slope is -pi t*; an event's spectra share the corner of
    least summed misfit (the first on ties). Regressions are sums, combined map-side; the grid is generated, not joined from data.
    """
    g = samples.where((F.col("s") > 0) & ~F.isnan("s")).select("event", "fit", "f", F.ln("s").alias("y"), F.explode(F.array(*[F.lit(float(c)) for c in corners])).alias("fc"))
    y = F.col("y") + F.ln(1 + F.pow(F.col("f") / F.col("fc"), 2))
    r = g.groupBy("event", "fit", "fc").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, "f").alias("b"), F.regr_intercept(y, "f").alias("a"), F.regr_sxx(y, "f").alias("sxx"), F.regr_syy(y, "f").alias("syy"), F.regr_sxy(y, "f").alias("sxy"))
    r = r.where((F.col("n") >= min_samples) & (F.col("sxx") > 0))
    r = r.withColumn("rss", F.col("syy") - F.pow("sxy", 2) / F.col("sxx"))
    total = r.groupBy("event", "fc").agg(F.sum("rss").alias("total"))
    best = total.groupBy("event").agg(F.min(F.struct(F.round("total", 9).alias("t"), "fc")).alias("m")).select("event", F.col("m.fc").alias("fc"))
    return r.join(best, ["event", "fc"]).select("event", "fit", F.col("fc").alias("corner_hz"), (-F.col("b") / math.pi).alias("tstar"), F.col("a").alias("log_omega0"), "rss", "n")


def window_spectra(traces: DataFrame, picks: DataFrame, *, window_s: float = 2.56, before_s: float = 0.3, min_hz: float = 1.0, max_hz: float = 30.0, min_snr: float = 3.0) -> DataFrame:
    """(event, fit, f, s) of P windows: amplitude spectra of the vertical after each P pick, noise of a window before it taken off in power, only
    frequencies above `min_snr` times the noise. `fit` is the station. One group is an event's vertical of one station."""
    from quakespark.functions import signal as sg

    out = "event string, fit string, f double, s double"

    def run(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        z = x[x["channel"].str.endswith("Z")] if len(x) else x
        if not len(z) or not len(p):
            return pd.DataFrame(columns=["event", "fit", "f", "s"])
        r, t = z.iloc[0], float(p["time"].iloc[0])
        y, rate = np.asarray(r["samples"], float), float(r["rate"])
        n = int(window_s * rate)
        i = int(round((t - before_s - r["start"]) * rate))
        if i < n or i + n > len(y):
            return pd.DataFrame(columns=["event", "fit", "f", "s"])
        f, s = sg.amplitude_spectrum(y[i : i + n], rate)
        _, noise = sg.amplitude_spectrum(y[i - n : i], rate)
        ok = (f >= min_hz) & (f <= max_hz) & (s > min_snr * noise)
        clean = np.sqrt(np.maximum(s**2 - noise**2, 0.01 * s**2))
        return pd.DataFrame({"event": str(r["event"]), "fit": str(r["station"]), "f": f[ok], "s": clean[ok]})

    first = picks.where("phase = 'P'").select("event", "station", "time")
    return traces.groupBy("event", "station").cogroup(first.groupBy("event", "station")).applyInPandas(run, out)


def resolve_corners(fits: DataFrame, by: list[str], *, top: str = "fit_max_hz", corner: str = "corner_hz", error: str = "tstar_error", spread: str = "corner_trade_off", factor: float = 3.0, exclude: bool = False) -> DataFrame:
    """Fits with `corner_resolved`, `error` and `disabled`: an event's corner is resolved if it lies `factor` times below the upper median of the highest
    fitted frequencies of the event's records (`by`: event and phase); the t* change across the corner's interval is added to the uncertainty, and
    with `exclude` records of an unresolved corner are disabled."""
    mid = stats.upper_median(fits, by, top).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("median").alias("_mid"))
    j = fits.join(mid, reduce(Column.__and__, [fits[c].eqNullSafe(mid[f"_{c}"]) for c in by]), "left")
    ok = F.coalesce(F.col(corner) <= F.col("_mid") / factor, F.lit(False)) & ~F.coalesce(F.isnan(corner), F.lit(False))
    before = F.col("disabled") if "disabled" in fits.columns else F.lit(False)
    j = j.withColumn("corner_resolved", ok).withColumn(error, F.sqrt(F.pow(error, 2) + F.pow(F.coalesce(spread, F.lit(0.0)), 2)))
    return j.withColumn("disabled", before | (~ok if exclude else F.lit(False))).drop("_mid", *[f"_{c}" for c in by])


def disable_tstar(fits: DataFrame, *, error: str = "tstar_error", max_relative_misfit: float = 3.0) -> DataFrame:
    """Fits with `disabled`: t* further below zero than twice its uncertainty, or a misfit (`rss`, `n`) far above the middle one."""
    size = F.sqrt(F.col("rss") / F.col("n"))
    mid = stats.upper_median(fits.withColumn("_m", size), [], "_m").select(F.col("median").alias("_mid"))
    j = fits.crossJoin(F.broadcast(mid))  # one row
    below = F.coalesce(F.col("tstar") < -2 * F.col(error), F.lit(False)) if error in fits.columns else F.lit(False)
    return j.withColumn("disabled", below | (size > max_relative_misfit * F.col("_mid"))).drop("_mid")


def reference_q(readings: DataFrame, *, q_min: float = 10.0, q_max: float = 5000.0) -> float:
    """Q of a uniform medium: weighted least squares of t* on travel time through the origin, else the middle of time / t*."""
    s = readings.agg(F.sum(F.col("t_calc") * F.col("tstar") / F.pow("sigma_s", 2)).alias("xy"), F.sum(F.col("t_calc") * F.col("t_calc") / F.pow("sigma_s", 2)).alias("xx")).first()
    slope = (s["xy"] or 0) / s["xx"] if s["xx"] else 0.0
    if slope <= 0:
        m = stats.median(readings.where("tstar > 0").withColumn("_q", F.col("t_calc") / F.col("tstar")), [], "_q").first()
        return float(np.clip(m["median"] if m else 300.0, q_min, q_max))
    return float(np.clip(1 / slope, q_min, q_max))


def invert_q(spark: SparkSession, readings: DataFrame, grid, slowness: np.ndarray, *, phase: str = "P", damping: float = 2.0, smoothing: float = 10.0, vertical: float = 0.1, station_terms: bool = True, damping_station: float = 3.0, turns: int = 20, q_min: float = 10.0, q_max: float = 5000.0, outlier_mads: float = 4.0, straight: bool = False) -> dict:
    """Q on nodes from t* (event, station, tstar, sigma_s and coordinates): Gauss-Newton on the logarithm of 1/Q.

    Regularisation is scaled by the data's mean sensitivity; readings far from the fitted model are left out from the second turn on.
    """
    scratch = Scratch(spark, "attenuation")
    a = readings.withColumn("arrival", F.monotonically_increasing_id()).withColumn("phase", F.lit(phase))
    a = scratch.keep(a)
    k = scratch.keep(kernel_rows(a, grid, {phase: slowness}, straight=straight).join(a.select("arrival", "tstar", F.greatest(F.lit(0.002), "sigma_s").alias("sigma_s")), "arrival"))
    q0 = reference_q(k)
    n = grid.nodes
    st = k.select("station").distinct().toPandas().sort_values("station").reset_index(drop=True)
    st["column"] = np.arange(len(st))
    m, term = np.full(n, math.log(1 / q0)), np.zeros(len(st))
    s_flat = np.asarray(slowness, float).ravel()
    stations = spark.createDataFrame(st)
    history, last = [], None
    rows = k.join(stations, "station")
    for it in range(turns):
        q, t = np.exp(m), term.copy()

        def predict(batches, q=q, t=t):
            for b in batches:
                p = [float(np.asarray(x) @ (s_flat[np.asarray(c, np.int64)] * q[np.asarray(c, np.int64)])) + t[col] for c, x, col in zip(b["nodes"], b["km"], b["column"])]
                yield b.assign(predicted=p)

        r = rows.select("nodes", "km", "column", "tstar", "sigma_s").mapInPandas(predict, "nodes array<int>, km array<double>, column long, tstar double, sigma_s double, predicted double")
        r = r.withColumn("residual", F.col("tstar") - F.col("predicted"))
        floor = 2 * rows.agg(F.avg("sigma_s")).first()[0]
        r = scratch.keep(stats.reject_outliers(r, residual="residual", floor_s=floor, mads=outlier_mads) if it else r.withColumn("rejected", F.lit(False)))
        ok = r.where(~F.col("rejected"))
        rms = ok.agg(F.sqrt(F.avg(F.pow("residual", 2)))).first()[0]
        history.append(rms)
        if last is not None and abs(last - rms) < 1e-3 * max(rms, 1e-12):
            break
        last = rms

        def equations(batches, q=q):
            for b in batches:
                cols, vals, rhs = [], [], []
                for d in b.itertuples():
                    c = np.asarray(d.nodes, np.int64)
                    x = np.asarray(d.km, float) * s_flat[c] * q[c] / d.sigma_s
                    if station_terms:
                        c, x = np.append(c, n + d.column), np.append(x, 1 / d.sigma_s)
                    cols.append(c.astype(np.int32)), vals.append(x), rhs.append(d.residual / d.sigma_s)
                yield pd.DataFrame({"columns": cols, "values": vals, "rhs": rhs})

        data = scratch.keep(ok.mapInPandas(equations, "columns array<int>, values array<double>, rhs double"))
        scale = data.agg(F.sqrt(F.avg(F.aggregate("values", F.lit(0.0), lambda u, v: u + v * v)))).first()[0]
        model = spark.createDataFrame(pd.DataFrame({"node": np.arange(n, dtype=np.int32), "x": m - math.log(1 / q0)}))
        lap = regular.laplacian_rows(spark, grid, smoothing * scale / 10, vertical).join(model, "node").groupBy("row").agg(F.collect_list("node").alias("columns"), F.collect_list("value").alias("values"), F.sum(-F.col("value") * F.col("x")).alias("rhs"))
        damp = spark.range(n).select(F.array(F.col("id").cast("int")).alias("columns"), F.array(F.lit(damping * scale / 10)).alias("values"), F.lit(0.0).alias("rhs"))
        data = data.unionByName(lap.select("columns", "values", "rhs")).unionByName(damp)
        if station_terms:
            data = data.unionByName(spark.createDataFrame([([n + i], [damping_station * scale / 10], 0.0) for i in range(len(st))] + [([n + i for i in range(len(st))], [10.0 * scale] * len(st), float(-10.0 * scale * term.sum()))], data.schema))
        x, _ = solve_rows(scratch.keep(data), n + (len(st) if station_terms else 0))
        m = np.clip(m + np.clip(x[:n], -1, 1), math.log(1 / q_max), math.log(1 / q_min))
        if station_terms:
            term = term + x[n:]
    st["term"] = term
    return {"q": np.exp(-m).reshape(grid.nz, grid.ny, grid.nx), "q0": q0, "stations": st.drop(columns="column"), "rms": history}


def events_by_magnitude(fits: DataFrame, events: DataFrame) -> DataFrame:
    """(event, magnitude, resolved): one row an event with spectra and a known magnitude."""
    w = Window.partitionBy("event").orderBy("fit")
    f = fits.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("event", "resolved")
    return f.join(events.where(F.col("magnitude").isNotNull() & ~F.isnan("magnitude")).select("event", "magnitude"), "event")


def recommend_magnitude(events: DataFrame, *, share: float = 0.5, least: int = 20) -> dict:
    """The lowest magnitude from which every window of events has most corners resolved; from Brune scaling of the resolved events where
    there are too few events for that. `events`: (event, magnitude, resolved, corner_hz, f_max). Only single rows reach the driver."""
    from quakespark.operators.source import magnitude_windows

    n = events.count()
    if n >= least:
        w = magnitude_windows(events)
        bad = w.where(F.col("fraction") < share).agg(F.max(F.struct("magnitude", "event")).alias("m")).first()["m"]
        if bad is None:
            return {"magnitude": None, "method": "per event", "events": n}
        after = w.where((F.col("magnitude") > bad["magnitude"]) | ((F.col("magnitude") == bad["magnitude"]) & (F.col("event") > bad["event"]))).agg(F.min("magnitude")).first()[0]
        if after is not None:
            return {"magnitude": math.floor(after * 10 + 1e-6) / 10, "method": "per event", "events": n}
    beta = 3500.0
    s = F.log10(7.0 / 16 * F.pow(F.lit(10.0), 1.5 * F.col("magnitude") + 9.1) * F.pow(F.col("corner_hz") / (0.37 * beta), 3))
    m = stats.upper_median(events.where("resolved").withColumn("_s", s), [], "_s").first()
    band = stats.upper_median(events, [], "f_max").first()
    if m is None or band is None:
        return {"magnitude": None, "method": "none", "events": n}
    m0 = 16 * 10 ** m["median"] / 7 * (0.37 * beta / (band["median"] / 3)) ** 3
    return {"magnitude": math.ceil((math.log10(m0) - 9.1) / 1.5 * 10 - 1e-6) / 10, "method": "Brune scaling", "events": n}
