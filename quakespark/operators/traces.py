"""Operators on traces: rows with an array of samples. Kernels run per Arrow batch; set-based forms use windows over (trace, sample)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakespark.functions import signal as sg


def apply(traces: DataFrame, kernel: Callable[[np.ndarray, float], np.ndarray], *, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Traces with a kernel applied to the samples of each. Narrow; null samples stay null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, r in batches:
            yield pd.Series([None if v is None else kernel(np.asarray(v, float), float(f)) for v, f in zip(x, r)])

    return traces.withColumn(samples, run(F.col(samples), F.col(rate)))


def chain(traces: DataFrame, steps: list[dict], **columns: str) -> DataFrame:
    """An ordered list of processing steps in one pass. Kinds: demean, detrend, taper, filter, notch, resample, integrate, differentiate."""

    def kernel(x: np.ndarray, rate: float) -> np.ndarray:
        for s in steps:
            if s.get("enabled", True):
                x, rate = _step(x, rate, s)
        return x

    out = apply(traces, kernel, **columns)
    new = [s["rate_hz"] for s in steps if s["kind"] == "resample" and s.get("enabled", True)]
    return out.withColumn(columns.get("rate", "rate"), F.lit(float(new[-1]))) if new else out


def _step(x: np.ndarray, rate: float, s: dict) -> tuple[np.ndarray, float]:
    kind = s["kind"]
    if kind == "demean":
        return sg.demean(x), rate
    if kind == "detrend":
        return sg.detrend(x), rate
    if kind == "taper":
        return sg.taper(x, s.get("fraction", 0.05)), rate
    if kind == "filter":
        return sg.bandpass(x, rate, s.get("low_hz"), s.get("high_hz"), s.get("order", 4), s.get("zero_phase", True)), rate
    if kind == "notch":
        return sg.notch(x, rate, s.get("hz", 50.0), s.get("q", 30.0)), rate
    if kind == "resample":
        return sg.resample(x, rate, s["rate_hz"]), s["rate_hz"]
    if kind == "integrate":
        return np.cumsum((x + np.concatenate([[0.0], x[:-1]])) / 2) / rate, rate
    if kind == "differentiate":
        return np.gradient(x) * rate, rate
    raise ValueError(f"unknown step {kind}")


def samples_table(traces: DataFrame, id: str, samples: str) -> DataFrame:
    """(id, i, x): one row a sample, for set-based operators."""
    return traces.select(id, F.posexplode(samples).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def aic_onsets(rows: DataFrame, id: str) -> DataFrame:
    """(id, onset): AIC onset by running sums, in SQL; ties take the first sample."""
    w = Window.partitionBy(id)
    up = w.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("s1", F.sum("x").over(up)).withColumn("s2", F.sum(F.col("x") * F.col("x")).over(up))
    r = r.withColumn("t1", F.sum("x").over(w)).withColumn("t2", F.sum(F.col("x") * F.col("x")).over(w))
    k, m = F.col("i"), F.col("n") - F.col("i")
    v1 = F.col("s2") / k - F.pow(F.col("s1") / k, 2)
    v2 = (F.col("t2") - F.col("s2")) / m - F.pow((F.col("t1") - F.col("s1")) / m, 2)
    aic = k * F.ln(F.greatest(v1, F.lit(1e-30))) + (m - 1) * F.ln(F.greatest(v2, F.lit(1e-30)))
    return r.where((k >= 1) & (k < F.col("n") - 1)).groupBy(id).agg(F.min(F.struct(F.round(aic, 9).alias("a"), "i")).alias("b")).select(id, F.col("b.i").alias("onset"))


def moments(rows: DataFrame, id: str) -> DataFrame:
    """(id, n, mean, rms, max_abs, trend): level, spread and least-squares slope per sample of each trace."""
    return rows.groupBy(id).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("rms"), F.max(F.abs("x")).alias("max_abs"), F.regr_slope("x", F.col("i").cast("double")).alias("trend"))


def constant_runs(rows: DataFrame, id: str) -> DataFrame:
    """(id, longest, plateaus): longest run of one value, and runs of three or more samples at the largest absolute value."""
    w = Window.partitionBy(id).orderBy("i")
    r = rows.withColumn("top", F.max(F.abs("x")).over(Window.partitionBy(id)))
    r = r.withColumn("new", F.when(F.col("x") == F.lag("x").over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    g = r.groupBy(id, "run").agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x"), F.first("top").alias("top"))
    return g.groupBy(id).agg(F.max("n").alias("longest"), F.count(F.when((F.abs("x") >= F.col("top")) & (F.col("n") >= 3), 1)).alias("plateaus"))


def spike_counts(rows: DataFrame, id: str, factor: float = 25.0, near: float = 5.0) -> DataFrame:
    """(id, spikes): samples far from both neighbours, which agree; distances in upper medians of neighbouring differences."""
    from quakespark.operators.stats import upper_median

    w = Window.partitionBy(id).orderBy("i")
    r = rows.select(id, "i", "x", F.lag("x").over(w).alias("a"), F.lead("x").over(w).alias("b"))
    mad = upper_median(r.select(id, F.abs(F.col("x") - F.col("a")).alias("d")), [id], "d").select(id, F.greatest(F.lit(1e-12), "median").alias("mad"))
    u, v = F.col("x") - F.col("a"), F.col("x") - F.col("b")
    hit = (F.signum(u) == F.signum(v)) & (F.least(F.abs(u), F.abs(v)) > factor * F.col("mad")) & (F.abs(F.col("b") - F.col("a")) < near * F.col("mad"))
    return r.join(mad, id).groupBy(id).agg(F.count(F.when(hit, 1)).alias("spikes"))


def stitch(segments: DataFrame, *, by: list[str], start: str = "start", rate: str = "rate", samples: str = "samples") -> DataFrame:
    """Contiguous records of a channel joined: a gap below half a sample at one rate goes on, contained records are dropped, anything
    else begins a segment. `start` in seconds. A running maximum of ends finds contained records, so only windows are needed."""
    w = Window.partitionBy(*by).orderBy(start, F.desc("_end"))
    s = segments.withColumn("_end", F.col(start) + F.size(samples) / F.col(rate))
    before = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_end") > F.col("_before") + 1e-9))
    gap = F.col(start) - F.lag("_end").over(w)
    new = F.when((F.abs(gap) < 0.5 / F.col(rate)) & (F.lag(rate).over(w) == F.col(rate)), 0).otherwise(1)
    s = s.withColumn("_new", new).withColumn("_seg", F.sum("_new").over(w))
    parts = F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(samples).alias("x"))))
    g = s.groupBy(*by, "_seg", rate).agg(F.min(start).alias(start), parts.alias("_p"))
    return g.select(*by, start, rate, F.flatten(F.transform("_p", lambda p: p["x"])).alias(samples))


def pick_stations(records: DataFrame, **settings) -> DataFrame:
    """Automatic P and S of each (event, station) from rows (event, station, channel, rate, start, samples, p_expected, s_expected), times in seconds.

    P on the vertical (the first channel where there is none); S on the root of the summed squares of the horizontals over the time
    that they share, on the vertical where there are none. Where there is a P pick, S comes after it by 0.5 s and half of the expected S-P at
    least. Search windows widen with travel time, counted from `origin` if there is such a column, else from the trace's start; an arrival without
    an expected time is sought everywhere. One group is one station's channels of one event.
    """
    low, high, zero_phase = settings.get("low_hz", 2.0), settings.get("high_hz", 15.0), settings.get("zero_phase", False)
    window, per_second = settings.get("window_s", 3.0), settings.get("window_per_second", 0.08)
    rule = {"threshold": settings.get("trigger_on", 3.5), "min_snr": settings.get("min_snr", 3.0), "sta_s": settings.get("sta_s", 0.5), "lta_s": settings.get("lta_s", 5.0)}
    out = "event string, station string, phase string, time double, snr double, quality int, uncertainty double, channel string, trigger_index int, onset_index int"
    index = lambda t, start, rate: int(round((t - start) * rate))

    def pick(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        g = g[g["rate"] > 0].sort_values("channel")
        vertical = g["channel"].str.upper().str.endswith("Z")
        if not len(g):
            return pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])
        z = (g[vertical] if vertical.any() else g).iloc[0]
        h = g[~vertical & (np.abs(g["rate"] - z["rate"]) < 1e-6)]
        rate = float(z["rate"])
        prepared = lambda r: sg.prepare(np.asarray(r, float), rate, low, high, zero_phase)

        def seek(phase, x, start, channel, wanted, not_before=None):
            known = wanted is not None and wanted == wanted
            travel = max(0.0, wanted - (float(z["origin"]) if "origin" in g else start)) if known else 0.0
            r = sg.pick_phase(
                x, rate, index(wanted, start, rate) if known else None, int(round((window + per_second * travel) * rate)), phase=phase, not_before=None if not_before is None else index(not_before, start, rate), **rule
            )
            if r is None:
                return None
            time = start + r["onset_index"] / rate
            rows.append((str(key[0]), str(key[1]), phase, time, r["snr"], r["quality"], r["uncertainty"], channel, r["trigger_index"], r["onset_index"]))
            return time

        x, start = prepared(z["samples"]), float(z["start"])
        p = seek("P", x, start, z["channel"], z["p_expected"])
        channel = z["channel"]
        if settings.get("pick_s", True):
            if len(h):
                shared = float(h["start"].max())
                cut = [index(shared, s, rate) for s in h["start"]]
                n = min(len(v) - c for v, c in zip(h["samples"], cut))
                x = np.sqrt(sum(prepared(v)[c : c + n] ** 2 for v, c in zip(h["samples"], cut))) if n >= 10 else np.zeros(0)
                start, channel = shared, h["channel"].iloc[0]
            gap = 0.5 * (z["s_expected"] - z["p_expected"])
            if len(x):
                seek("S", x, start, channel, z["s_expected"], None if p is None else p + max(0.5, gap if gap == gap else 0.0))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return records.groupBy("event", "station").applyInPandas(pick, out)
