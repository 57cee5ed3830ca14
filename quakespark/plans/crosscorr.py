"""Differential times by cross-correlation of windows around common readings of event pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakespark.functions import signal as sg

TIMES = "event_a string, event_b string, station string, phase string, arrival_difference_s double, lag_s double, cc double"


def windows(traces: DataFrame, picks: DataFrame, *, low_hz: float = 1.5, high_hz: float = 15.0, max_lag_s: float = 0.3) -> DataFrame:
    """(event, station, phase, time, rate, components array<array<double>>): filtered samples around each pick, padded by the lag.

    P uses the vertical, S the horizontals. One group is an event's channels of one station.
    """
    out = "event string, station string, phase string, time double, rate double, components array<array<double>>"
    span = {"P": (0.2, 1.0), "S": (0.3, 1.5)}

    def cut(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in p.itertuples():
            use = x[x["channel"].str.endswith("Z")] if r.phase == "P" else x[~x["channel"].str.endswith("Z")].sort_values("channel")
            comps, rate = [], None
            for c in use.itertuples():
                rate = float(c.rate)
                y = sg.prepare(np.asarray(c.samples, float), rate, low_hz, high_hz)
                i = int(round((r.time - c.start) * rate))
                a, b = i - int((span[r.phase][0] + max_lag_s) * rate), i + int((span[r.phase][1] + max_lag_s) * rate)
                if a >= 0 and b <= len(y):
                    comps.append(y[a:b])
            if comps:
                start = use.iloc[0]["start"]
                aligned = start + round((r.time - start) * rate) / rate
                rows.append((str(r.event), str(r.station), r.phase, aligned, rate, comps))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return traces.groupBy("event", "station").cogroup(picks.select("event", "station", "phase", "time").groupBy("event", "station")).applyInPandas(cut, out)


def measure(cut: DataFrame, pairs: DataFrame, *, max_lag_s: float = 0.3, min_coefficient: float = 0.7) -> DataFrame:
    """Differential times of event pairs (a, b) from windows. Windows meet by joins on event, station and phase; each pair is measured in an
    Arrow batch. `arrival_difference_s` is that of the refined times of a and b."""
    a = cut.select(F.col("event").alias("a"), "station", "phase", F.col("time").alias("ta"), "rate", F.col("components").alias("ca"))
    b = cut.select(F.col("event").alias("b"), "station", "phase", F.col("time").alias("tb"), F.col("rate").alias("rate_b"), F.col("components").alias("cb"))
    j = pairs.select("a", "b").join(a, "a").join(b, ["b", "station", "phase"]).where("rate = rate_b")

    def run(batches):
        for g in batches:
            rows = []
            for r in g.itertuples():
                m = int(max_lag_s * r.rate)
                n = min(len(r.ca), len(r.cb))
                x = [np.asarray(v, float)[m:-m] for v in r.ca[:n]]
                y = [np.asarray(v, float) for v in r.cb[:n]]
                if any(len(p) + 2 * m != len(q) for p, q in zip(x, y)):
                    continue
                lag, cc = sg.cross_correlation(x, y, m)
                if cc >= min_coefficient:
                    rows.append((r.a, r.b, r.station, r.phase, r.ta - r.tb - lag / r.rate, lag / r.rate, cc))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TIMES.split(", ")])

    return j.select("a", "b", "station", "phase", "ta", "tb", "rate", "ca", "cb").mapInPandas(run, TIMES)
