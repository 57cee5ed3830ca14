"""Structured Streaming: windowed counts with watermarks, detection with state per channel, and matching of late records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pick_rates(picks: DataFrame, *, time: str = "time", late: str = "10 minutes", window: str = "5 minutes", step: str | None = None) -> DataFrame:
    """(start, end, station, phase, n, mean_residual) of a stream of picks; rows later than `late` are left out, as the engine does."""
    w = F.window(time, window, step) if step else F.window(time, window)
    g = picks.withWatermark(time, late).groupBy(w.alias("w"), "station", "phase").agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean_residual"))
    return g.select("w.start", "w.end", "station", "phase", "n", "mean_residual")


TRIGGERS = "nslc string, time double, ratio double"


def detect(packets: DataFrame, *, sta_s: float = 0.5, lta_s: float = 5.0, on: float = 3.5, off: float = 1.5) -> DataFrame:
    """Triggers (nslc, time, ratio) of a stream of packets (nslc, start, rate, samples) by recursive STA/LTA that goes on over packets.

    State per channel: the two averages, whether a trigger is on, and the time that has been processed; a packet wholly before that time is
    a repetition and is left out, one that overlaps it is used from there on.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, l, active, upto = state.get if state.exists else (None, None, False, -np.inf)  # noqa: E741
        out = []
        rows = pd.concat(list(batches)).sort_values("start")
        for r in rows.itertuples():
            x = np.asarray(r.samples, float) ** 2
            skip = max(0, int(round((upto - r.start) * r.rate))) if np.isfinite(upto) else 0
            x = x[skip:]
            if not len(x):
                continue
            t0 = r.start + skip / r.rate
            if s is None:
                s = l = float(x[: max(1, int(r.rate))].mean())  # noqa: E741
            a, b = 1 / (sta_s * r.rate), 1 / (lta_s * r.rate)
            for i, v in enumerate(x.tolist()):
                s += a * (v - s)
                l += b * (v - l)  # noqa: E741
                q = s / l if l > 1e-300 else 0.0
                if not active and q >= on:
                    active = True
                    out.append((key[0], t0 + i / r.rate, q))
                elif active and q <= off:
                    active = False
            upto = t0 + len(x) / r.rate
        state.update((float(s) if s is not None else 0.0, float(l) if l is not None else 0.0, bool(active), float(upto)))
        yield pd.DataFrame(out, columns=["nslc", "time", "ratio"])

    return packets.groupBy("nslc").applyInPandasWithState(run, TRIGGERS, "s double, l double, active boolean, upto double", "append", GroupStateTimeout.NoTimeout)


def arrivals_with_events(picks: DataFrame, events: DataFrame, *, within: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Stream-stream join of picks with the event they name, where the event's time lies within a span before the pick."""
    p = picks.withWatermark("time", late)
    e = events.select(F.col("rid").alias("event_rid"), "origin_time").withWatermark("origin_time", late)
    return p.join(e, (p["event_rid"] == e["event_rid"]) & (p["time"] >= e["origin_time"]) & (p["time"] <= e["origin_time"] + F.expr(f"interval {within}"))).drop(e["event_rid"])
