"""Readings of sources that are stuck for a large part of their reports."""

import numpy as np
import pandas as pd
import pytest

from quakespark.operators.anomalies import implausible_readings
from tests.test_quality import frame, reports


@pytest.mark.parametrize("run", [8, 3000])
def test_stuck_sources_are_flagged(spark, run):
    rng = np.random.default_rng(5)
    sources, stuck = [], set()
    for s, share in enumerate([0.3, 0.6, 0.8, 0.9, 1.0]):
        p = reports([{"max_abs": float(10 * np.exp(rng.normal(0, 0.1))), "spikes": int(rng.poisson(3))} for _ in range(400)])
        p["nslc"], p["report_id"] = f"S{s}", p["report_id"] + 1000 * s
        n = int(400 * share)
        p.loc[: n - 1, "max_abs"] = 9.0 + np.arange(n) // run * 0.01
        stuck |= set(p["report_id"][:n])
        sources.append(p)
    got = implausible_readings(frame(spark, pd.concat(sources))).toPandas()
    assert set(got[got["stuck_run"]]["report_id"]) == stuck
    assert stuck <= set(got[got["flagged"]]["report_id"])
    normal = set(range(400)) - stuck
    assert not normal & set(got[got["flagged"]]["report_id"])
