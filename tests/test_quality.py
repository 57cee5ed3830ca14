"""Proximity, implausible readings and orphan references against brute force, and their edge cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakespark.operators.anomalies import RANGE, fit_forest, implausible_readings, least_scores, median_of
from quakespark.operators.nearby import cells_of, common_readings, nearest_within, pairs_within
from quakespark.operators.orphans import orphan_references

T0 = dt.datetime(2024, 1, 1)


def brute(p, km):
    x = []
    for i, la, lo, de in p:
        ok = all(v is not None and np.isfinite(v) for v in (la, lo, de)) and abs(la) <= 90 and not (la == 0 and lo == 0)
        if ok:
            r = 6371 - de
            a, o = np.radians(la), np.radians(lo)
            x.append((i, r * np.cos(a) * np.cos(o), r * np.cos(a) * np.sin(o), r * np.sin(a)))
    x = sorted(set(x))
    return {(a[0], b[0]) for n, a in enumerate(x) for b in x[n + 1 :] if a[0] < b[0] and sum((u - v) ** 2 for u, v in zip(a[1:], b[1:])) <= km * km}


@pytest.mark.parametrize("target", [50_000, 40])
def test_pairs_within(spark, target):
    rng = np.random.default_rng(3)
    p = []
    for i in range(700):
        base = [(10.0, 179.99), (10.02, -179.99), (89.95, 40.0), (-89.97, -120.0), (45.0, 7.0)][i % 5]
        lon = base[1] + rng.normal(0, 0.5 if abs(base[0]) > 80 else 0.01)
        p.append((i, float(np.clip(base[0] + rng.normal(0, 0.01), -90, 90)), float(lon + 360 * rng.integers(-1, 2)), float(rng.uniform(0, 2))))
    p += [(i, 45.0, 7.0, 1.0) for i in range(1000, 1012)]  # one place
    p += [(3000 + i, float(rng.uniform(-90, 90)), float(rng.uniform(0, 360)), float(6371 - rng.uniform(0, 1))) for i in range(12)] + [(3100, 45.001, 7.0, 7000.0), (3101, -45.001, 187.0, 12742 - 7000.0)]  # at the centre
    p += [(2000, None, 7.0, 1.0), (2001, float("nan"), 7.0, 1.0), (2002, 0.0, 0.0, 1.0), (2003, 95.0, 7.0, 1.0), (2004, 45.0, 7.0, None), (5, p[5][1], p[5][2], p[5][3])]
    d = spark.createDataFrame([(*q, "x") for q in p], "rid long, lat double, lon double, dep double, distance_km string")
    got = pairs_within(d, 1.0, id="rid", lat="lat", lon="lon", depth_km="dep", target_rows=target).toPandas()
    want = brute(p, 1.0)
    assert len(want) > 500
    assert set(zip(got["id_a"], got["id_b"])) == want and len(got) == len(want)


def test_pairs_on_one_latitude(spark):
    """Strips that cannot be cut are cut into sectors, also across the meridian where longitudes begin."""
    rng = np.random.default_rng(9)
    p = [(i, 50.0 + 1e-5 * float(rng.random()), float(rng.choice([0.0, 180.0, -0.05]) + rng.normal(0, 0.05)), float(rng.uniform(0, 1))) for i in range(900)]
    d = spark.createDataFrame(p, "rid long, lat double, lon double, dep double")
    places = d.select("lat", F.pmod("lon", F.lit(360.0)).alias("lon"))
    c = cells_of(places, 50)
    assert len(c.strips) < 9 and len(c.sectors) > 15
    assert np.bincount(c.cell(c.strip(np.array([x[1] for x in p])), np.mod([x[2] for x in p], 360.0))).max() < 120
    got = pairs_within(d, 1.0, id="rid", lat="lat", lon="lon", depth_km="dep", target_rows=50).toPandas()
    want = brute(p, 1.0)
    assert len(want) > 1000 and set(zip(got["id_a"], got["id_b"])) == want and len(got) == len(want)


def test_pairs_of_nothing(spark):
    d = spark.createDataFrame([], "rid long, lat double, lon double, dep double")
    assert pairs_within(d, 1.0, id="rid", lat="lat", lon="lon", depth_km="dep").count() == 0


def scattered(spark, n=500):
    """Ids around several places, many at exactly one place, across the meridian and near a pole."""
    rng = np.random.default_rng(5)
    p = [(i, float(b[0] + rng.normal(0, 0.01)), float(b[1] + rng.normal(0, 0.5 if b[0] > 80 else 0.01)), float(rng.uniform(0, 2))) for i in range(n) for b in [[(10.0, 179.995), (89.95, 40.0), (45.0, 7.0)][i % 3]]]
    p += [(1000 + 7 * i % 60, 45.0, 7.0, 1.0) for i in range(60)]
    return p, spark.createDataFrame(p, "rid long, lat double, lon double, dep double")


KEYS = {"id": "rid", "lat": "lat", "lon": "lon", "depth_km": "dep"}


def test_pairs_are_not_shuffled(spark):
    """pairs leave their cells as they are; a shuffle of them takes more disk than the tables by any factor."""
    p, d = scattered(spark)
    got = pairs_within(d, 1.0, **KEYS)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert len(xyz := got.toPandas()) == len(set(zip(xyz["id_a"], xyz["id_b"]))) and set(zip(xyz["id_a"], xyz["id_b"])) == brute(p, 1.0)


@pytest.mark.parametrize("extra", [[], [(1003, 45.0, 7.004, 1.0), (3, 45.0, 7.0, 1.0)]])
@pytest.mark.parametrize("target", [20_000, 40])
def test_nearest_within(spark, extra, target):
    """F8: without the pairs; ids at one place and at several."""
    p, d = scattered(spark)
    d = d.union(spark.createDataFrame(extra, d.schema)) if extra else d
    pairs = pairs_within(d, 1.0, **KEYS).toPandas()
    near = {}
    for a, b, km in pairs.itertuples(index=False):
        near.setdefault(a, []).append((round(km, 9), b))
        near.setdefault(b, []).append((round(km, 9), a))
    want = {(a, b, n + 1) for a, x in near.items() for n, (_, b) in enumerate(sorted(x)[:5])}
    n = nearest_within(d, 1.0, 5, target_rows=target, **KEYS)
    got = n.toPandas()
    assert len(want) > 1000 and set(got.itertuples(index=False, name=None)) == want and len(got) == len(want)
    if not extra:
        assert "Window" not in n._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("at_once", [200_000, 30])
def test_common_readings(spark, at_once):
    """common readings without the pairs; a station with half of them, and null keys."""
    p, d = scattered(spark)
    d = d.union(spark.createDataFrame([(1003, 45.0, 7.004, 1.0)], d.schema))
    rng = np.random.default_rng(6)
    r = sorted({(int(q[0]), int(rng.choice([0, 0, 1, 2, 3])), "PS"[int(rng.integers(2))]) for q in p for _ in range(3)})
    r = [(e, None if s == 3 else s, ph, float(e + 0.5)) for e, s, ph in r]
    t = spark.createDataFrame(r, "rid long, station long, phase string, t double")
    pairs = pairs_within(d, 1.0, **KEYS).selectExpr("id_a as a", "id_b as b", "distance_km as km")
    x, y = t.withColumnsRenamed({"rid": "a", "t": "t_a"}), t.withColumnsRenamed({"rid": "b", "t": "t_b"})
    columns = ["a", "b", "station", "phase", "t_a", "t_b", F.round("km", 7).alias("km")]
    want = pairs.join(x, "a").join(y, ["b", "station", "phase"]).select(*columns).toPandas()
    c = common_readings(t, d, 1.0, ["t"], rows_at_once=at_once, **KEYS)
    got = c.select(*columns).toPandas()
    assert len(want) > 1000 and set(got.itertuples(index=False, name=None)) == set(want.itertuples(index=False, name=None)) and len(got) == len(want)


def reports(rows):
    base = dict(nslc="A", samples=6000, rms=1.0, max_abs=10.0, flat=False, clipped=False, spikes=0)
    out = []
    for i, r in enumerate(rows):
        out.append({**base, "report_id": i, "start_time": T0 + dt.timedelta(hours=i), "loaded_at": T0, **r})
    return pd.DataFrame(out)[["report_id", "nslc", "start_time", "samples", "max_abs", "rms", "flat", "clipped", "spikes", "loaded_at"]]


SCHEMA = "report_id long, nslc string, start_time timestamp, samples int, max_abs double, rms double, flat boolean, clipped boolean, spikes int, loaded_at timestamp"


def frame(spark, pdf):
    return spark.createDataFrame([tuple(None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v) and c == "spikes") else v.to_pydatetime() if isinstance(v, pd.Timestamp) else int(v) if c in ("spikes", "samples") else v for c, v in zip(pdf.columns, r)) for r in pdf.astype(object).itertuples(index=False)], SCHEMA)


def test_rules(spark):
    rng = np.random.default_rng(1)
    rows = [{"max_abs": float(10 * np.exp(rng.normal(0, 0.1)))} for _ in range(200)]
    special = {
        20: {"max_abs": -1.0}, 21: {"max_abs": float("inf")}, 22: {"max_abs": 0.5}, 23: {"spikes": -1}, 24: {"spikes": 7000}, 25: {"flat": True, "clipped": True}, 26: {"flat": True, "spikes": 2}, 30: {"max_abs": 1e6, "rms": 5.0}, 31: {"spikes": 40}, 32: {"flat": True}, 33: {"clipped": True},
        40: {"max_abs": float("nan")}, 41: {"max_abs": None}, 42: {"spikes": None, "flat": None, "clipped": None}, 43: {"rms": None},
    }
    for k, v in special.items():
        rows[k] = {**rows[k], **v}
    for k in range(100, 105):
        rows[k]["max_abs"] = 11.0
    for k in range(110, 114):
        rows[k]["max_abs"] = 12.0
    p = reports(rows)
    p = pd.concat([p, p.iloc[[30, 50]]])  # delivered again
    got = implausible_readings(frame(spark, p)).toPandas()
    assert len(got) == 200
    assert set(got[got["flagged"]]["report_id"]) == {20, 21, 22, 23, 24, 25, 26, 30, 31, 32, 33, *range(100, 105)}
    assert got["score"].between(0, 1).all()


def test_runs_cross_partitions(spark):
    p = reports([{"max_abs": 7.0} for _ in range(400)] + [{"nslc": None, "max_abs": 7.0 + i} for i in range(20)])
    got = implausible_readings(frame(spark, p)).toPandas()
    assert set(got[got["stuck_run"]]["report_id"]) == set(range(400)) and len(got) == 420


def test_empty_reports(spark):
    assert implausible_readings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_medians(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 1.0), ("b", 2.0), ("b", 9.0)], "k string, v double")
    assert dict(d.groupBy("k").agg(median_of(F.col("v")).alias("m")).collect()) == {"a": 2.5, "b": 2.0}


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.5, (300, len(RANGE))) * [1, 1, 1, 1, 0, 0, 0]
    y = x[:5].copy()
    y[0, 0], y[1, 4], y[2, 5] = 3.0, 1.5, 1.0
    f = fit_forest(x, np.random.default_rng(1), 32, 64)
    s = f.scores(np.concatenate([x, y]))
    assert (s[300:303] > np.quantile(s[:300], 0.95)).all()


def orphan_tables(spark):
    p = [("k1", T0, None), ("k2", T0 + dt.timedelta(days=5), None), ("k2", T0 + dt.timedelta(days=9), None), ("k3", T0, T0), ("k4", T0 + dt.timedelta(days=2), None), (None, T0, None)]
    r = [("r1", "k1", 1), ("r2", "k2", 1), ("r2", "k2", 20), ("r3", "k3", 1), ("r4", "zz", 1), ("r5", None, 1), (None, "k1", 1), ("r6", "k4", 2), ("r7", "k4", 1), ("r8", "", 1), ("r9", "k1\0", 1), ("r10", "k\U0001f600", 1)]
    return (
        spark.createDataFrame([(a, T0 + dt.timedelta(days=d), b, 1) for a, b, d in r], "rec string, ref string, loaded_at timestamp, state int".replace("ref string, loaded_at timestamp", "loaded_at timestamp, ref string")),
        spark.createDataFrame(p, "key string, loaded_at timestamp, deleted_at timestamp"),
    )


@pytest.mark.parametrize("target", [500_000, 2])
def test_orphans(spark, target):
    refs, parents = orphan_tables(spark)
    got = orphan_references(refs, parents, record_id="rec", key="ref", loaded_at="loaded_at", parent_key="key", parent_loaded_at="loaded_at", parent_deleted_at="deleted_at", target_rows=target)
    assert {(r["record"], r["ref_state"]) for r in got.collect()} == {("r2", "late"), ("r3", "deleted"), ("r4", "missing"), ("r7", "late"), ("r8", "missing"), ("r9", "missing"), ("r10", "missing")}
    assert {r["record"]: r["first_loaded_at"] for r in got.collect()}["r2"] == T0 + dt.timedelta(days=1)


@pytest.mark.parametrize("target", [500_000, 100])
def test_orphans_hot_key_and_empty(spark, target):
    refs = spark.range(3000).select(F.col("id").alias("rec"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).cast("long").alias("ref"), F.lit(T0).alias("loaded_at"))
    parents = spark.range(0, 3000, 2).select(F.col("id").alias("key"), F.lit(T0).alias("loaded_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    how = dict(record_id="rec", key="ref", loaded_at="loaded_at", parent_key="key", parent_loaded_at="loaded_at", parent_deleted_at="deleted_at", target_rows=target)
    got = orphan_references(refs, parents, **how)
    want = {i for i in range(3000) if i % 3 or i % 2}
    rows = got.collect()
    assert {int(r["record"]) for r in rows} == want and len(rows) == len(want)
    assert orphan_references(refs.limit(0), parents, **how).count() == 0
    assert orphan_references(refs, parents.limit(0), **how).count() == 3000


def test_threshold_is_below_every_case():
    rng = np.random.default_rng(4)
    for k in range(20):
        x = np.stack([*rng.standard_t(2, (4, 300)), np.log1p(rng.integers(0, 9, 300)), rng.choice([0.0, 0.9], 300), np.zeros(300)], 1)
        f = fit_forest(x[: rng.integers(1, 300)], rng, 8, 64)
        s, least = f.scores(x), least_scores(f, 10.0, 0.2, 5)
        case = (np.abs(x[:, 0]) > np.log(11)) | (x[:, 3] > np.log(10)) | (x[:, 4] >= np.log(5)) | (x[:, 5] > 0.8)
        assert case.any() and (s[case] >= least).all()
