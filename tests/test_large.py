"""What larger tables need: work and memory that do not grow with what is repeated, and the same results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakespark.operators import catalog as cat
from quakespark.operators import fields
from quakespark.plans import source


@pytest.mark.parametrize("breaks", [1_000_000, 0])
def test_epochs_without_all_pairs(spark, breaks):
    """the first epoch that holds the time, else the last; closed ends, open ends, null times and channels without epochs."""
    rng = np.random.default_rng(2)
    ep = [(int(i % 3), i, float(s), None if i % 11 == 0 else float(s + rng.integers(0, 4))) for i, s in enumerate(rng.integers(0, 60, 60) + 20 * (np.arange(60) % 3 == 0))]
    t = [(i, int(i % 5), None if i % 50 == 0 else float(rng.integers(-10, 130)) / 2) for i in range(600)]
    rows, epochs = spark.createDataFrame(t, "id long, ch long, t double"), spark.createDataFrame(ep, "ch long, ordinal long, start double, end double")
    got = cat.epoch_of(rows, epochs, on="ch", time="t", key="id", breaks=breaks)
    want = {}
    for i, ch, x in t:
        own = [e for e in ep if e[0] == ch]
        held = [e[1] for e in own if x is not None and e[2] <= x and (e[3] is None or x <= e[3])]
        want[i] = min(held) if held else max((e[1] for e in own), default=None)
    assert {r["id"]: r["ordinal"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "(ch#" not in " ".join(x for x in plan.splitlines() if "Join" in x) or not breaks  # rows do not meet all epochs of their channel


def test_search_many_events_in_a_call(spark):
    """events are searched together, with the result of each on its own; events of many sizes, missing travel times, few rows at once."""
    rng = np.random.default_rng(4)
    nodes = pd.DataFrame({"node": [3, 1, 2, 0, 4], "x": [3.0, 1.0, 2.0, 0.0, 1.0]})
    rows = [(e, float(rng.normal(0, 3)), float(rng.uniform(0.5, 2)), float(rng.normal())) for e in range(200) for _ in range(1 + e % 7)]
    calls = spark.sparkContext.accumulator(0)

    def times(g, part):
        calls.add(1)
        t = np.abs(g["s"].to_numpy()[:, None] - part["x"].to_numpy())
        return np.where((g["s"].to_numpy() > 1.5)[:, None] & (part["node"].to_numpy() == 2), np.nan, t)

    d = spark.createDataFrame(rows, "event long, time_s double, weight double, s double")
    for at_once in (4_000_000, 12):
        calls.value = 0
        got = {r["event"]: (r["node"], r["misfit"]) for r in fields.search(d, nodes, times, at_once=at_once).collect()}
        if at_once > 100:
            assert calls.value < 20
        for e, g in pd.DataFrame(rows, columns=["event", "time_s", "weight", "s"]).groupby("event"):
            w, best = g["weight"].to_numpy(), []
            for n in nodes.itertuples():
                r = g["time_s"].to_numpy() - np.where((g["s"].to_numpy() > 1.5) & (n.node == 2), np.nan, np.abs(g["s"].to_numpy() - n.x))
                ok = ~np.isnan(r)
                o = np.argsort(r[ok], kind="stable")
                c = np.cumsum(w[ok][o])
                m = r[ok][o][np.flatnonzero(c >= c[-1] / 2)[0]] if ok.any() else 0.0
                best.append((round(float((np.where(ok, np.abs(r - m), 10.0) * w).sum()), 6), n.node))
            assert got[e][0] == min(best)[1] and abs(got[e][1] - min(best)[0]) < 1e-5


def test_stress_of_receivers_at_one_place_once(spark, monkeypatch):
    """receivers at one place share their stress; the values are those of each receiver alone."""
    p = source.tapered_source(42.8, 13.2, 8.0, 160.0, 50.0, -90.0, 6.0, 12.0, 8.0, 2, 2)
    met, whole = spark.sparkContext.accumulator(0), source.stress_change

    def counted(patches, lat, lon, depth, **k):
        met.add(len(lat))
        return whole(patches, lat, lon, depth, **k)

    monkeypatch.setattr(source, "stress_change", counted)
    r = spark.range(400).select("id", (F.lit(42.6) + (F.col("id") % 5) * 0.1).alias("lat"), F.lit(13.0).alias("lon"), F.lit(5.0).alias("depth_km"), (F.col("id") % 360).cast("double").alias("strike"), F.lit(50.0).alias("dip"), F.lit(-90.0).alias("rake"))
    got = source.coulomb(r, p, order=2).toPandas().set_index("id")
    assert len(got) == 400 and met.value == 5
    for i in (0, 7, 399):
        one = source.coulomb(r.where(F.col("id") == i), p, order=2).toPandas().set_index("id")
        assert np.allclose(one.loc[i], got.loc[i], rtol=1e-12)


def test_bootstrap_of_equal_mechanisms(spark, monkeypatch):
    """equal mechanisms are drawn and inverted together, with all of their weight."""
    rng = np.random.default_rng(7)
    m = pd.DataFrame({"strike": rng.uniform(0, 360, 30), "dip": rng.uniform(20, 80, 30), "rake": rng.uniform(-180, 180, 30), "weight": 1.0})
    many = pd.concat([m] * 40, ignore_index=True)
    a, b = source.invert_stress(many, friction=0.6, turns=1), source.invert_stress(m.assign(weight=40.0), friction=0.6, turns=1)
    assert set(a) == set(b) and len(b["planes"]) == 30
    sizes, totals, whole = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0.0), source.invert_stress

    def counted(x, **k):
        sizes.add(int(len(x) > 30))
        totals.add(float(x["weight"].sum()))
        return whole(x, **k)

    monkeypatch.setattr(source, "invert_stress", counted)
    assert source.stress_bootstrap(spark.createDataFrame(many), realizations=6, friction=0.6).count() == 6
    assert sizes.value == 0 and totals.value == 6 * 1200


def plain_inversion(m, friction):
    """The stress inversion start by start, as it was written first."""
    n1, u1 = source.vectors(m["strike"], m["dip"], m["rake"])
    planes, slips, w = np.stack([n1, u1]), np.stack([u1, n1]), m["weight"].to_numpy(float)
    every, rng = np.arange(len(m)), np.random.default_rng(11)
    starts = [source.fit_stress(np.concatenate([n1, u1]), np.concatenate([u1, n1]), np.concatenate([w, w]))]
    for _ in range(6):
        c = rng.integers(0, 2, len(m))
        starts.append(source.fit_stress(planes[c, every], slips[c, every], w))
    tries = []
    for stress in starts:
        pick, seen = np.full(len(m), -1), set()
        for _ in range(20):
            _, axes, r = source.principal(stress)
            new = np.stack([source.instability(p, axes, r, friction) for p in planes]).argmax(0)
            stress = source.fit_stress(planes[new, every], slips[new, every], w)
            done = (new == pick).all() or new.tobytes() in seen
            seen.add(new.tobytes())
            pick = new
            if done:
                break
        n, u = planes[pick, every], slips[pick, every]
        t = n @ stress
        shear = -(t - (t * n).sum(-1, keepdims=True) * n)
        angle = np.degrees(np.arccos(np.clip((shear * u).sum(-1) / np.maximum(1e-12, np.linalg.norm(shear, axis=-1)), -1, 1)))
        tries.append((float(np.average(angle, weights=w)), len(tries), source.principal(stress)[2], pick))
    return min(tries, key=lambda x: x[:2])


def test_all_starts_at_once(spark):
    """starts and frictions together give what each gives on its own."""
    rng = np.random.default_rng(8)
    m = pd.DataFrame({"strike": rng.normal(150, 20, 200) % 360, "dip": rng.normal(50, 10, 200), "rake": rng.normal(-90, 20, 200), "weight": rng.uniform(0.5, 2, 200)})
    for mu in (0.3, 0.6, 0.9):
        misfit, _, ratio, pick = plain_inversion(m, mu)
        got = source.invert_stress(m, friction=mu)
        assert abs(got["misfit_deg"] - misfit) < 1e-6 and abs(got["ratio"] - ratio) < 1e-8 and (got["planes"] == pick).all()


@pytest.mark.parametrize("how", [dict(layered=True, station_terms=True), dict(adaptive=True, cell_hits=40.0), dict(adaptive=True, cell_hits=40.0, ratio=True, station_terms=True), dict(joint_hypocentres=False)])
def test_events_stay_distributed(spark, monkeypatch, how):
    """no table of events reaches the driver in an inversion with straight rays; model, hypocentres and residuals are those of all rows."""
    from quakespark.functions.grid import Grid
    from quakespark.plans import synthetic, tomography

    grid = Grid(8.0, 8.5, 46.0, 46.4, -2.0, 22.0, 8, 7, 9)
    d, _, start = synthetic.dataset(spark, grid, stations=8, events=14, percent=0.0, noise=(0.02, 0.04), location_error_km=0.5, straight=True, seed=4)
    gone = d.where("event % 5 = 0").withColumn("time_s", F.when(F.col("station") % 3 == 0, F.col("time_s") + 4).when(F.col("station") % 3 == 1, F.lit(None)).otherwise(F.col("time_s")))
    d = d.where("event % 5 <> 0").unionByName(gone).persist()
    fast = {p: v * 1.04 for p, v in start.items()}
    s = tomography.Settings(iterations=2, straight=True, damping=3.0, smoothing=3.0, solver_turns=3000, **how)
    with monkeypatch.context() as m:
        for name in ("toPandas", "collect"):
            m.setattr(type(d), name, lambda x, old=getattr(type(d), name): old(x) if "event" not in x.columns else pytest.fail("events on the driver"))
        a = tomography.invert(spark, d, grid, fast, s)
    monkeypatch.setattr(tomography, "_by_event", lambda *_: None)
    b = tomography.invert(spark, d, grid, fast, s)
    assert [h["used"] for h in a.history] == [h["used"] for h in b.history] and [h["halvings"] for h in a.history] == [h["halvings"] for h in b.history]
    assert np.allclose([h["rms_s"] for h in a.history], [h["rms_s"] for h in b.history], rtol=2e-3)
    for p in "PS":
        assert np.allclose(a.velocity[p], b.velocity[p], rtol=2e-3) and np.allclose(a.start[p], b.start[p])
        assert s.layered or np.allclose(a.hits[p], b.hits[p], atol=2) and np.allclose(a.dws[p], b.dws[p], rtol=0.02, atol=0.5)
    assert (a.events["event"] == b.events["event"]).all() and list(a.events) == list(b.events)
    assert np.allclose(a.events.drop(columns="event"), b.events.drop(columns="event"), atol=2e-2)
    keys = ["event", "station", "phase"]
    x, y = (r.residuals.toPandas().sort_values(keys, ignore_index=True) for r in (a, b))
    assert x[[*keys, "rejected"]].equals(y[[*keys, "rejected"]]) and x["rejected"].any() and not x["rejected"].all()
    assert np.allclose(x["initial_residual_s"], y["initial_residual_s"], equal_nan=True, atol=1e-9) and np.allclose(x["residual"], y["residual"], equal_nan=True, atol=1e-2)
    assert np.allclose(a.stations["term"], b.stations["term"], atol=5e-3)
    d.unpersist()


def test_equations_stay_in_tasks(spark, monkeypatch):
    """the driver gets vectors of the model's length, and not its normal equations; they give the step of all events' rows together."""
    from quakespark.functions.grid import Grid
    from quakespark.plans import joint, synthetic, tomography

    grid = Grid(8.0, 8.5, 46.0, 46.4, -2.0, 22.0, 8, 7, 9)
    d, _, start = synthetic.dataset(spark, grid, stations=8, events=12, percent=0.0, noise=(0.02, 0.04), location_error_km=0.5, straight=True, seed=4)
    s = tomography.Settings(straight=True)
    p = joint.Pass(grid, {q: v.ravel() * 1.04 for q, v in start.items()}, pd.DataFrame(), s, grid.nodes, None)
    e = joint.gather(d).persist()
    big, right = 25.0 * np.eye(p.width), np.zeros(p.width)
    for _, x in p.parts(e.toArrow().to_batches()):
        row, col, val, h, y = p.equations(x, np.ones(len(x["of"]), bool))
        a = np.bincount(row * p.width + col, val, len(y) * p.width).reshape(len(y), p.width)
        for i in np.unique(x["of"]):
            k = x["of"] == i
            own = a[k] - h[k] @ np.linalg.solve(h[k].T @ h[k] + np.eye(4), h[k].T @ a[k])
            big, right = big + a[k].T @ own, right + own.T @ y[k]
    got = []
    old = type(e).toArrow
    monkeypatch.setattr(type(e), "toArrow", lambda x: got.append(old(x)) or got[-1])
    x, formal = joint.solved(e, p, 1e9, [([i], [5.0], 0.0) for i in range(p.width)], lambda a, b: (np.diag(a).copy(), np.diag(b).copy()))
    assert got and sum(t.nbytes for t in got) < 100 * p.width
    assert p.width > joint.NARROW and np.abs(x).max() > 1e-3 and np.allclose(x, np.linalg.solve(big, right), atol=1e-9)
    assert np.allclose(formal[0], np.diag(big)) and np.allclose(formal[1], np.diag(big) - 25.0)
    e.unpersist()


def test_stations_in_passes_and_at_one_place(spark, monkeypatch):
    """what each station's events reach isn't gathered on the driver; stations at one place share a table; results are those of one pass."""
    from quakespark.functions.grid import Grid
    from quakespark.plans import locate, synthetic

    grid = Grid(8.0, 8.5, 46.0, 46.4, -2.0, 22.0, 8, 7, 9)
    d, truth, _ = synthetic.dataset(spark, grid, stations=10, events=12, percent=0.0, noise=(0.01, 0.02), straight=True, seed=4)
    d = spark.createDataFrame(d.where("event <> 3 or station < 2").toPandas()).persist()
    t = locate.travel_time_tables(d.select("station", "st_lon", "st_lat", "elevation_m").distinct(), grid, {p: 1 / v for p, v in truth.items()}).persist()
    sort = lambda x: x.toPandas().sort_values("event", ignore_index=True)
    want = sort(locate.locate(spark, d, t, grid))
    with monkeypatch.context() as m:
        old = type(d).collect
        m.setattr(type(d), "collect", lambda x: old(x) if "first_station" not in x.columns else pytest.fail("stations' neighbours on the driver"))
        for tables in (6, 20):
            assert sort(locate.locate(spark, d, t, grid, table_bytes=tables * 4 * grid.nodes)).equals(want)
    assert len(want) == 12
    twice = d.unionByName(d.withColumn("station", F.col("station") + 1000)).withColumn("place", locate.place())
    places = d.select(locate.place().alias("station"), "st_lon", "st_lat", "elevation_m").distinct()
    by_place = locate.travel_time_tables(places, grid, {p: 1 / v for p, v in truth.items()}).persist()
    by_station = t.unionByName(t.withColumn("station", F.col("station") + 1000))
    one = sort(locate.locate(spark, twice, by_place, grid))
    assert by_place.count() == t.count() and one.equals(sort(locate.locate(spark, twice.drop("place"), by_station, grid))) and (one["phases"] + one["rejected"]).max() == 40
    assert sort(locate.locate(spark, twice, by_place, grid, table_bytes=6 * 4 * grid.nodes)).equals(one)
    d.unpersist()


def test_events_are_located_together(spark, monkeypatch):
    """F1, n22_locations: many events a call, at a fraction of the time of one a call and to the same bits, however rows come in."""
    import time

    from quakespark.functions.grid import Grid
    from quakespark.plans import forward, locate

    grid = Grid(8.0, 8.5, 46.0, 46.4, -2.0, 22.0, 11, 9, 9)
    rng = np.random.default_rng(7)
    x, y, z = grid.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    nodes, st = forward.cartesian(xx, yy, zz).reshape(-1, 3), forward.cartesian(rng.uniform(8, 8.5, 30), rng.uniform(46, 46.4, 30), np.zeros(30))
    tab = np.concatenate([np.sqrt(((st[:, None] - nodes) ** 2).sum(-1)) / v for v in (6.0, 3.46)]).astype(np.float32)
    events, most = 1500, 12
    lon, lat, depth = rng.uniform(8.1, 8.4, events), rng.uniform(46.1, 46.3, events), rng.uniform(3, 15, events)
    n = rng.integers(4, most + 1, events)
    table = np.stack([rng.permutation(60)[:most] for _ in range(events)], 1)
    km = np.sqrt(((st[table % 30] - forward.cartesian(lon, lat, depth)) ** 2).sum(-1))
    times = km / np.where(table < 30, 6.0, 3.46) + rng.normal(0, 0.02, km.shape) + np.where(rng.random(km.shape) < 0.03, 8.0, 0.0) + rng.uniform(0, 60, events)
    sigma = rng.choice([0.02, 0.05, 0.11], km.shape)
    table[np.arange(most)[:, None] >= n] = -1

    for at in (np.arange(grid.nodes), rng.integers(0, grid.nodes, (events, 125))):  # the node of the least misfit, by trying all
        w = np.where(table >= 0, 1 / sigma, 0.0)
        got = locate._least_misfit(np.where(table >= 0, times, times[:1]), w, np.maximum(table, 0), tab, float(tab.max()), at)
        for e in range(0, events, 25):
            nd, k = at if at.ndim == 1 else at[e], slice(n[e])
            r = times[k, e, None] - tab[table[k, e]][:, nd]
            all_ = np.min([(w[k, e, None] * np.abs(r - r[i])).sum(0) for i in range(n[e])], 0)
            assert all_[np.flatnonzero(nd == got[e])[0]] == pytest.approx(all_.min(), rel=1e-9)

    for more in ({}, {"fixed_depth": 8.0}, {"coarse": 100}):
        began = time.process_time()
        r = locate.locate_events(times, sigma, table, tab, grid, **more)
        together, began = time.process_time() - began, time.process_time()
        for e in range(100):
            one = locate.locate_events(times[: n[e], e : e + 1], sigma[: n[e], e : e + 1], table[: n[e], e : e + 1], tab, grid, **more)
            assert all(np.array_equal(v, r[c][e : e + 1], equal_nan=True) for c, v in one.items())
        assert together / events < 0.25 * (time.process_time() - began) / 100
        assert (r["phases"] + r["rejected"] == n).all() and (r["depth_km"] == 8.0).all() == ("fixed_depth" in more)
        if not more:
            assert np.median(np.hypot((r["lon"] - lon) * 77, (r["lat"] - lat) * 111)) < 1 and (r["rejected"] > 0).any()

    of = [(int(e), int(i), "PS"[int(table[i, e] >= 30)], int(table[i, e] % 30), float(times[i, e]), float(sigma[i, e])) for e in range(200) for i in rng.permutation(n[e])]
    of += [(1000, i, "P", i, 1.0, 0.1) for i in range(3)] + [(1001, i, "P", i if i else 99, 1.0, 0.1) for i in range(4)]  # too few readings; too few tables
    a = spark.createDataFrame(of, "event long, station long, phase string, place long, time_s double, sigma_s double")
    t = spark.createDataFrame([(k % 30, "PS"[k >= 30], v.tolist()) for k, v in enumerate(tab)], "station long, phase string, t array<float>")
    want = {c: v[:200] for c, v in locate.locate_events(times[:, :200], sigma[:, :200], table[:, :200], tab, grid).items()}
    whole = locate.locate(spark, a, t, grid).toPandas().sort_values("event", ignore_index=True)
    assert whole["event"].tolist() == list(range(200)) and all(np.allclose(whole[c], v, atol=1e-5, equal_nan=True) for c, v in want.items() if c != "azimuth_deg")
    monkeypatch.setattr(locate, "ROWS_PER_CALL", 5)
    monkeypatch.setattr(locate, "EVENTS_PER_CALL", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert locate.locate(spark, a.coalesce(1).sortWithinPartitions("event"), t, grid, spread_out=False).toPandas().sort_values("event", ignore_index=True).equals(whole)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_decomposition_after_scratch_tables(spark, sf):
    """f13_decomposition: its function travels without the sessions that scratch tables of the process belong to."""
    from __spark_entry__ import queries
    from quakespark.common import Scratch

    Scratch(spark, "before").keep(spark.range(3))
    assert queries()["f13_decomposition"](spark, sf).count() == spark.read.parquet(f"{sf}/part.parquet").count()
