"""Numeric kernels and engines against closed forms, brute force and known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakespark.functions import signal as sg
from quakespark.functions.grid import Grid
from quakespark.functions.model1d import LIBRARY, Model1D, choose
from quakespark.operators import regular
from quakespark.plans import attenuation, crosscorr, forward, linalg, locate, mesh, source, synthetic, tomography

GRID = Grid(13.0, 13.6, 42.6, 43.1, -2.0, 24.0, 13, 12, 9)


def nodes():
    x, y, z = GRID.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    return xx, yy, zz


def test_eikonal_uniform_is_exact():
    src = (13.11, 42.71, -0.7)
    t = forward.eikonal(GRID, np.full(GRID.nodes, 1 / 6.0), src)
    d = np.sqrt(((forward.cartesian(*nodes()) - forward.cartesian(*src)) ** 2).sum(-1))
    assert np.max(np.abs(t - d / 6)[d > 1] / (d / 6)[d > 1]) < 1e-4


def test_eikonal_gradient_and_rays():
    g = Grid(13.0, 13.6, 42.6, 43.1, -2.0, 24.0, 25, 25, 14)
    x, y, z = g.axes()
    v = np.repeat(5 + 0.05 * (z + 2), g.nx * g.ny)
    t = forward.eikonal(g, 1 / v, (13.1, 42.7, 0.0))
    p = forward.trace_rays(g, t, (13.1, 42.7, 0.0), np.array([13.5]), np.array([43.0]), np.array([12.0]))[0]
    n, km = forward.kernel(g, p)
    assert abs(float(km @ (1 / v)[n]) / float(g.interpolate(t, [13.5], [43.0], [12.0])[0]) - 1) < 0.01


def test_trilinear_is_exact_on_linear_fields():
    xx, yy, zz = nodes()
    lon, lat, dep = np.array([13.07, 13.41]), np.array([42.77, 42.99]), np.array([3.3, 17.2])
    assert np.allclose(GRID.interpolate(2 * xx - yy + 0.5 * zz, lon, lat, dep), 2 * lon - lat + 0.5 * dep)


def test_no_data_needs_half_the_weight():
    v = np.ones(GRID.nodes)
    v[0] = np.nan
    assert np.isnan(GRID.interpolate(v, [13.0], [42.6], [-2.0])[0]) and GRID.interpolate(v, [13.04], [42.6], [-2.0])[0] == pytest.approx(1.0)


def test_grid_rules():
    with pytest.raises(ValueError):
        Grid(1, 0, 0, 1, 0, 1, 3, 3, 3)
    assert Grid.from_json(GRID.to_json()) == GRID and GRID.refined(2).nx == 25


def random_system(m=60, n=20, seed=0):
    rng = np.random.default_rng(seed)
    r, c = np.repeat(np.arange(m), 5), rng.integers(0, n, 5 * m)
    a = linalg.Csr.build(r, c, rng.normal(size=5 * m), m, n)
    return a, rng.normal(size=m)


@pytest.mark.parametrize("damp", [0.0, 1.0, 10.0])
def test_lsqr_solves(damp):
    a, b = random_system()
    x, report = linalg.lsqr(a, b, damp, atol=1e-12, btol=1e-12)
    d = a.dense()
    want = np.linalg.solve(d.T @ d + damp**2 * np.eye(a.n), d.T @ b)
    assert np.allclose(x, want, atol=1e-6) and report["turns"] <= 400
    assert np.allclose(a.transposed().dense(), d.T)


def test_solvers_agree(spark):
    a, b = random_system(seed=2)
    rows = [([int(c) for c in a.column[s:e]], [float(v) for v in a.value[s:e]], float(y)) for s, e, y in zip(a.start, a.start[1:], b)]
    d = spark.createDataFrame(rows, "columns array<int>, values array<double>, rhs double")
    x, _ = linalg.solve_rows(d, a.n, 1.0, tolerance=1e-12)
    y, how = linalg.solve_rows(d, a.n, 1.0, tolerance=1e-12, driver_entries=0)
    assert how["reason"] == "normal equations" and np.allclose(x, y, atol=1e-6)


def test_resolution():
    a, _ = random_system(seed=3)
    l = linalg.Csr.build(np.arange(a.n), np.arange(a.n), np.full(a.n, 2.0), a.n, a.n)  # noqa: E741
    d = a.dense()
    r = np.linalg.inv(d.T @ d + 4 * np.eye(a.n)) @ d.T @ d
    assert np.allclose(linalg.formal_resolution(a, l)["resolution"], np.diag(r), atol=1e-9)
    est = linalg.resolution_diagonal(lambda y: np.linalg.solve(d.T @ d + 4 * np.eye(a.n), d.T @ y), a.dot, a.n, probes=400)
    assert np.abs(est - np.diag(r)).mean() < 0.05
    with pytest.raises(ValueError):
        linalg.formal_resolution(a, l, max_unknowns=5)


def test_laplacian_of_a_constant_is_zero(spark):
    m = spark.createDataFrame(pd.DataFrame({"node": np.arange(GRID.nodes, dtype=np.int32), "x": 3.0}))
    assert regular.row_norms(regular.laplacian_rows(spark, GRID, 5.0), m).first()["norm"] == pytest.approx(0, abs=1e-9)
    assert (regular.reweight(np.ones(3)) == 1).all() and regular.reweight(np.arange(20.0))[-1] < 1


def test_filters():
    t = np.arange(2000) / 100
    low, high = np.sin(2 * np.pi * 1.0 * t), np.sin(2 * np.pi * 20.0 * t)
    y = sg.bandpass(low + high, 100, None, 5.0)
    assert np.abs(y - low)[200:-200].max() < 0.01
    assert np.abs(sg.notch(np.sin(2 * np.pi * 10 * t), 100, 10.0, 5.0))[1000:].max() < 0.02
    z = sg.resample(low, 100, 50)
    assert np.abs(z - np.sin(2 * np.pi * np.arange(len(z)) / 50))[50:-50].max() < 0.01
    assert np.allclose(sg.detrend(3 + 2 * t), 0, atol=1e-9)


def test_response_is_removed():
    rng = np.random.default_rng(0)
    t = np.arange(4096) / 100
    x = np.exp(-((t - 20) ** 2)) * np.sin(2 * np.pi * 3 * t)
    h = lambda f: sg.response(f, [-4.4 + 4.4j, -4.4 - 4.4j], [0, 0], 1000.0)
    f = np.fft.rfftfreq(8192, 0.01)
    y = np.fft.irfft(np.fft.rfft(x, 8192) * h(f), 8192)[:4096] + rng.normal(0, 1e-6, 4096)
    z = sg.remove_response(y, 100.0, h, prefilter=(0.1, 0.3, 30.0, 40.0))
    assert np.abs(z - x)[500:-500].max() < 0.02


def test_slepian_and_rotation():
    v, r = sg.slepian(256, 2.5, 4)
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-9) and (r > 0.9).all()
    n, e = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    rad, tra = sg.rotate(n, e, 30.0)
    assert np.allclose(rad**2 + tra**2, 1)
    assert np.allclose(sg.to_north_east(n, e, 0, 90), [n, e])


def test_onset_and_report():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.05, 3000)
    x[1500:] += np.sin(np.arange(1500) / 3) * np.exp(-np.arange(1500) / 300)
    got = sg.pick_phase(sg.prepare(x, 100, 2, 15, False), 100, 1480, 400)
    assert abs(got["onset_index"] - 1500) <= 6 and got["quality"] <= 2
    y = rng.normal(0, 1, 2000)
    y[700] += 500
    r = sg.quality_report([(0.0, 100.0, y), (21.0, 100.0, y[:50])])
    assert r["spikes"] == 1 and r["gap_seconds"] == pytest.approx(1.0) and not r["flat"]
    c = np.clip(y, -1, 1)
    c[100:105], c[200:204] = 1, 1
    assert sg.quality_report([(0.0, 100.0, c)])["clipped"] and sg.quality_report([(0.0, 100.0, np.ones(100))])["flat"]


def test_correlation_delay():
    t = np.arange(400) / 100
    wave = lambda s: np.exp(-(((t - 2 - s) / 0.1) ** 2)) * np.sin(2 * np.pi * 6 * (t - 2 - s))
    lag, cc = sg.cross_correlation([wave(0)[30:-30]], [wave(0.0374)], 30)
    assert abs(lag / 100 - 0.0374) < 2e-3 and cc > 0.95
    assert sg.cross_correlation([np.ones(50)], [np.arange(110.0)], 30)[1] == 0.0


def test_cross_correlation_pipeline(spark):
    rng = np.random.default_rng(5)
    t = np.arange(2000) / 100
    rows, picks = [], []
    for e, s in (("a", 0.0), ("b", 0.0374)):
        x = np.exp(-(((t - 10 - s) / 0.15) ** 2)) * np.sin(2 * np.pi * 5 * (t - 10 - s)) + rng.normal(0, 0.002, 2000)
        rows.append((e, "S1", "HHZ", 0.0, 100.0, x.tolist()))
        picks.append((e, "S1", "P", 10.0 + (0.03 if e == "a" else -0.02)))
    w = crosscorr.windows(spark.createDataFrame(rows, "event string, station string, channel string, start double, rate double, samples array<double>"), spark.createDataFrame(picks, "event string, station string, phase string, time double"))
    r = crosscorr.measure(w, spark.createDataFrame([("a", "b")], "a string, b string")).collect()
    assert len(r) == 1 and abs(r[0]["arrival_difference_s"] + 0.0374) < 0.003


def test_model1d(spark):
    from pyspark.sql import functions as F

    m = LIBRARY["ak135"]
    z = [-1.0, 0.0, 10.0, 20.0, 27.0, 35.0, 50.0, 500.0, 900.0]
    d = spark.createDataFrame([(v,) for v in z], "z double").select(m.velocity(F.col("z")).alias("v")).toPandas()["v"]
    assert np.allclose(d, m.at(z)) and m.at(20.0) == 6.5 and m.at(900.0) == 10.2
    p = Model1D.parse("# depth vp vs\n0 5 3\n10 6 3.5\n")
    assert p.at(5.0) == 5.5 and Model1D.parse(p.to_text()).nodes == p.nodes and Model1D.parse(p.to_json()).nodes == [tuple(n) for n in p.nodes]
    with pytest.raises(ValueError, match="line 2"):
        Model1D.parse("0 5 3\n1 x 3\n")
    assert p.continued(m).at(100.0) == m.at(100.0)
    near = Model1D("near", p.nodes, box=(12, 14, 42, 44), scope="local")
    assert [v.name for v in choose([m, near], 13, 13.5, 42.5, 43)] == ["near", "ak135"] and choose([m, near], 0, 1, 0, 1) == [m]


def test_mechanism_known_answer(spark):
    rng = np.random.default_rng(7)
    n, u = source.vectors(160, 80, -10)
    az, to = rng.uniform(0, 360, 120), np.degrees(np.arccos(rng.uniform(-1, 1, 120)))
    a, t = np.radians(az), np.radians(to)
    ray = np.stack([np.sin(t) * np.cos(a), np.sin(t) * np.sin(a), np.cos(t)], -1)
    pol = np.sign(2 * (ray @ n) * (ray @ u))
    pol[:6] *= -1
    d = spark.createDataFrame(pd.DataFrame({"event": 1, "azimuth": az, "takeoff": to, "polarity": pol, "weight": 1.0}))
    r = source.mechanisms(d).collect()[0]
    assert source.kagan(*source.vectors(r["strike"], r["dip"], r["rake"]), n, u) <= 15 and r["quality"] in "AB"
    assert source.kagan(*source.vectors(r["strike"], r["dip"], r["rake"]), *source.vectors(r["strike2"], r["dip2"], r["rake2"])) < 1e-3


def test_stress_known_answer(spark):
    rng = np.random.default_rng(1)
    a = np.radians([130, 40])
    s1, s3 = (np.array([np.cos(v), np.sin(v), 0]) for v in a)
    s = np.outer(s1, s1) - np.outer(s3, s3)
    rows = []
    while len(rows) < 60:
        st, di = rng.uniform(0, 360), rng.uniform(20, 90)
        n, _ = source.vectors(st, di, 0.0)
        t = s @ n
        sh = -(t - (t @ n) * n)
        if np.linalg.norm(sh) < 0.2:
            continue
        u = sh / np.linalg.norm(sh)
        fails, other = source.instability(np.stack([n, u]), np.stack([s1, np.cross(s1, s3), s3], 1), 0.5, 0.6)
        if fails > 0.7 and fails > other:  # the plane that slips is the more unstable one
            rows.append((*source.plane(n, sh / np.linalg.norm(sh)), 1.0))
    m = pd.DataFrame(rows, columns=["strike", "dip", "rake", "weight"])
    r = source.invert_stress(m)
    angle = lambda k, v: np.degrees(np.arccos(min(1, abs(float(r["axes"][:, k] @ v)))))
    assert angle(0, s1) <= 10 and angle(2, s3) <= 10 and 0.2 < r["ratio"] < 0.8
    b = source.stress_bootstrap(spark.createDataFrame(m), realizations=8, friction=0.6).toPandas()
    assert len(b) == 8 and b["ratio"].between(0, 1).all()


def test_coulomb_lobes_and_free_surface():
    p = source.tapered_source(46.0, 8.0, 8.0, 0, 90, 0, 5.0, 2, 2, 9, 9)
    assert 30e9 * (p["length_km"] * p["width_km"] * 1e6 * p["slip_m"]).sum() == pytest.approx(10 ** (1.5 * 5 + 9.1))
    r = 6371.0
    s = source.stress_change(p, np.array([46 + np.degrees(1.6 / r), 46.0]), np.array([8.0, 8 + np.degrees(0.5 / (r * np.cos(np.radians(46))))]), np.array([8.0, 8.0]))
    shear = s[:, 1, 0]  # receivers like the source
    assert shear[0] > 0 > shear[1]
    top = source.stress_change(source.tapered_source(46.0, 8.0, 8.0, 30, 60, -70, 5.0, 2, 2, 2, 2), np.array([46.02, 46.05]), np.array([8.03, 8.0]), np.array([1e-6, 1e-6]))
    assert np.abs(top[:, 2]).max() < 1e-4 * np.abs(top[:, :2, :2]).max()
    full = source.decompose(source.tensors(*source.vectors(10, 60, 30)) * 1e15)
    assert full["dc"] == pytest.approx(1, abs=1e-6) and full["mw"] == pytest.approx((15 - 9.1) / 1.5, abs=1e-6)


def test_location(spark):
    d, truth, _ = synthetic.dataset(spark, GRID, stations=12, events=12, percent=0.0, noise=(0.01, 0.02), seed=99)
    d = d.persist()
    t = locate.travel_time_tables(d.select("station", "st_lon", "st_lat", "elevation_m").distinct(), GRID, {p: 1 / v for p, v in truth.items()})
    few = locate.locate(spark, d, t, GRID, table_bytes=8 * 4 * GRID.nodes).toPandas().sort_values("event", ignore_index=True)
    assert few.equals(locate.locate(spark, d, t, GRID).toPandas().sort_values("event", ignore_index=True))  # in passes with few tables each
    r = locate.locate(spark, d, t, GRID).toPandas().merge(d.select("event", "ev_lon", "ev_lat", "depth_km").distinct().toPandas(), on="event", suffixes=("", "_true"))
    off = np.hypot((r["lon"] - r["ev_lon"]) * 82, (r["lat"] - r["ev_lat"]) * 111)
    assert len(r) == 12 and np.median(off) < 0.8 and r["rms_s"].median() < 0.05
    d.unpersist()


def test_tomography_halves_the_residual(spark):
    d, truth, start = synthetic.dataset(spark, GRID, stations=12, events=30, cell_km=16.0, percent=5.0, noise=(0.02, 0.04), straight=True, seed=99)
    r = tomography.invert(spark, d, GRID, start, tomography.Settings(iterations=2, straight=True, damping=5.0, smoothing=5.0))
    assert r.history[-1]["rms_s"] < 0.6 * r.history[0]["rms_s"]
    assert tomography.curve_corner([1, 1.1, 1.2, 5, 9], [100, 50, 10, 9.5, 9]) == 2


def test_tstar_fit(spark):
    f = np.linspace(1, 30, 30)
    rows = [(1, s, float(v), float(np.exp(2 - np.pi * v * t) / (1 + (v / 8) ** 2))) for s, t in ((1, 0.02), (2, 0.05)) for v in f]
    r = attenuation.fit_tstar(spark.createDataFrame(rows, "event long, fit long, f double, s double"), [2.0, 4.0, 8.0, 16.0]).toPandas().set_index("fit")
    assert (r["corner_hz"] == 8).all() and abs(r.loc[1, "tstar"] - 0.02) < 1e-6 and abs(r.loc[2, "tstar"] - 0.05) < 1e-6


def test_q_of_a_uniform_medium(spark):
    d, truth, _ = synthetic.dataset(spark, GRID, stations=8, events=15, percent=0.0, straight=True, seed=5)
    p = d.where("phase = 'P'").selectExpr("event", "station", "st_lon", "st_lat", "elevation_m", "ev_lon", "ev_lat", "depth_km", "time_s / 250 as tstar", "0.002D as sigma_s")
    r = attenuation.invert_q(spark, p, GRID, 1 / truth["P"], straight=True, turns=2)
    assert abs(r["q0"] / 250 - 1) < 0.15 and abs(np.median(r["q"]) / 250 - 1) < 0.15


def test_mesh():
    hits = np.zeros(GRID.nodes)
    hits.reshape(GRID.nz, GRID.ny, GRID.nx)[:4, :6, :6] = 50
    m = mesh.octree(GRID, hits)
    assert sum(k * v for k, v in mesh.size_histogram(m).items()) == GRID.nodes and 1 in mesh.size_histogram(m)
    v = np.arange(m.n, dtype=float)
    assert np.allclose(mesh.to_cells(m, mesh.to_nodes(m, v)), v)
    e = mesh.edges(m, GRID)
    assert (e[:, 0] < e[:, 1]).all() and e[:, 3].min() > 0
    c, w, n = mesh.lattice(GRID, 5.0, 4.0, 30.0)
    assert np.allclose(w.sum(1), 1) and c.max() == n - 1


def test_double_differences_tighten_relative_places(spark):
    from quakespark.operators.nearby import pairs_within

    d, truth, _ = synthetic.dataset(spark, GRID, stations=10, events=25, percent=0.0, noise=(0.005, 0.01), location_error_km=1.0, straight=True, seed=3)
    d = d.persist()
    ev = d.select("event", "ev_lon", "ev_lat", "depth_km").distinct()
    pairs = pairs_within(ev, 20.0, id="event", lat="ev_lat", lon="ev_lon", depth_km="depth_km").selectExpr("id_a as a", "id_b as b", "distance_km as km")
    r = locate.relocate_pairs(spark, d, pairs, GRID, {p: 1 / v for p, v in truth.items()}, straight=True, max_separation_km=40.0, cutoff_s=3.0)
    true = synthetic.geometry(spark, GRID, 10, 25, seed=3)[1].toPandas()
    off = lambda x: (x.merge(true, on="event", suffixes=("", "_t")).pipe(lambda m: np.stack([(m["ev_lon"] - m["ev_lon_t"]) * 82, (m["ev_lat"] - m["ev_lat_t"]) * 111, m["depth_km"] - m["depth_km_t"]], 1)))
    spread_ = lambda x: float(np.median(np.linalg.norm(off(x) - off(x).mean(0), axis=1)))
    assert spread_(r) < 0.6 * spread_(ev.toPandas())
    d.unpersist()


def test_tables_are_kept(spark, tmp_path):
    st, _ = synthetic.geometry(spark, GRID, 3, 1)
    s = {"P": np.full(GRID.nodes, 0.2)}
    f = f"file://{tmp_path}/tables"
    assert locate.cached_tables(spark, f, st.where("station < 2"), GRID, s).count() == 2
    assert locate.cached_tables(spark, f, st, GRID, s).count() == 3
    assert locate.cached_tables(spark, f, st, GRID, {"P": np.full(GRID.nodes, 0.3)}).count() == 3
    assert len(list((tmp_path / "tables").iterdir())) == 2


def test_mesh_files(tmp_path):
    m = mesh.octree(GRID, np.zeros(GRID.nodes))
    mesh.save(m, GRID, str(tmp_path / "m.json"))
    n, g = mesh.load(str(tmp_path / "m.json"))
    assert g == GRID and (n.of_node == m.of_node).all()
    mesh.save(mesh.Mesh(m.cells[1:], m.of_node), GRID, str(tmp_path / "m.json"))
    with pytest.raises(ValueError):
        mesh.load(str(tmp_path / "m.json"))


def test_sql_functions(spark):
    from quakespark.functions.registry import register

    assert "qs_distance_km" in register(spark)
    r = spark.sql("select qs_distance_km(0, 0, 0, 1) as d, qs_azimuth(0, 0, 1, 0) as a, qs_phase('Pn') as p, qs_pick_field(33297L, 8, 4) as o, qs_usable(0, 1, 0.1D) as u").first()
    assert abs(r["d"] - 111.19) < 0.01 and abs(r["a"] - 90) < 1e-9 and r["p"] == "P" and r["o"] == 2 and r["u"]
    assert spark.sql("select * from qs_grid_nodes(0, 1, 0, 1, 0, 2, 2, 2, 3)").count() == 12
    assert abs(spark.sql("select sum(km) as s, count(*) as n from qs_ray_points(0, 0, 0, 3, 4, 0, 1)").first()["s"] - 5) < 1e-12


def test_damped_stress_map(spark):
    rng = np.random.default_rng(2)
    m = pd.DataFrame({"id": np.arange(80), "strike": 160 + rng.normal(0, 15, 80), "dip": 55 + rng.normal(0, 5, 80), "rake": -90 + rng.normal(0, 10, 80)})
    nb = pd.DataFrame({"node": np.arange(80) % 4, "id": np.arange(80), "weight": 1.0})
    r = source.damped_stress_map(spark.createDataFrame(nb), spark.createDataFrame(m), [(0, 1), (1, 2), (2, 3)], damping=10.0)
    assert len(r) == 4 and (r["plunge1"] > 60).all() and r["azimuth3"].mod(180).std() < 10  # normal faulting


def test_magnitude_advice(spark):
    e = spark.createDataFrame([(i, 1 + i / 20, i >= 25, 5.0, 30.0) for i in range(60)], "event long, magnitude double, resolved boolean, corner_hz double, f_max double")
    r = attenuation.recommend_magnitude(e)
    assert r["method"] == "per event" and 1.8 <= r["magnitude"] <= 2.3
    assert attenuation.recommend_magnitude(e.where("event > 50"))["method"] == "Brune scaling"


def test_eliminated_hypocentres_give_the_same_model(spark, monkeypatch):
    d, _, start = synthetic.dataset(spark, GRID, stations=8, events=12, percent=0.0, noise=(0.02, 0.04), location_error_km=0.5, straight=True, seed=4)
    d = d.persist()
    fast = {p: v * 1.04 for p, v in start.items()}
    s = tomography.Settings(iterations=1, layered=True, straight=True, station_terms=True, damping=3.0, smoothing=3.0, solver_turns=2000)
    a = tomography.invert(spark, d, GRID, fast, s)
    monkeypatch.setattr(tomography, "SMALL", 0)
    b = tomography.invert(spark, d, GRID, fast, s)
    for p in "PS":
        assert np.allclose(a.velocity[p], b.velocity[p], rtol=2e-3)
    r, sigma = next(x.formal for x in (a, b) if x.formal is not None)
    assert ((r > -1e-9) & (r < 1)).all() and r.max() > 0.5 and (sigma > 0).all()
    assert np.allclose(a.events["t0"], b.events["t0"], atol=5e-3) and np.allclose(a.stations["term"], b.stations["term"], atol=5e-3)
    d.unpersist()


def test_recursive_filters_block_by_block():
    rng = np.random.default_rng(2)
    for n in (1, 127, 128, 1000):
        x = rng.normal(0, 1, n)
        want = x
        sos = sg.butterworth(8, 100.0, 2.0, 15.0)
        for b0, b1, b2, a1, a2 in sos:
            out, z1, z2 = [], 0.0, 0.0
            for v in want:
                out.append(b0 * v + z1)
                z1, z2 = b1 * v - a1 * out[-1] + z2, b2 * v - a2 * out[-1]
            want = np.array(out)
        assert np.allclose(sg.sections(x, sos), want, atol=1e-12)


def test_picker_rules():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.1, 2000)
    x[1000:1300] += 3 * np.sin(np.arange(300) / 2) * np.exp(-np.arange(300) / 100)
    p = sg.pick_phase(x, 100.0, 1010, 300)
    assert abs(p["onset_index"] - 1000) <= 3 and p["snr"] == pytest.approx(np.abs(x[p["onset_index"] :][:100]).max() / np.sqrt(np.mean(x[p["onset_index"] - 200 : p["onset_index"]] ** 2)))
    assert p["quality"] == 0 and p["uncertainty"] == 0.03 and sg.pick_phase(x, 100.0, 1010, 300, phase="S")["uncertainty"] == pytest.approx(0.045)
    assert sg.pick_phase(x, 100.0, 1010, 90) is None  # a window below two seconds
    assert sg.pick_phase(x[800:], 100.0, 210, 200) is None  # within the first five seconds
    assert sg.pick_phase(x, 100.0, None, 0)["onset_index"] == p["onset_index"]
    assert sg.onset_snr(x, 4, 100.0) == 0 and sg.onset_snr(np.zeros(500), 250, 100.0) == 0
    y = rng.normal(0, 0.1, 600)
    y[300:320] -= 2 * np.sin(np.arange(20) / 20 * np.pi)
    assert sg.polarity(y, 300, 100.0)[0] == -1 and sg.polarity(y, 300, 100.0, dip=90.0)[0] == 1 and sg.polarity(y, 150, 100.0) == (0, 0.0)


def test_station_picks_with_one_horizontal_or_none(spark):
    from quakespark.operators.traces import pick_stations

    rng = np.random.default_rng(4)

    def trace(at, start):
        x = rng.normal(0, 0.02, 3000)
        for k in at:
            i = int(round((k - start) * 100))
            x[i : i + 400] += np.sin(np.arange(400) * 0.5) * np.exp(-np.arange(400) / 80)
        return x.tolist()

    rows = [("e", "N.A", "HHZ", 100.0, 0.0, trace([10.0], 0.0)), ("e", "N.A", "HHN", 100.0, 0.5, trace([15.0], 0.5)), ("e", "N.B", "HHZ", 100.0, 0.0, trace([10.0, 15.0], 0.0))]
    rows += [("e", "N.C", "HHZ", 100.0, 0.0, trace([10.0], 0.0)), ("e", "N.C", "HHE", 100.0, 0.25, trace([15.0], 0.25)), ("e", "N.C", "HHN", 100.0, 0.5, trace([15.0], 0.5))]
    d = spark.createDataFrame([(*r, 10.0, 15.0) for r in rows], "event string, station string, channel string, rate double, start double, samples array<double>, p_expected double, s_expected double")
    got = {(r["station"], r["phase"]): r["time"] for r in pick_stations(d).collect()}
    for s in ("N.A", "N.B", "N.C"):
        assert got[s, "P"] == pytest.approx(10.0, abs=0.06) and got[s, "S"] == pytest.approx(15.0, abs=0.06), s


def test_ratio_and_double_differences_in_the_inversion(spark):
    d, truth, start = synthetic.dataset(spark, GRID, stations=12, events=20, cell_km=16.0, percent=4.0, noise=(0.01, 0.02), straight=True, seed=7)
    d = d.persist()
    how = dict(iterations=2, straight=True, damping=5.0, smoothing=5.0)
    e = d.select("event", "ev_lon", "ev_lat", "depth_km").distinct()
    from quakespark.operators.nearby import pairs_within

    pairs = pairs_within(e, 30.0, id="event", lat="ev_lat", lon="ev_lon", depth_km="depth_km").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("distance_km").alias("km"))
    plain = tomography.invert(spark, d, GRID, start, tomography.Settings(**how))
    ratio = tomography.invert(spark, d, GRID, start, tomography.Settings(**how, ratio=True))
    both = tomography.invert(spark, d, GRID, start, tomography.Settings(**how, ratio=True, max_separation_km=30.0, cutoff_s=3.0), pairs=pairs)
    for r in (plain, ratio, both):
        assert r.history[-1]["rms_s"] < 0.7 * r.history[0]["rms_s"]
    for kind in ("gradient", "variation", "edges"):
        r = tomography.invert(spark, d, GRID, start, tomography.Settings(**how, regularisation=kind))
        assert r.history[-1]["rms_s"] < 0.75 * r.history[0]["rms_s"], kind
    spread = lambda r: np.std(r.velocity["P"] / r.velocity["S"])  # noqa: E731 - the true ratio is nearly even
    assert spread(ratio) < spread(plain)
    assert not np.allclose(both.velocity["P"], ratio.velocity["P"])
    d.unpersist()


@pytest.mark.parametrize("narrow", [False, True])
def test_order_statistics_of_large_groups(spark, narrow):
    from quakespark.operators import stats

    rng = np.random.default_rng(6)
    x = {"a": np.round(rng.standard_t(1, 60_000), 1), "b": rng.normal(0, 1, 50_001), "c": np.zeros(9000), "d": rng.integers(0, 3, 5000).astype(float), "e": np.array([5.0]), "f": rng.exponential(1, 40)}
    d = spark.createDataFrame(pd.DataFrame({"k": np.repeat(list(x), [len(v) for v in x.values()]), "v": np.concatenate(list(x.values()))})).repartition(8)
    for p in (0.0, 0.05, 0.5, 0.99, 1.0):
        got = stats.order_statistics(d, ["k"], "v", p, {"a": F.floor(p * (F.col("n") - 1)), "b": F.ceil(p * (F.col("n") - 1))}, narrow=narrow).collect()
        for r in got:
            s = np.sort(x[r["k"]])
            i = p * (len(s) - 1)
            assert (r["n"], r["a"], r["b"]) == (len(s), s[int(np.floor(i))], s[int(np.ceil(i))]), (r["k"], p)
        whole = np.sort(np.concatenate(list(x.values())))
        one = stats.order_statistics(d, [], "v", p, {"a": F.floor(p * (F.col("n") - 1))}, narrow=narrow).first()
        assert one["a"] == whole[int(np.floor(p * (len(whole) - 1)))]


def test_damping_rows_and_cell_mapping(spark):
    d = regular.damping_rows(spark, GRID, 2.0).collect()
    assert len(d) == GRID.nodes and all(r["row"] == r["node"] and r["value"] == 2.0 for r in d)
    m = mesh.octree(GRID, np.where(np.arange(GRID.nodes) % 3 == 0, 50.0, 0.0), threshold=10.0, covered=0.3)
    p = mesh.project(regular.damping_rows(spark, GRID, 2.0), mesh.mapping(spark, m)).groupBy("column").agg(F.sum("value").alias("v")).collect()
    assert len(p) == m.n and sum(r["v"] for r in p) == pytest.approx(2.0 * GRID.nodes)
