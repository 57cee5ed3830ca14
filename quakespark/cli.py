"""Command line: `python -m quakespark.cli COMMAND ...`. Exit codes: 0 done, 1 failed, 2 wrong use, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

import numpy as np

from quakespark import __version__, config
from quakespark.common import local_session


def _spark(a):
    return local_session(a.threads or os.cpu_count() or 4)


def _grid(a):
    from quakespark.functions.grid import Grid

    return Grid.from_json(Path(a.grid).read_text())


def _model(grid, name: str):
    from quakespark.functions.model1d import LIBRARY, Model1D

    m = LIBRARY.get(name) or Model1D.parse(Path(name).read_text(), Path(name).stem)
    z = grid.axes()[2]
    return {p: np.repeat(m.at(z, p), grid.nx * grid.ny) for p in ("P", "S")}


def _catalogue(spark, a):
    """(stations, events, picks) of a data folder or a project, single tables, QuakeML and StationXML files; of rows with one key the first wins.

    Picks of unknown stations take the network of the only station with their code; `--hypocentres` moves events.
    """
    from pyspark.sql import functions as F

    from quakespark.operators.catalog import first_wins, override_hypocentres, relabel_networks
    from quakespark.sources import project, xml
    from quakespark.sources import tables as t

    st, ev, pk = [], [], []
    d = Path(a.data) if a.data else None
    if d is not None and ((d / "project.json").exists() or d.name == "project.json"):
        p = project.read_project(spark, a.data, catalog_locations=a.catalog_locations)
        st, ev, pk = [p["stations"]], [p["events"]], [p["picks"].drop("seq")] if "picks" in p else []
        ev = [e for e in [p.get("events")] if e is not None]
    elif d is not None and not d.is_dir():
        raise ValueError(f"{d}: neither a folder nor a project")
    table = lambda given, name: given or (str(d / name) if d is not None and (d / name).exists() else None)
    if f := table(a.stations, "stations.csv"):
        st.insert(0, t.read_stations(spark, f))
    if f := table(a.events, "events.csv"):
        ev.insert(0, t.read_events(spark, f))
    for q in a.quakeml:
        e, p = xml.read_quakeml(spark, q if "*" in q or not Path(q).is_dir() else f"{q}/*ml")
        ev.append(e), pk.append(p)
    for q in a.stationxml:
        st.append(xml.station_coordinates(xml.read_stationxml(spark, q)))
    if not st:
        raise ValueError("no stations: give a folder, a project, --stations or --stationxml")
    if not ev:
        raise ValueError("no events: give a folder, a project, --events or --quakeml")
    st, ev = first_wins(st, "id", fold=True), first_wins(ev, "id")
    if a.hypocentres:
        ev = override_hypocentres(ev, t.read_events(spark, a.hypocentres), ["origin_time", "lon", "lat", "depth_km"], key="id")
    if f := table(a.picks, "picks.csv"):
        p, left = t.read_picks(spark, f, ev)
        for k, v in left.items():
            if v:
                print(f"{v} picks left out: {k.replace('_', ' ')}")
        pk.insert(0, p)
    if not pk:
        raise ValueError("no picks: give a folder, a project, --picks or --quakeml")
    o = ev.select(F.col("id").alias("event"), "origin_time")
    parts = [p.drop("travel_time_s").join(o, "event").withColumn("travel_time_s", (F.unix_micros("time") - F.unix_micros("origin_time")) / 1e6).drop("origin_time") for p in pk]
    for n, p in enumerate(parts):
        parts[n] = p.withColumn("seq", (F.col("seq") if "seq" in p.columns else F.monotonically_increasing_id()).cast("long"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    return st, ev, relabel_networks(both, st)


def _observations(spark, a, c):
    """Best picks inside the grid with their events and stations; ids as they are, stations in upper case."""
    from pyspark.sql import functions as F

    from quakespark.operators.catalog import best_picks
    from quakespark.plans.tomography import select_observations

    st, ev, pk = _catalogue(spark, a)
    s = st.select(F.upper("id").alias("sid"), F.col("lon").alias("st_lon"), F.col("lat").alias("st_lat"), "elevation_m")
    e = ev.select(F.col("id").alias("eid"), "origin_time", F.col("lon").alias("ev_lon"), F.col("lat").alias("ev_lat"), "depth_km", "magnitude")
    p = best_picks(pk, automatic=c["automatic_picks"]).join(s, F.upper("station") == F.col("sid")).join(e, F.col("event") == F.col("eid"))
    p = p.select(F.col("eid").alias("event"), F.col("sid").alias("station"), "phase", F.col("travel_time_s").alias("time_s"), "sigma_s", "st_lon", "st_lat", "elevation_m", "ev_lon", "ev_lat", "depth_km", "origin_time", "magnitude")
    return select_observations(p, _grid(a), min_phases=c["min_phases_per_event"], outside=c["outside_data"])


def synth(a, c):
    from pyspark.sql import functions as F

    from quakespark.functions.grid import Grid
    from quakespark.plans.synthetic import dataset
    from quakespark.sources.volume import write_volume

    g = Grid.from_spacing(13.0, 13.6, 42.6, 43.1, -2.0, 24.0, 4.0, 2.0)
    d, truth, _ = dataset(_spark(a), g, stations=a.stations, events=a.events, location_error_km=a.location_error, seed=a.seed)
    out = Path(a.out)
    out.mkdir(parents=True, exist_ok=True)
    one = lambda df, name: df.toPandas().to_csv(out / name, index=False)  # noqa: E731 - sizes are options
    one(d.select(F.concat(F.lit("SY.S"), F.col("station")).alias("id"), F.col("st_lon").alias("lon"), F.col("st_lat").alias("lat"), "elevation_m").distinct(), "stations.csv")
    one(d.select(F.concat(F.lit("e"), F.col("event")).alias("id"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("event") % 60).cast("string"), 2, "0"), F.lit("Z")).alias("time"), F.col("ev_lon").alias("lon"), F.col("ev_lat").alias("lat"), "depth_km", "magnitude").distinct(), "events.csv")
    one(d.select(F.concat(F.lit("e"), F.col("event")).alias("event"), F.concat(F.lit("SY.S"), F.col("station")).alias("station"), "phase", F.col("time_s").alias("travel_time_s"), "sigma_s"), "picks.csv")
    q = d.where("phase = 'P'").select(F.concat(F.lit("e"), F.col("event")).alias("event"), F.concat(F.lit("SY.S"), F.col("station")).alias("station"), "phase", (F.col("time_s") / a.q).alias("tstar_s"), F.lit(0.002).alias("sigma_s"))
    one(q, "tstar.csv")
    if a.waveforms:
        from quakespark.plans.synthetic import waveforms
        from quakespark.sources.miniseed import write_miniseed

        # Origin times are whole seconds of one minute, as in events.csv.
        w = waveforms(d.select("event", "station", "phase", "time_s")).withColumn("start", F.col("start") + F.lit(1704067200.0) + F.col("event") % 60)
        w = w.select(F.lit("SY").alias("network"), F.concat(F.lit("S"), F.col("station")).alias("station"), F.lpad(F.col("event").cast("string"), 2, "0").alias("location"), "channel", "start", "rate", F.col("samples").cast("array<float>").alias("samples"))
        write_miniseed(w, str(out / "waveforms")).count()
    (out / "grid.json").write_text(g.to_json())
    for p, v in truth.items():
        write_volume(str(out / f"true_v{p.lower()}.qvol"), g, v, Quantity=f"V{p.lower()}", Units="km/s")


def grid(a, c):
    from pyspark.sql import functions as F

    from quakespark.functions.grid import Grid
    from quakespark.plans.advisor import advise_grid
    from quakespark.sources import tables as t

    if a.bounds:
        v = [float(x) for x in a.bounds.split(",")]
        Path(a.out).write_text(Grid.from_spacing(*v).to_json())
        return
    spark, d = _spark(a), Path(a.data)
    st = t.read_stations(spark, str(d / "stations.csv")).select(F.col("id").alias("station"), F.col("lon").alias("st_lon"), F.col("lat").alias("st_lat"))
    ev = t.read_events(spark, str(d / "events.csv")).select(F.col("lon").alias("ev_lon"), F.col("lat").alias("ev_lat"), "depth_km")
    g, advice = advise_grid(ev, st)
    Path(a.out).write_text(g.to_json())
    print(json.dumps(advice))


def model1d(a, c):
    from quakespark.functions.model1d import LIBRARY, Model1D, choose

    if a.list or a.area:
        box = [float(x) for x in a.area.split(",")] if a.area else None
        for m in choose(list(LIBRARY.values()), *box) if box else LIBRARY.values():
            print(f"{m.name}: {m.reference}")
        return
    m = LIBRARY.get(a.model) or Model1D.parse(Path(a.model).read_text())
    (Path(a.out).write_text(m.to_text()) if a.out else print(m.to_text()))


def _save(out: str, r, g, c, obs=None, settings=None):
    """A run's folder: volumes (also as tables or VTK), tables of residuals, hypocentres, relocated events and stations, iterations and a summary."""
    from dataclasses import asdict

    import pandas as pd
    from pyspark.sql import functions as F

    from quakespark.functions.geo import azimuth, distance_km
    from quakespark.plans.mesh import save
    from quakespark.sources.tables import write_table
    from quakespark.sources.volume import to_csv, to_vtk, write_volume

    o = Path(out)
    o.mkdir(parents=True, exist_ok=True)
    written = []

    def volume(name, quantity, units, values):
        f = str(o / f"{name}.qvol")
        write_volume(f, g, values, Name=f"{o.name} {quantity}", Quantity=quantity, Units=units, Source=o.name)
        written.append({"file": f, "name": f"{o.name} {quantity}", "quantity": quantity, "units": units})
        if "csv" in c["output_formats"]:
            to_csv(f, f[:-5] + ".csv")
        if "vtk" in c["output_formats"]:
            to_vtk(f, f[:-5] + ".vtk")

    for p, v in r.velocity.items():
        volume(f"v{p.lower()}", f"V{p.lower()}", "km/s", v)
        volume(f"dv{p.lower()}", f"dV{p.lower()}", "%", 100 * (v / r.start[p] - 1))
        if p in r.dws:
            volume(f"dws_{p.lower()}", f"DWS_{p}", "km", r.dws[p])
            volume(f"hits_{p.lower()}", f"Hits_{p}", "rays", r.hits[p])
    if {"P", "S"} <= set(r.velocity):
        ratio = r.velocity["P"] / r.velocity["S"]
        volume("vpvs", "VpVs", "", ratio)
        volume("dvpvs", "dVpVs", "%", 100 * (ratio / (r.start["P"] / r.start["S"]) - 1))
    if r.mesh is not None:
        save(r.mesh, g, str(o / "mesh.json"))
        volume("cell_size", "CellSize", "nodes", np.cbrt(np.bincount(r.mesh.of_node))[r.mesh.of_node])
    r.stations.to_csv(o / "station_terms.csv", index=False)
    if obs is not None:
        far, az = distance_km("ev_lon", "ev_lat", "st_lon", "st_lat"), azimuth("ev_lon", "ev_lat", "st_lon", "st_lat")
        at = obs.select("event", "station", "phase", F.round(far, 3).alias("distance_km"), F.round(az, 1).alias("azimuth_deg"), F.col("depth_km").alias("event_depth_km"))
        left = r.residuals.join(at, ["event", "station", "phase"]).withColumn("reason", F.when(F.col("rejected"), "residual far from the event's others").otherwise(""))
        left = left.select("event", "station", "phase", "distance_km", "azimuth_deg", "event_depth_km", "sigma_s", F.col("time_s").alias("observed_s"), "initial_residual_s", F.col("residual").alias("final_residual_s"), F.col("rejected").cast("int").alias("rejected"), "reason")
        write_table(left, str(o / "residuals"), order=["event", "station", "phase"])
        ok = ~F.col("rejected") & F.col("residual").isNotNull()
        per = r.residuals.groupBy("event").agg(F.sqrt(F.avg(F.when(ok, F.pow("residual", 2)))).alias("rms_s"), F.count(F.when(ok, 1)).alias("phases")).toPandas()
        first = obs.select("event", "origin_time", F.col("ev_lon").alias("catalog_lon"), F.col("ev_lat").alias("catalog_lat"), F.col("depth_km").alias("catalog_depth_km"), "magnitude").distinct().toPandas()
        h = r.events.rename(columns={"ev_lon": "lon", "ev_lat": "lat"}).merge(first, on="event").merge(per, on="event").sort_values("event")
        km = 111.195 * np.hypot((h["lon"] - h["catalog_lon"]) * np.cos(np.radians(h["lat"])), h["lat"] - h["catalog_lat"])
        moved = h.assign(origin_shift_s=h["t0"], horizontal_shift_km=km, depth_shift_km=h["depth_km"] - h["catalog_depth_km"], fixed=0)
        moved[["event", "catalog_lon", "catalog_lat", "catalog_depth_km", "lon", "lat", "depth_km", "origin_shift_s", "horizontal_shift_km", "depth_shift_km", "fixed"]].to_csv(o / "hypocentres.csv", index=False)
        time = (h["origin_time"] + pd.to_timedelta(h["t0"], unit="s")).dt.strftime("%Y-%m-%dT%H:%M:%S.%f").str[:-3] + "Z"
        h.assign(id=h["event"], time=time, fixed=0)[["id", "time", "lon", "lat", "depth_km", "magnitude", "rms_s", "phases", "fixed"]].to_csv(o / "events_relocated.csv", index=False)
        mean = lambda p: F.avg(F.when(ok & (F.col("phase") == p), F.col("residual"))).alias(f"mean_residual_{p.lower()}_s")
        n = lambda p: F.count(F.when(ok & (F.col("phase") == p), 1)).alias(f"n_{p.lower()}")
        s = r.residuals.groupBy("station").agg(n("P"), n("S"), mean("P"), mean("S")).join(obs.select("station", F.col("st_lon").alias("lon"), F.col("st_lat").alias("lat"), "elevation_m").distinct(), "station")
        s.toPandas().sort_values("station").to_csv(o / "stations.csv", index=False)
    else:
        r.events.to_csv(o / "hypocentres.csv", index=False)
    if r.formal is not None:
        res, sigma = r.formal
        rows = [(p, float(z), res[q * g.nz + k], sigma[q * g.nz + k]) for q, p in enumerate(r.velocity) for k, z in enumerate(g.axes()[2])]
        pd.DataFrame(rows, columns=["phase", "depth_km", "resolution", "sigma"]).to_csv(o / "resolution.csv", index=False)
    pd.DataFrame(r.history).to_csv(o / "iterations.csv", index=False)
    (o / "iterations.json").write_text(json.dumps(r.history, indent=1))
    (o / "summary.json").write_text(json.dumps({"run": o.name, "settings": asdict(settings) if settings else {}, "iterations": r.history, "volumes": written}, indent=1))
    print(json.dumps(r.history[-1]))


def invert(a, c, **over):
    from quakespark.plans.tomography import Settings
    from quakespark.plans.tomography import invert as run

    spark, g = _spark(a), _grid(a)
    model = "ak135" if a.model in (None, "auto") else a.model
    settings, obs = Settings(**{**c["tomography"], **over}), _observations(spark, a, c).persist()
    pairs = None
    if a.double_differences:
        from pyspark.sql import functions as F

        from quakespark.operators.nearby import pairs_within

        e = obs.select("event", "ev_lon", "ev_lat", "depth_km").distinct()
        pairs = pairs_within(e, settings.max_separation_km, id="event", lat="ev_lat", lon="ev_lon", depth_km="depth_km").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("distance_km").alias("km"))
    _save(a.out, run(spark, obs, g, _model(g, model), settings, pairs=pairs), g, c, obs, settings)


def minimum1d(a, c):
    invert(a, c, layered=True)


def lcurve(a, c):
    import pandas as pd

    from quakespark.plans.tomography import Settings, curve_corner
    from quakespark.plans.tomography import invert as run
    from quakespark.sources.volume import curve_svg

    spark, g = _spark(a), _grid(a)
    obs, start = _observations(spark, a, c).persist(), _model(g, a.model if a.model not in (None, "auto") else "ak135")
    rows = []
    for m in c["lcurve"]["smoothings"]:
        for d in c["lcurve"]["dampings"]:
            r = run(spark, obs, g, start, Settings(**{**c["tomography"], "iterations": 1, "damping": d, "smoothing": m}))
            x = np.log(r.velocity["P"].ravel() / start["P"])
            rows.append({"damping": d, "smoothing": m, "residual_norm": r.history[-1]["rms_s"] * r.history[-1]["used"] ** 0.5, "model_norm": float(np.linalg.norm(x)), "roughness": float(np.linalg.norm(np.diff(x)))})
    t = pd.DataFrame(rows)
    t["corner"] = False
    for m, q in t.groupby("smoothing"):
        t.loc[q.index[curve_corner(q["residual_norm"], q["model_norm"])], "corner"] = True
    Path(a.out).mkdir(parents=True, exist_ok=True)
    t.to_csv(Path(a.out) / "lcurve.csv", index=False)
    Path(a.out, "lcurve.svg").write_text(curve_svg([(r.residual_norm, r.model_norm, f"{r.damping:g}") for r in t.itertuples()]))


def resolution(a, c):
    from quakespark.plans.tomography import Settings, bodies, checkerboard, resolution_test, spikes

    spark, g, r = _spark(a), _grid(a), c["resolution"]
    # Spikes are lists (lon, lat, depth_km, radius_km, percent), bodies as in `bodies`.
    made = {
        "checkerboard": lambda: checkerboard(g, r["cell_km"], r["cell_depth_km"], r["amplitude_percent"]), "spikes": lambda: sum(spikes(g, [tuple(x[:3])], x[3], x[4]) for x in r["spikes"]), "bodies": lambda: bodies(g, r["bodies"]),
    }
    if r["pattern"] not in made:
        raise config.ConfigError(f"resolution.pattern is one of {', '.join(made)}")
    pattern = np.asarray(made[r["pattern"]](), float)
    out = resolution_test(spark, _observations(spark, a, c).drop("time_s"), g, _model(g, "ak135"), pattern, Settings(**c["tomography"]), phase=r["phase"], ratio=r["ratio"], noise={"P": r["noise_p"], "S": r["noise_s"]}, seed=r["seed"])
    if a.out:
        from quakespark.sources.volume import write_volume

        Path(a.out).mkdir(parents=True, exist_ok=True)
        phase = "S" if r["ratio"] else r["phase"]
        got = np.asarray(out["recovered"]).ravel() / _model(g, "ak135")[phase]
        name = "dVpVs" if r["ratio"] else f"dV{phase.lower()}"
        write_volume(str(Path(a.out) / "pattern.qvol"), g, 100 * pattern, Quantity=name, Units="%")
        write_volume(str(Path(a.out) / "recovered.qvol"), g, 100 * ((1 / got if r["ratio"] else got) - 1), Quantity=name, Units="%")
    print(json.dumps({k: out[k] for k in ("correlation", "nodes")}))


def relocate(a, c):
    """Absolute hypocentres, or with `--method dd` relative ones by double differences (and cross-correlation times of `--cc`)."""
    from pyspark.sql import functions as F

    from quakespark.operators.nearby import pairs_within
    from quakespark.plans.locate import locate, relocate_pairs, travel_time_tables
    from quakespark.sources.tables import read_cc_times

    spark, g = _spark(a), _grid(a)
    obs = _observations(spark, a, c).persist()
    slow = {p: 1 / v for p, v in _model(g, a.model if a.model not in (None, "auto") else "ak135").items()}
    Path(a.out).mkdir(parents=True, exist_ok=True)
    if a.method == "dd":
        k = c["double_differences"]
        e = obs.select("event", "ev_lon", "ev_lat", "depth_km", "origin_time").distinct()
        pairs = pairs_within(e, k["max_separation_km"], id="event", lat="ev_lat", lon="ev_lon", depth_km="depth_km").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("distance_km").alias("km"))
        cc = None
        if a.cc:
            o = e.select("event", (F.unix_micros("origin_time") / 1e6).alias("o"))
            m = read_cc_times(spark, a.cc).select(F.trim("event_a").alias("a"), F.trim("event_b").alias("b"), F.upper("station").alias("station"), "phase", "arrival_difference_s", "cc")
            m = m.join(o.withColumnsRenamed({"event": "a", "o": "oa"}), "a").join(o.withColumnsRenamed({"event": "b", "o": "ob"}), "b")
            # Differences of arrival times, less those of origin times, are differences of travel times.
            cc = m.select("a", "b", "station", "phase", (F.col("arrival_difference_s") - (F.col("oa") - F.col("ob"))).alias("dt_s"), "cc")
        out = relocate_pairs(spark, obs, pairs, g, slow, iterations=k["iterations"], max_separation_km=k["max_separation_km"], cutoff_s=k["cutoff_s"], damping=k["damping"], cc=cc)
        out.rename(columns={"event": "id", "ev_lon": "lon", "ev_lat": "lat", "t0": "origin_shift_s"}).sort_values("id").to_csv(Path(a.out) / "locations.csv", index=False)
        return
    t = travel_time_tables(obs.select("station", "st_lon", "st_lat", "elevation_m").distinct(), g, slow).persist()
    out = locate(spark, obs, t, g, **c["locator"]).withColumnRenamed("event", "id")
    out.toPandas().sort_values("id").to_csv(Path(a.out) / "locations.csv", index=False)


def _waveforms(spark, a, c):
    """Windows of all events from the miniSEED files of a data folder, with the folder's stations and events."""
    from pyspark.sql import functions as F

    from quakespark.sources import miniseed
    from quakespark.sources import tables as t

    d = Path(a.data)
    st, ev = t.read_stations(spark, str(d / "stations.csv")), t.read_events(spark, str(d / "events.csv"))
    w = miniseed.cut_events(miniseed.read_miniseed(spark, str(d / "waveforms")), ev, before_s=c["waveforms"]["before_s"], after_s=c["waveforms"]["after_s"])
    return w.withColumn("station", F.concat_ws(".", "network", "station")), st, ev


def _read_picks(spark, a, ev):
    from pyspark.sql import functions as F

    from quakespark.sources import tables as t

    p, _ = t.read_picks(spark, str(Path(a.data) / "picks.csv"), ev)
    return p.withColumn("time", F.unix_micros("time") / 1e6)


def pick(a, c):
    from pyspark.sql import functions as F

    from quakespark.operators.traces import pick_stations
    from quakespark.plans.forward import kernel_rows

    spark, g = _spark(a), _grid(a)
    w, st, ev = _waveforms(spark, a, c)
    slow = {p: 1 / v for p, v in _model(g, a.model if a.model not in (None, "auto") else "ak135").items()}
    e = ev.select(F.col("id").alias("event"), (F.unix_micros("origin_time") / 1e6).alias("origin"), F.col("lon").alias("ev_lon"), F.col("lat").alias("ev_lat"), "depth_km")
    s = st.select(F.upper("id").alias("sid"), F.col("lon").alias("st_lon"), F.col("lat").alias("st_lat"), "elevation_m")
    # Times are predicted for the (event, station) that have waveforms.
    seen = w.select("event", F.upper("station").alias("sid")).distinct().join(e, "event").join(s, "sid")
    rays = seen.select(F.xxhash64("event", "sid").alias("arrival"), F.xxhash64("event").alias("event"), F.xxhash64("sid").alias("station"), F.explode(F.array(F.lit("P"), F.lit("S"))).alias("phase"), "ev_lon", "ev_lat", "depth_km", "st_lon", "st_lat", "elevation_m")
    t = kernel_rows(rays, g, slow, straight=True).groupBy("arrival").agg(F.max(F.when(F.col("phase") == "P", F.col("t_calc"))).alias("tp"), F.max(F.when(F.col("phase") == "S", F.col("t_calc"))).alias("ts"))
    x = w.withColumn("arrival", F.xxhash64("event", F.upper("station"))).join(t, "arrival").join(e.select("event", "origin"), "event")
    x = x.select("event", "station", "channel", "origin", "start", "rate", "samples", (F.col("origin") + F.col("tp")).alias("p_expected"), (F.col("origin") + F.col("ts")).alias("s_expected"))
    out = pick_stations(x, **c["picker"]).withColumn("origin", F.lit("automatic")).withColumnRenamed("uncertainty", "sigma_s")
    out.toPandas().sort_values(["event", "station", "phase"]).to_csv(a.out, index=False)


def tstar(a, c):
    from quakespark.plans.attenuation import corner_grid, fit_tstar, window_spectra

    spark = _spark(a)
    w, _, ev = _waveforms(spark, a, c)
    r = fit_tstar(window_spectra(w, _read_picks(spark, a, ev)), corner_grid())
    r.toPandas().rename(columns={"fit": "station", "tstar": "tstar_s"}).sort_values(["event", "station"]).to_csv(a.out, index=False)


def crosscorr(a, c):
    from pyspark.sql import functions as F

    from quakespark.operators.nearby import pairs_within
    from quakespark.plans.crosscorr import measure, windows

    spark, k = _spark(a), c["crosscorr"]
    w, _, ev = _waveforms(spark, a, c)
    pairs = pairs_within(ev, k["max_separation_km"], id="id", lat="lat", lon="lon", depth_km="depth_km").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    r = measure(windows(w, _read_picks(spark, a, ev), low_hz=k["low_hz"], high_hz=k["high_hz"]), pairs)
    r.toPandas().sort_values(["event_a", "event_b", "station", "phase"]).to_csv(a.out, index=False)


def qtomo(a, c):
    from pyspark.sql import functions as F

    from quakespark.plans.attenuation import invert_q
    from quakespark.sources import tables as t
    from quakespark.sources.volume import write_volume

    spark, g, d = _spark(a), _grid(a), Path(a.data)
    st, ev = t.read_stations(spark, str(d / "stations.csv")), t.read_events(spark, str(d / "events.csv"))
    s = st.select(F.upper("id").alias("sid"), F.col("lon").alias("st_lon"), F.col("lat").alias("st_lat"), "elevation_m")
    e = ev.select(F.col("id").alias("eid"), F.col("lon").alias("ev_lon"), F.col("lat").alias("ev_lat"), "depth_km")
    r = t.read_tstar(spark, str(d / "tstar.csv")).where("phase = 'P' and not disabled and tstar_s is not null")
    r = r.join(s, F.upper("station") == F.col("sid")).join(e, F.col("event") == F.col("eid"))
    r = r.select(F.col("eid").alias("event"), F.col("sid").alias("station"), F.col("tstar_s").alias("tstar"), "sigma_s", "st_lon", "st_lat", "elevation_m", "ev_lon", "ev_lat", "depth_km")
    q = invert_q(spark, r, g, 1 / _model(g, a.model if a.model not in (None, "auto") else "ak135")["P"], **c["attenuation"])
    write_volume(str(Path(a.out) / "qp.qvol"), g, q["q"], Quantity="Qp")
    write_volume(str(Path(a.out) / "qp_inverse.qvol"), g, 1000 / np.asarray(q["q"]), Quantity="1000/Qp")
    q["stations"].to_csv(Path(a.out) / "station_terms.csv", index=False)
    print(json.dumps({"q0": q["q0"], "rms": q["rms"][-1]}))


def mechanism(a, c):
    from quakespark.operators.source import first_readings
    from quakespark.plans.source import mechanisms
    from quakespark.sources import tables as t

    spark = _spark(a)
    m = mechanisms(first_readings(t.read_polarities(spark, a.data), order="ordinal"), **c["mechanism"]).withColumnRenamed("event", "id")
    m.toPandas().sort_values("id").to_csv(a.out, index=False)


def stress(a, c):
    from pyspark.sql import functions as F

    from quakespark.plans.source import invert_stress, stress_bootstrap
    from quakespark.sources import tables as t

    m = t.read_mechanisms(_spark(a), a.data).select(F.col("strike1").alias("strike"), F.col("dip1").alias("dip"), F.col("rake1").alias("rake"), F.lit(1.0).alias("weight"))
    best = invert_stress(m.toPandas())
    b = stress_bootstrap(m, friction=best["friction"], **c["stress"]).toPandas()
    out = {k: v for k, v in best.items() if isinstance(v, float)} | {"ratio_2.5": float(b["ratio"].quantile(0.025)), "ratio_97.5": float(b["ratio"].quantile(0.975))}
    Path(a.out).write_text(json.dumps(out, indent=1))


def coulomb(a, c):
    from quakespark.plans import source as s

    spark = _spark(a)
    v = json.loads(Path(a.data).read_text())
    p = s.tapered_source(**v["source"])
    from quakespark.sources.tables import read_receivers

    r = read_receivers(spark, a.receivers) if a.receivers else s.receiver_plane(spark, **v["receivers"])
    s.coulomb(r, p, friction=v.get("friction", 0.4)).toPandas().to_csv(a.out, index=False)


def kagan(a, c):
    from quakespark.plans.source import kagan as angle
    from quakespark.plans.source import vectors

    x = [float(v) for v in a.angles]
    print(f"{float(angle(*vectors(*x[:3]), *vectors(*x[3:]))):.2f}")


def export(a, c):
    from quakespark.sources.volume import to_csv, to_vtk

    (to_vtk if a.out.endswith(".vtk") else to_csv)(a.data, a.out)


def register(a, c):
    """Enter the run folder `--out` into the project `data`."""
    from quakespark.sources.project import register_run
    from quakespark.sources.volume import read_header

    volumes = [(str(p), read_header(str(p))[0]) for p in sorted(Path(a.out).glob("*.qvol"))]
    n = register_run(a.data, a.out, [{"file": f, "name": h.get("Name") or Path(f).stem, "quantity": h.get("Quantity", ""), "units": h.get("Units", "")} for f, h in volumes])
    print(f"{n} volumes")


def show_config(a, c):
    """The settings in force; with `--update FILE` that file's settings with those of `--set`, written back to it."""
    if a.update:
        f = Path(a.update)
        values = json.loads(f.read_text(encoding="utf-8")) if f.exists() else {}
        for s in a.set:
            name, _, text = s.partition("=")
            *path, last = name.strip().split(".")
            at = values
            for k in path:
                at = at.setdefault(k, {})
            whole = config.set_value(config.DEFAULTS, name.strip(), text.strip())
            for k in path:
                whole = whole[k]
            at[last] = whole[last]
        part = f.with_suffix(".tmp")
        part.write_text(json.dumps(values, indent=2), encoding="utf-8")
        part.replace(f)
        return
    print(json.dumps(c, indent=2))


def info(a, c):
    import pyspark

    print(f"quakespark {__version__}, pyspark {pyspark.__version__}, {os.cpu_count()} cores")


def run_script(a, c):
    from quakespark.script import Script

    return Script(main, dict(v.split("=", 1) for v in a.var), keep_going=a.keep_going, dry_run=a.dry_run).run(a.data)


COMMANDS = {"synth": synth, "grid": grid, "model1d": model1d, "invert": invert, "minimum1d": minimum1d, "lcurve": lcurve, "resolution": resolution, "relocate": relocate, "pick": pick, "tstar": tstar, "crosscorr": crosscorr, "qtomo": qtomo, "mechanism": mechanism, "stress": stress, "coulomb": coulomb, "kagan": kagan, "export": export, "register": register, "config": show_config, "info": info, "run": run_script}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quakespark")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        s = sub.add_parser(name)
        s.add_argument("--config")
        s.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        s.add_argument("--threads", type=int)
        if name == "kagan":
            s.add_argument("angles", nargs=6)
            continue
        if name in ("invert", "minimum1d", "lcurve", "resolution", "relocate"):
            s.add_argument("data", nargs="?")
            for o in ("stations", "events", "picks", "hypocentres"):
                s.add_argument(f"--{o}")
            s.add_argument("--quakeml", action="append", default=[])
            s.add_argument("--stationxml", action="append", default=[])
            s.add_argument("--catalog-locations", action="store_true")
        elif name not in ("synth", "config", "info", "model1d", "grid"):
            s.add_argument("data")
        if name == "grid":
            s.add_argument("data", nargs="?")
            s.add_argument("--bounds", help="min_lon,max_lon,min_lat,max_lat,min_depth,max_depth,horizontal_km,vertical_km")
        if name in ("invert", "minimum1d"):
            s.add_argument("--double-differences", action="store_true")
        if name == "relocate":
            s.add_argument("--method", choices=["absolute", "dd"], default="absolute")
            s.add_argument("--cc")
        if name == "model1d":
            s.add_argument("--list", action="store_true")
            s.add_argument("--area", help="min_lon,max_lon,min_lat,max_lat")
        if name in ("invert", "minimum1d", "lcurve", "resolution", "relocate", "pick", "qtomo"):
            s.add_argument("--grid", required=True)
        if name in ("invert", "minimum1d", "lcurve", "relocate", "model1d", "pick", "qtomo"):
            s.add_argument("--model", default="ak135" if name == "model1d" else None)
        if name not in ("config", "info", "run"):
            s.add_argument("--out", required=name not in ("model1d", "resolution"))
        if name == "synth":
            for o, d, k in (("stations", 25, int), ("events", 150, int), ("seed", 12345, int), ("location-error", 0.0, float)):
                s.add_argument(f"--{o}", type=k, default=d)
        if name == "synth":
            s.add_argument("--q", type=float, default=200.0)
            s.add_argument("--waveforms", action="store_true")
        if name == "coulomb":
            s.add_argument("--receivers")
        if name == "config":
            s.add_argument("--update")
        if name == "run":
            s.add_argument("--var", action="append", default=[])
            s.add_argument("--keep-going", action="store_true")
            s.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        c = config.load(file=a.config, sets=a.set)
        return COMMANDS[a.command](a, c) or 0
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001 - a command line reports, it does not raise
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
