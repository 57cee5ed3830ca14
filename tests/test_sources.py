"""Readers, writers, settings, scripts and streams: round trips and hand-made files."""

import json
import sqlite3

import numpy as np
import pandas as pd
import pytest

from quakespark import cli, config
from quakespark.functions.grid import Grid
from quakespark.script import Script, ScriptError
from quakespark.sources import miniseed, project, tables, volume, xml

GRID = Grid(13.0, 13.6, 42.6, 43.1, -2.0, 24.0, 5, 4, 3)


def test_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿# stations\nNetwork;Station;Longitude;Latitude;Depth_km\nSY;S1;13.1;42.7;-0.5\n\nSY;S2;13.2;42.8;0\n")
    s = {r["id"]: r for r in tables.read_stations(spark, str(tmp_path / "s.csv")).collect()}
    assert s["SY.S1"]["elevation_m"] == 500 and s["SY.S2"]["lon"] == 13.2
    (tmp_path / "e.csv").write_text("id,time,lon,lat,depth_km,magnitude\ne1,2024-01-01T00:00:00Z,13,42.7,5,nan\ne2,1704067260.5,13,42.7,5,2\n")
    e = tables.read_events(spark, str(tmp_path / "e.csv"))
    assert {r["id"]: r["magnitude"] for r in e.collect()} == {"e1": None, "e2": 2.0}
    (tmp_path / "p.csv").write_text("event,station,phase,travel_time_s,sigma_s,origin\ne1,SY.S1,Pg,3.5,,m\ne1,SY.S1,PmP,4,,\nzz,SY.S1,P,4,,\ne2,SY.S2,S,6.25,0.3,auto\n")
    p, left = tables.read_picks(spark, str(tmp_path / "p.csv"), e)
    got = {r["event"]: r for r in p.collect()}
    assert left == {"later_phases": 1, "unknown_events": 1} and got["e1"]["sigma_s"] == 0.1 and got["e2"]["origin"] == "automatic" and str(got["e2"]["time"]) == "2024-01-01 00:01:06.750000"
    (tmp_path / "bad.csv").write_text("id,lon,lat\nA,abc,42\n")
    with pytest.raises(Exception, match="not a number"):
        tables.read_stations(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "twice.csv").write_text("id,time,lon,lat,depth_km\ne1,0,1,1,1\ne1,0,1,1,1\n")
    with pytest.raises(ValueError, match="occurs twice"):
        tables.read_events(spark, str(tmp_path / "twice.csv"))
    assert tables.read_cc_times(spark, str(tmp_path / "none.csv")).count() == 0
    tables.write_table(e, str(tmp_path / "out"), order=["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


QUAKE = """<q:quakeml xmlns:q="http://quakeml.org/xmlns/quakeml/1.2" xmlns="http://quakeml.org/xmlns/bed/1.2"><eventParameters><event publicID="smi:x/event/ab#1">
<preferredOriginID>o2</preferredOriginID><origin publicID="o1"><time><value>2024-01-01T00:00:00Z</value></time><longitude><value>1</value></longitude><latitude><value>2</value></latitude></origin>
<origin publicID="o2"><time><value>2024-01-01T00:00:10Z</value></time><longitude><value>13</value></longitude><latitude><value>42</value></latitude><depth><value>7000</value></depth>
<arrival><pickID>p1</pickID><phase>Pn</phase><timeWeight>0.5</timeWeight></arrival></origin><magnitude><mag><value>2.5</value></mag></magnitude>
<pick publicID="p1"><time><value>2024-01-01T00:00:15.5Z</value><lowerUncertainty>0.1</lowerUncertainty><upperUncertainty>0.3</upperUncertainty></time><waveformID networkCode="SY" stationCode="S1"/><phaseHint>S</phaseHint><evaluationMode>manual</evaluationMode></pick>
<pick publicID="p2"><time><value>2024-01-01T00:00:16Z</value></time><waveformID networkCode="SY" stationCode="S2"/><phaseHint>P</phaseHint></pick></event></eventParameters></q:quakeml>"""
STATIONS = """<FDSNStationXML><Network code="SY"><Station code="S1"><Latitude>42</Latitude><Longitude>13</Longitude><Elevation>100</Elevation>
<Channel code="HHZ" locationCode="" startDate="2010-01-01T00:00:00" endDate="2015-01-01T00:00:00"><Latitude>42</Latitude><Longitude>13</Longitude><Elevation>100</Elevation><SampleRate>100</SampleRate></Channel>
<Channel code="HHZ" locationCode="" startDate="2015-01-01T00:00:00"><Latitude>42.5</Latitude><Longitude>13.5</Longitude><Elevation>200</Elevation><SampleRate>100</SampleRate><Response><InstrumentSensitivity><Value>5</Value><InputUnits><Name>M/S</Name></InputUnits></InstrumentSensitivity>
<Stage><PolesZeros><NormalizationFactor>2</NormalizationFactor><Zero><Real>0</Real><Imaginary>0</Imaginary></Zero><Pole><Real>-1</Real><Imaginary>1</Imaginary></Pole></PolesZeros><StageGain><Value>10</Value></StageGain></Stage>
<Stage><FIR><Symmetry>ODD</Symmetry><NumeratorCoefficient>1</NumeratorCoefficient><NumeratorCoefficient>3</NumeratorCoefficient></FIR><StageGain><Value>4</Value></StageGain></Stage></Response></Channel></Station></Network></FDSNStationXML>"""


def test_xml(spark, tmp_path):
    (tmp_path / "q.xml").write_text(QUAKE)
    e, p = xml.read_quakeml(spark, str(tmp_path / "q.xml"))
    r, q = e.collect(), p.collect()
    assert len(r) == 1 and r[0]["id"] == "1" and r[0]["depth_km"] == 7 and r[0]["magnitude"] == 2.5
    assert len(q) == 1 and q[0]["phase"] == "P" and q[0]["sigma_s"] == pytest.approx(0.2) and q[0]["quality"] == 2 and q[0]["origin"] == "manual"
    (tmp_path / "s.xml").write_text(STATIONS)
    c = xml.read_stationxml(spark, str(tmp_path / "s.xml"))
    rows = c.orderBy("ordinal").collect()
    assert rows[1]["gain"] == 80 and rows[1]["fir"] == [1, 3, 1] and rows[1]["poles"] == [-1, 1]
    s = xml.station_coordinates(c).collect()
    assert s[0]["lat"] == 42.5 and s[0]["elevation_m"] == 200


def test_miniseed(spark, tmp_path):
    x = np.sin(np.arange(1000) / 5).astype(np.float32)
    data = miniseed.encode("SY", "S001", "", "HHZ", 1704067200.1234, 100.0, x)
    (tmp_path / "a.mseed").write_bytes(b"\0" * 256 + data)  # damage is skipped
    r = miniseed.read_miniseed(spark, str(tmp_path / "a.mseed")).collect()
    assert len(r) == 1 and np.allclose(r[0]["samples"], x) and abs(r[0]["start"] - 1704067200.1234) < 1e-4
    y = np.cumsum(np.random.default_rng(0).integers(-40000, 40000, 70)).astype(int)
    y[10:30] = y[10] + np.arange(20)
    rec = miniseed.parse(miniseed.record("SY", "S001", "00", "HHZ", 1704067200.0, 50.0, y, 1, integers=True))
    assert (rec[0]["samples"] == y.astype(np.float32)).all() and rec[0]["rate"] == 50
    d = spark.createDataFrame([("SY", "S001", "", "HHZ", 1704067200.0, 100.0, x.tolist())], miniseed.RECORD)
    assert miniseed.write_miniseed(d, str(tmp_path / "out")).collect()[0]["bytes"] > 4000
    assert miniseed.read_miniseed(spark, str(tmp_path / "out")).count() == 1


def test_event_windows(spark):
    x = [float(i) for i in range(6000)]
    rows = [("SY", "S1", "", c, 100.0, 100.0, x) for c in ("HHZ", "HHN", "HNZ")]
    ev = spark.createDataFrame([("e1", pd.Timestamp("1970-01-01 00:02:00").to_pydatetime())], "id string, origin_time timestamp")
    r = miniseed.cut_events(spark.createDataFrame(rows, miniseed.RECORD), ev, before_s=10, after_s=20).collect()
    assert {q["channel"] for q in r} == {"HHZ", "HHN"} and all(len(q["samples"]) == 3001 and q["start"] == 110 for q in r)


def test_stitching(spark):
    from quakespark.operators.traces import stitch

    s = [("A", 0.0, 10.0, [1.0] * 10), ("A", 1.0, 10.0, [2.0] * 10), ("A", 1.2, 10.0, [9.0] * 3), ("A", 5.0, 10.0, [3.0] * 5)]
    r = stitch(spark.createDataFrame(s, "ch string, start double, rate double, samples array<double>"), by=["ch"]).orderBy("start").collect()
    assert [len(q["samples"]) for q in r] == [20, 5] and r[0]["samples"] == [1.0] * 10 + [2.0] * 10


def test_volumes(spark, tmp_path):
    v = np.arange(GRID.nodes, dtype=float)
    v[3] = np.nan
    f = str(tmp_path / "a.qvol")
    volume.write_volume(f, GRID, v, Quantity="Vp")
    h, g, got = volume.read_volume(f)
    assert g == GRID and h["Max"] == GRID.nodes - 1 and np.array_equal(np.asarray(got).ravel(), v.astype(np.float32), equal_nan=True)
    t = volume.volume_table(spark, f)
    assert t.count() == GRID.nodes and t.where("value is null").count() == 1 and t.where("k = 1").agg({"value": "min"}).first()[0] == 20
    assert volume.sample(f, [13.6], [43.1], [24.0])[0] == GRID.nodes - 1 and len(volume.on_grid(f, GRID.refined(2))) == GRID.refined(2).nodes
    volume.to_csv(f, str(tmp_path / "a.csv"))
    volume.to_vtk(f, str(tmp_path / "a.vtk"))
    assert len((tmp_path / "a.csv").read_text().splitlines()) == GRID.nodes + 1 and b"STRUCTURED_GRID" in (tmp_path / "a.vtk").read_bytes()
    q = np.array([[13.0, 42.6, 1.0], [13.1, 42.7, 2.0]], np.float32)
    volume.write_rays(str(tmp_path / "r"), [(1, 2, 3, 0, q)])
    assert np.array_equal(volume.read_rays(str(tmp_path / "r"))[0][4], q)
    assert "<svg" in volume.curve_svg([(1, 10, "a"), (2, 5, "b")], 1)


def test_project(spark, tmp_path):
    (tmp_path / "project.json").write_text(json.dumps({"Name": "x"}))
    (tmp_path / "stations.json").write_text(json.dumps([{"Network": "SY", "Code": "S1", "Longitude": 13, "Latitude": 42}]))
    con = sqlite3.connect(tmp_path / "catalog.sqlite")
    con.execute("create table events(rid integer, ord integer, data blob)")
    con.execute("create table channels(cid integer, network text, station text, location text, channel text)")
    con.execute("create table picks(event_rid integer, seq integer, cid integer, time integer, uncertainty real, flags integer)")
    con.execute("create table tstar(rid integer, data blob)")
    hyp = {"OriginTime": "2024-01-01T00:00:00Z", "Longitude": 13.0, "Latitude": 42.0, "DepthKm": 5.0}
    con.execute("insert into events values(1, 1, ?)", (json.dumps({"Id": "e1", "Magnitude": 2.0, "Catalog": hyp, "Relocated": {**hyp, "DepthKm": 6.0}}).encode(),))
    con.execute("insert into channels values(7, 'SY', 'S1', '', 'HHZ')")
    ticks = (1704067205 + 62135596800) * 10_000_000
    con.execute("insert into picks values(1, 0, 7, ?, 0.05, ?)", (ticks, 1 | 2 << 4 | 2 << 8 | 1 << 15))
    con.execute("insert into picks values(1, 1, 7, ?, 0.05, 2)", (ticks,))
    con.execute("insert into tstar values(1, ?)", (json.dumps({"EventId": "e1", "StationId": "SY.S1", "Phase": "P", "TStar": 0.02, "Uncertainty": 0}).encode(),))
    con.commit()
    d = project.read_project(spark, str(tmp_path))
    p = d["picks"].collect()
    assert len(p) == 1 and p[0]["phase"] == "S" and p[0]["quality"] == 2 and p[0]["origin"] == "manual" and p[0]["disabled"] == 1 and str(p[0]["time"]) == "2024-01-01 00:00:05"
    assert d["events"].first()["depth_km"] == 6 and project.read_project(spark, str(tmp_path), catalog_locations=True)["events"].first()["depth_km"] == 5
    assert d["tstar"].first()["sigma_s"] == 0.005 and project.read_settings(str(tmp_path))["Name"] == "x"
    run = tmp_path / "elsewhere" / "r1"
    run.mkdir(parents=True)
    (run / "summary.json").write_text("{}")
    volume.write_volume(str(run / "vp.qvol"), GRID, np.ones(GRID.nodes), Quantity="Vp", Units="km/s")
    for _ in range(2):  # a run registered twice has its volumes once
        assert project.register_run(str(tmp_path), str(run), [{"file": str(run / "vp.qvol"), "name": "r1 Vp", "quantity": "Vp", "units": "km/s"}]) == 1
    listed = json.loads((tmp_path / "project.json").read_text())["Volumes"]
    assert [v["File"] for v in listed] == ["volumes/vp.qvol"] and (tmp_path / "volumes" / "vp.qvol").exists() and (tmp_path / "runs" / "r1" / "summary.json").exists() and (tmp_path / "project.json.bak").exists()


def test_settings(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"tomography": {"damping": 7}}))
    c = config.load(file=str(f), sets=["tomography.smoothing=3", "starting_model=prem"])
    assert c["tomography"]["damping"] == 7 and c["tomography"]["smoothing"] == 3 and c["starting_model"] == "prem"
    with pytest.raises(config.ConfigError):
        config.load(sets=["nonsense=1"])
    assert json.loads(config.template())["stress"]["realizations"] == 2000


def test_scripts(tmp_path, monkeypatch):
    monkeypatch.setenv("WHERE", "here")
    (tmp_path / "v.json").write_text('{"a": {"b": [1, 2]}}')
    (tmp_path / "inc.q").write_text("one included\n")
    (tmp_path / "s.q").write_text('set A = "x y"\ndefault A = z\nforeach N in 1 2\n  one ${N} \\\n    --w ${env:WHERE}\nend\nif missing nothing\n  two "${A}" ${json:v.json:a.b.1}\nend\n-fails\ninclude inc.q\nexit\none never\n')
    seen = []
    s = Script(lambda a: seen.append(a) or int(a[0] == "fails"))
    assert s.run(str(tmp_path / "s.q")) == 1
    assert seen == [["one", "1", "--w", "here"], ["one", "2", "--w", "here"], ["two", "x y", "2"], ["fails"], ["one", "included"]]
    (tmp_path / "bad.q").write_text("foreach N in 1\none\n")
    with pytest.raises(ScriptError, match="line 1"):
        Script(lambda a: 0).run(str(tmp_path / "bad.q"))


def test_command_line(capsys, tmp_path):
    assert cli.main(["kagan", "160", "80", "-10", "160", "80", "-10"]) == 0 and capsys.readouterr().out.strip() == "0.00"
    assert cli.main(["nonsense"]) == 2 and cli.main(["config", "--set", "nonsense=1"]) == 2 and cli.main(["export", str(tmp_path / "no"), "--out", "x.csv"]) == 1
    assert cli.main(["model1d", "--list"]) == 0 and "prem" in capsys.readouterr().out
    assert cli.main(["config", "--update", str(tmp_path / "u.json"), "--set", "tomography.damping=3"]) == 0 and json.loads((tmp_path / "u.json").read_text()) == {"tomography": {"damping": 3}}
    assert cli.main(["grid", "--bounds", "13,13.6,42.6,43.1,-2,24,4,2", "--out", str(tmp_path / "g.json")]) == 0 and Grid.from_json((tmp_path / "g.json").read_text()).min_lat == 42.6
    assert cli.main(["model1d", "--out", str(tmp_path / "m.txt")]) == 0 and (tmp_path / "m.txt").read_text().startswith("0 5.8 3.46")


def test_streams(spark, tmp_path):
    from quakespark.streaming.state import detect, pick_rates

    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.1, 4000)
    x[2000:2300] += 3 * np.sin(np.arange(300))
    rows = [("A", i / 100, 100.0, x[i : i + 500].tolist()) for i in range(0, 4000, 500)]
    rows += [("B", i / 100, 100.0, rng.normal(0, 0.1, 500).tolist()) for i in range(0, 4000, 500)] + [rows[2]]
    d = spark.createDataFrame(rows, "nslc string, start double, rate double, samples array<double>")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = detect(s.coalesce(1)).writeStream.format("memory").queryName("triggers").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("triggers").collect()
    assert got and {r["nslc"] for r in got} == {"A"} and abs(min(r["time"] for r in got) - 20.0) < 0.5
    p = pd.DataFrame({"time": pd.date_range("2024-01-01", periods=100, freq="1min"), "station": "S", "phase": "P", "residual": 0.5})
    spark.createDataFrame(p).write.parquet(str(tmp_path / "p"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "p")).schema).parquet(str(tmp_path / "p"))
    q = pick_rates(s).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["n"] for r in spark.table("rates").collect()} == {5}


def test_commands_end_to_end(spark, tmp_path):
    """Synthetic data, location, picking, cross-correlation, t* and Q by the command line."""
    from quakespark.plans import synthetic

    d = tmp_path / "data"
    assert cli.main(["synth", "--out", str(d), "--stations", "6", "--events", "8"]) == 0
    ev = pd.read_csv(d / "events.csv")
    ev["time"] = [f"2024-01-01T00:{10 + i:02d}:00Z" for i in range(len(ev))]
    ev.to_csv(d / "events.csv", index=False)
    assert cli.main(["relocate", str(d), "--grid", str(d / "grid.json"), "--out", str(tmp_path / "loc")]) == 0
    loc = pd.read_csv(tmp_path / "loc" / "locations.csv").merge(ev, on="id")
    assert len(loc) == 8 and np.median(np.hypot((loc["lon_x"] - loc["lon_y"]) * 82, (loc["lat_x"] - loc["lat_y"]) * 111)) < 3
    cc = pd.read_csv(d / "picks.csv").merge(ev.rename(columns={"id": "event"})[["event", "time"]], on="event")
    cc["at"] = pd.to_datetime(cc["time"]).map(lambda t: t.timestamp()) + cc["travel_time_s"]
    cc = cc.merge(cc, on=["station", "phase"])
    cc = cc[cc["event_x"] > cc["event_y"]]
    pd.DataFrame({"event_a": cc["event_x"], "event_b": cc["event_y"], "station": cc["station"], "phase": cc["phase"], "arrival_difference_s": cc["at_x"] - cc["at_y"], "lag_s": 0.0, "cc": 0.9}).to_csv(tmp_path / "cc_in.csv", index=False)
    dd = ["relocate", str(d), "--grid", str(d / "grid.json"), "--method", "dd", "--set", "double_differences.max_separation_km=60", "--set", "double_differences.cutoff_s=3"]
    assert cli.main([*dd, "--out", str(tmp_path / "dd")]) == 0 and cli.main([*dd, "--cc", str(tmp_path / "cc_in.csv"), "--out", str(tmp_path / "ddcc")]) == 0
    assert len(pd.read_csv(tmp_path / "dd" / "locations.csv")) == 8 == len(pd.read_csv(tmp_path / "ddcc" / "locations.csv"))
    assert cli.main(["invert", str(d), "--grid", str(d / "grid.json"), "--out", str(tmp_path / "run"), "--set", "tomography.iterations=1", "--set", "tomography.straight=true", "--set", "tomography.adaptive=true"]) == 0
    summary = json.loads((tmp_path / "run" / "summary.json").read_text())
    assert {"Vp", "dVp", "DWS_P", "Hits_P", "Vs", "VpVs", "dVpVs", "CellSize"} <= {v["quantity"] for v in summary["volumes"]} and (tmp_path / "run" / "mesh.json").exists()
    assert len(pd.read_csv(tmp_path / "run" / "events_relocated.csv")) == 8 and {"initial_residual_s", "final_residual_s", "reason"} <= set(spark.read.option("header", True).csv(str(tmp_path / "run" / "residuals")).columns)
    p = pd.read_csv(d / "picks.csv")
    p["event"], p["station"] = p["event"].str[1:].astype(int), p["station"].str[4:].astype(int)
    w = synthetic.waveforms(spark.createDataFrame(p.rename(columns={"travel_time_s": "time_s"})), snr=100.0).toPandas()
    (d / "waveforms").mkdir()
    at = {i: pd.Timestamp(t).timestamp() for i, t in zip(ev["id"].str[1:], ev["time"])}
    for n, r in enumerate(w.itertuples()):
        (d / "waveforms" / f"{n}.mseed").write_bytes(miniseed.encode("SY", f"S{r.station}", "", r.channel, at[r.event] + r.start, 100.0, np.asarray(r.samples)))
    assert cli.main(["pick", str(d), "--grid", str(d / "grid.json"), "--out", str(tmp_path / "auto.csv"), "--set", "waveforms.before_s=10", "--set", "waveforms.after_s=40"]) == 0
    auto = pd.read_csv(tmp_path / "auto.csv")
    true = pd.read_csv(d / "picks.csv")
    m = auto.merge(true, on=["event", "station", "phase"])
    error = m["time"] - m["event"].str[1:].map(at) - m["travel_time_s"]
    assert len(m) > 60 and error.abs().median() < 0.06
    assert cli.main(["tstar", str(d), "--out", str(d / "tstar.csv"), "--set", "waveforms.before_s=10"]) == 0
    assert len(pd.read_csv(d / "tstar.csv")) > 20
    assert cli.main(["crosscorr", str(d), "--out", str(tmp_path / "cc.csv"), "--set", "crosscorr.max_separation_km=60", "--set", "waveforms.before_s=10"]) == 0
    cc = pd.read_csv(tmp_path / "cc.csv")
    assert len(cc) > 20 and (cc["cc"] >= 0.7).all()
    body = '[{"lon":13.3,"lat":42.85,"depth_km":8,"strike":30,"dip":60,"length_km":40,"width_km":16,"thickness_km":8,"percent":5}]'
    assert cli.main(["resolution", str(d), "--grid", str(d / "grid.json"), "--out", str(tmp_path / "res2"), "--set", "tomography.iterations=1", "--set", "tomography.straight=true", "--set", "resolution.pattern=bodies", "--set", f"resolution.bodies={body}", "--set", "resolution.ratio=true"]) == 0
    assert cli.main(["resolution", str(d), "--grid", str(d / "grid.json"), "--out", str(tmp_path / "res"), "--set", "tomography.iterations=1", "--set", "tomography.straight=true"]) == 0 and (tmp_path / "res" / "recovered.qvol").exists()
    assert cli.main(["minimum1d", str(d), "--grid", str(d / "grid.json"), "--out", str(tmp_path / "m1"), "--set", "tomography.iterations=1", "--set", "tomography.straight=true"]) == 0
    assert cli.main(["export", str(tmp_path / "m1" / "vp.qvol"), "--out", str(tmp_path / "vp.vtk")]) == 0
    q = pd.DataFrame({"event": true["event"], "station": true["station"], "tstar_s": true["travel_time_s"] / 200, "phase": true["phase"]})
    q.to_csv(d / "tstar.csv", index=False)
    assert cli.main(["qtomo", str(d), "--grid", str(d / "grid.json"), "--out", str(tmp_path / "q"), "--set", "attenuation.turns=2"]) == 0
    assert 150 < float(np.median(np.asarray(volume.read_volume(str(tmp_path / "q" / "qp.qvol"))[2]))) < 260


def test_catalogue_from_xml_and_tables(spark, tmp_path):
    """Stations from StationXML, events and picks from QuakeML, moved by a table of hypocentres; a table wins over a file of the same key."""
    from types import SimpleNamespace

    (tmp_path / "q.xml").write_text(QUAKE)
    (tmp_path / "s.xml").write_text(STATIONS)
    (tmp_path / "h.csv").write_text("id,time,lon,lat,depth_km\n1,2024-01-01T00:00:10Z,13.5,42.5,9\n")
    a = dict(data=None, stations=None, events=None, picks=None, hypocentres=None, quakeml=[str(tmp_path / "q.xml")], stationxml=[str(tmp_path / "s.xml")], catalog_locations=False)
    st, ev, pk = cli._catalogue(spark, SimpleNamespace(**a))
    assert st.first()["elevation_m"] == 200 and ev.first()["depth_km"] == 7 and pk.first()["travel_time_s"] == pytest.approx(5.5)
    _, ev, _ = cli._catalogue(spark, SimpleNamespace(**{**a, "hypocentres": str(tmp_path / "h.csv")}))
    assert ev.first()["depth_km"] == 9
    (tmp_path / "stations.csv").write_text("id,lon,lat,elevation_m\nsy.s1,1,2,3\n")
    assert cli._catalogue(spark, SimpleNamespace(**{**a, "stations": str(tmp_path / "stations.csv")}))[0].select("lon", "elevation_m").collect() == [(1.0, 3.0)]
    with pytest.raises(ValueError, match="no stations"):
        cli._catalogue(spark, SimpleNamespace(**{**a, "stationxml": []}))
    (tmp_path / "e.csv").write_text("id,time,lon,lat,depth_km\ne1,yesterday,1,1,1\n")
    with pytest.raises(Exception, match="not a time: yesterday"):
        tables.read_events(spark, str(tmp_path / "e.csv"), check=False).collect()


def test_matrix_file_and_matched_streams(spark, tmp_path):
    from quakespark.plans.linalg import Csr
    from quakespark.streaming.state import arrivals_with_events

    a = Csr.build([0, 0, 2], [1, 3, 0], [1.5, -2.0, 4.0], 3, 4)
    volume.write_matrix(str(tmp_path / "g.qcsr"), a)
    raw = (tmp_path / "g.qcsr").read_bytes()
    assert raw[:4] == b"QCSR" and np.frombuffer(raw, "<i4", 3, 4).tolist() == [3, 4, 3] and np.frombuffer(raw, "<f4", 3, len(raw) - 12).tolist() == [1.5, -2.0, 4.0]
    t = pd.date_range("2024-01-01", periods=4, freq="10min")
    spark.createDataFrame(pd.DataFrame({"rid": [1, 2, 3, 4], "origin_time": t})).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame(pd.DataFrame({"event_rid": [1, 2, 9], "station": "S", "phase": "P", "time": t[:3] + pd.Timedelta("30s")})).write.parquet(str(tmp_path / "p"))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    q = arrivals_with_events(read("p"), read("e")).writeStream.format("memory").queryName("matched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["event_rid"] for r in spark.table("matched").collect()} == {1, 2}

