"""Queries of readers, writers and kernels that other query modules leave out: tables are written to the shared folder in a format, read back, and
must give the rows that SQL takes from the tables themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark import fixtures as fx
from quakespark.catalog_queries import GRID
from quakespark.common import Scratch, spread, table
from quakespark.functions import geo
from quakespark.functions import signal as sg
from quakespark.functions.grid import Grid
from quakespark.functions.model1d import Model1D
from quakespark.operators import regular
from quakespark.operators import traces as tr
from quakespark.plans import forward, linalg, source
from quakespark.plans.advisor import turning_depths
from quakespark.signal_queries import _TR, traces
from quakespark.sources import miniseed, tables, volume, xml

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (fx.WITH + ",\n" + sql.strip()[5:] if sql.strip().startswith("with ") else fx.WITH + "\n" + sql) if views else sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).root


def _local(path: str) -> str:
    """A folder as plain files see it: it is mounted where executors share it."""
    return path.removeprefix("file://")


def _written(df: DataFrame, name: str) -> str:
    path = f"{_folder(df.sparkSession, name)}/{name}.csv"
    tables.write_table(df, path)
    return path


def _iso(c: str) -> Column:
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Delimited tables


@query("select 'NX.' || station as id, round(st_lon, 6) as lon, round(st_lat, 6) as lat, round(elevation_m, 6) as elevation_m, 0.25 as correction_p_s, 0.0 as correction_s_s from st")
def s4_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations from network and code, with one correction given and the other not."""
    st = fx.stations(spark, sf_dir)
    path = _written(st.select(F.lit("NX").alias("Network"), F.col("station").alias("Station"), F.col("st_lon").alias("Longitude"), F.col("st_lat").alias("Latitude"), "elevation_m", F.lit("0.25").alias("correction_p_s")), "stations")
    return tables.read_stations(spark, path).select("id", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "elevation_m", "correction_p_s", "correction_s_s")])


def _events_csv(spark: SparkSession, sf_dir: str) -> str:
    e, k = fx.events(spark, sf_dir), F.col("event")
    time = F.when(k % 2 == 0, _iso("origin_time")).otherwise(F.unix_timestamp(F.col("origin_time").cast("timestamp")).cast("string"))
    mag = F.when(k % 5 == 0, "nan").when(k % 5 == 1, "").otherwise(F.col("magnitude").cast("string"))
    e = e.select(k.cast("string").alias("id"), time.alias("time"), F.col("ev_lon").alias("lon"), F.col("ev_lat").alias("lat"), "depth_km", mag.alias("magnitude"), F.when(k % 3 == 0, "yes").otherwise("0").alias("fixed"))
    return _written(e.where("cast(id as long) % 7 > 0"), "events")


@query("select cast(event as varchar) as id, epoch(origin_time) as t, round(ev_lon, 6) as lon, round(ev_lat, 6) as lat, round(depth_km, 6) as depth_km, case when event % 5 > 1 then round(magnitude, 6) end as magnitude, event % 3 = 0 as fixed from ev where event % 7 > 0")
def s5_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose times are ISO 8601 or seconds, magnitudes blank, nan or given, and flags words or digits."""
    e = tables.read_events(spark, _events_csv(spark, sf_dir))
    return e.select("id", F.unix_timestamp("origin_time").cast("double").alias("t"), *[F.round(c, 6).alias(c) for c in ("lon", "lat", "depth_km", "magnitude")], "fixed")


@query(
    """
with l as (select *, ['P', 'Pg', 'S', 'Sn', 'PmP', 'PcP'][cast(l_partkey % 6 as int) + 1] as label from pk)
select cast(event as varchar) as event, 'NX.' || station as station, case when label[1] = 'P' then 'P' else 'S' end as phase, round(travel_time_s, 6) as travel_time_s,
  round(case when seq % 2 = 1 then sigma_s when label[1] = 'P' then 0.1 else 0.2 end, 6) as sigma_s, case when seq % 3 = 0 then 0 else quality end as quality, origin, disabled
from l where label in ('P', 'Pg', 'S', 'Sn') and event % 7 > 0
"""
)
def s6_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks with labels of many kinds, blank uncertainties and qualities, and events that the event table lacks."""
    p = fx.picks(spark, sf_dir)
    labels = F.array(*[F.lit(x) for x in ("P", "Pg", "S", "Sn", "PmP", "PcP")])
    p = p.select(
        F.col("event"), F.concat(F.lit("NX."), F.col("station")).alias("station"), labels[(F.col("l_partkey") % 6).cast("int")].alias("phase"), "travel_time_s",
        F.when(F.col("seq") % 2 == 1, F.col("sigma_s").cast("string")).otherwise("").alias("sigma_s"), F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("quality").cast("string")).alias("quality"),
        F.when(F.col("origin") == "automatic", "auto").otherwise(F.col("origin")).alias("origin"), "disabled",
    )
    got, _ = tables.read_picks(spark, _written(p, "picks"), tables.read_events(spark, _events_csv(spark, sf_dir)))
    return got.select("event", "station", "phase", F.round("travel_time_s", 6).alias("travel_time_s"), F.round("sigma_s", 6).alias("sigma_s"), "quality", "origin", "disabled")


@query("with f as (select distinct on (fit_id) fit_id, event_id, station_id, tstar from spectrum_fits where fit_id is not null and event_id is not null and station_id is not null) select event_id as event, trim(station_id) as station, 'P' as phase, round(case when isnan(tstar) then null else tstar end, 9) as tstar_s, 0.005 as sigma_s, false as disabled from f", views=False)
def s7_tstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "spectrum_fits").where("event_id is not null and station_id is not null").dropDuplicates(["fit_id"]).select(F.col("event_id").alias("event"), F.col("station_id").alias("station"), F.col("tstar").alias("tstar_s"))
    return tables.read_tstar(spark, _written(t, "tstar")).withColumn("tstar_s", F.round("tstar_s", 9))


@query("select p_partkey // 50 as event, p_partkey as station, case when p_partkey % 3 = 0 then -1.0 else 1.0 end as polarity, cast((p_partkey * 37) % 360 as double) as azimuth, case when p_partkey % 4 = 0 then 0 else 1 end as manual from part where p_partkey % 5 > 0", views=False)
def s20_polarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarities; those of 0 are left out."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.floor(k / 50).alias("event"), k.alias("station"), F.when(k % 5 == 0, 0).when(k % 3 == 0, -1).otherwise(1).alias("polarity"), ((k * 37) % 360).alias("azimuth"), F.lit(45).alias("takeoff"), F.when(k % 4 == 0, 0).otherwise(1).alias("manual"))
    got = tables.read_polarities(spark, _written(p, "polarities"))
    return got.select(F.col("event").cast("long").alias("event"), F.col("station").cast("long").alias("station"), "polarity", "azimuth", "manual")


@query("select cast(p_partkey as varchar) as id, cast(p_partkey % 90 as double) as lat, cast(p_partkey % 180 as double) as lon, cast(p_partkey % 30 as double) as depth_km, 10.0 as strike, 20.0 as dip, 30.0 as rake from part", views=False)
def s22_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select(k.alias("id"), (k % 90).alias("lat"), (k % 180).alias("lon"), (k % 30).alias("depth"), F.lit(10).alias("strike"), F.lit(20).alias("dip"), F.lit(30).alias("rake"))
    return tables.read_receivers(spark, _written(r, "receivers"))


@query("select event_a, event_b, station, phase, count(*) as n, round(sum(lag_s), 6) as lags from (select * replace (case when isnan(cc) then null else cc end as cc) from dt_cc) where event_a is not null and event_b is not null and station is not null and phase is not null and lag_s is not null and not isnan(lag_s) group by all", views=False)
def s19_cc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dt_cc").where("event_a is not null and event_b is not null and station is not null and phase is not null and lag_s is not null and not isnan(lag_s)")
    path = f"{_folder(spark, 'cc')}/dt_cc.csv"
    d.select("event_a", "event_b", "station", "phase", "arrival_difference_s", "lag_s", "cc").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_cc_times(spark, path).groupBy("event_a", "event_b", "station", "phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lag_s"), 6).alias("lags"))


@query("select event, station, phase, seq, strftime(origin_time, '%Y-%m-%dT%H:%M:%S.0000Z') as time from pk join ev using (event) where station % 3 = 0")
def k1_written_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table as text: times to a tenth of a millisecond."""
    p = fx.picks(spark, sf_dir).where("station % 3 = 0").join(fx.events(spark, sf_dir).select("event", F.col("origin_time").cast("timestamp").alias("time")), "event")
    path = _written(p.select("event", "station", "phase", "seq", "time"), "table")
    return spark.read.option("header", True).schema("event long, station long, phase string, seq int, time string").csv(path)


# XML


@query("select cast(event as varchar) as id, epoch(origin_time) as t, round(ev_lon, 6) as lon, round(ev_lat, 6) as lat, round(depth_km, 6) as depth_km, round(magnitude, 6) as magnitude from ev")
def s9_quakeml_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = xml.read_quakeml(spark, _quakeml(spark, sf_dir))[0]
    return e.select("id", F.unix_timestamp("origin_time").cast("double").alias("t"), *[F.round(c, 6).alias(c) for c in ("lon", "lat", "depth_km", "magnitude")])


@query("select cast(event as varchar) as event, 'NX.' || station as station, phase, count(*) as n, round(sum(travel_time_s), 3) as times from pk group by all")
def s9_quakeml_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = xml.read_quakeml(spark, _quakeml(spark, sf_dir))[1]
    o = fx.events(spark, sf_dir).select(F.col("event").cast("string").alias("event"), F.col("origin_time").cast("timestamp").alias("o"))
    p = p.join(o, "event").withColumn("tt", (F.unix_micros("time") - F.unix_micros("o")) / 1e6)
    return p.groupBy("event", "station", "phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tt"), 3).alias("times"))


def _quakeml(spark: SparkSession, sf_dir: str) -> str:
    """Files of some hundred events each, made of the fixture's events and picks."""
    value = lambda name, v: F.concat(F.lit(f"<{name}><value>"), v, F.lit(f"</value></{name}>"))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    e = fx.events(spark, sf_dir).withColumn("o", F.col("origin_time").cast("timestamp"))
    p = fx.picks(spark, sf_dir).join(e.select("event", "o"), "event")
    pick = F.concat(F.lit('<pick publicID="p'), "seq", F.lit('"/>').substr(1, 1), F.lit(">"), value("time", stamp(F.timestamp_micros(F.unix_micros("o") + F.round(F.col("travel_time_s") * 1e6).cast("long")))), F.lit('<waveformID networkCode="NX" stationCode="'), "station", F.lit('"/><phaseHint>'), "phase", F.lit("</phaseHint></pick>"))
    picks = p.groupBy("event").agg(F.concat_ws("", F.collect_list(pick)).alias("picks"))
    d = e.join(picks, "event", "left")
    origin = F.concat(F.lit('<origin publicID="o">'), value("time", stamp("o")), value("longitude", F.col("ev_lon").cast("string")), value("latitude", F.col("ev_lat").cast("string")), value("depth", (F.col("depth_km") * 1000).cast("string")), F.lit("</origin><magnitude>"), value("mag", F.col("magnitude").cast("string")), F.lit("</magnitude>"))
    event = F.concat(F.lit('<event publicID="smi:x/event/'), F.col("event"), F.lit('">'), origin, F.coalesce("picks", F.lit("")), F.lit("</event>"))
    files = d.groupBy((F.col("event") % F.greatest(F.lit(8), F.lit(1))).alias("part"), F.floor(F.col("event") / 4000).alias("block")).agg(F.concat_ws("", F.collect_list(event)).alias("body"))
    head, foot = '<q:quakeml xmlns:q="http://quakeml.org/xmlns/quakeml/1.2"><eventParameters>', "</eventParameters></q:quakeml>"
    path = f"{_folder(spark, 'quakeml')}/q"
    files.select(F.concat(F.lit(head), "body", F.lit(foot)).alias("value"), "part", "block").write.partitionBy("part", "block").text(path)
    return f"{path}/*/*/*.txt"


@query("select 'NX.' || station as id, round(st_lon + 0.5, 6) as lon, round(st_lat, 6) as lat, round(elevation_m, 6) as elevation_m from st")
def s10_stationxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of each station's latest epoch."""
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v.cast("string"), F.lit(f"</{n}>"))
    st = fx.stations(spark, sf_dir)
    place = lambda shift: F.concat(tag("Latitude", F.col("st_lat")), tag("Longitude", F.col("st_lon") + shift), tag("Elevation", F.col("elevation_m")))
    channel = lambda start, shift: F.concat(F.lit(f'<Channel code="HHZ" locationCode="" startDate="{start}-01-01T00:00:00">'), place(shift), F.lit("<SampleRate>100</SampleRate></Channel>"))
    one = F.concat(F.lit('<Station code="'), F.col("station").cast("string"), F.lit('">'), place(0.0), channel(2015, 0.5), channel(2010, 0.0), F.lit("</Station>"))
    files = st.groupBy((F.col("station") % 8).alias("part")).agg(F.concat_ws("", F.collect_list(one)).alias("body"))
    path = f"{_folder(spark, 'stationxml')}/s"
    files.select(F.concat(F.lit('<FDSNStationXML><Network code="NX">'), "body", F.lit("</Network></FDSNStationXML>")).alias("value"), "part").write.partitionBy("part").text(path)
    c = xml.station_coordinates(xml.read_stationxml(spark, f"{path}/*/*.txt"))
    return c.select("id", *[F.round(x, 6).alias(x) for x in ("lon", "lat", "elevation_m")])


# Waveforms and volumes


@query("select 'T' || vec_id as station, cast(i as int) as i, round(cast(cast(embedding[i + 1] as float) as double), 6) as x from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings)", views=False)
def s11_miniseed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces written as miniSEED, read back and joined from their records."""
    e = table(spark, sf_dir, "embeddings").select(F.lit("NX").alias("network"), F.concat(F.lit("T"), "vec_id").alias("station"), F.lit("").alias("location"), F.lit("HHZ").alias("channel"), (F.lit(1.7e9) + F.col("vec_id") * 100).alias("start"), F.lit(100.0).alias("rate"), F.col("embedding").cast("array<float>").alias("samples"))
    path = _folder(spark, "miniseed")
    miniseed.write_miniseed(e, _local(path)).count()
    r = miniseed.read_miniseed(spark, f"{path}/*.mseed")
    return r.select("station", F.posexplode("samples").alias("i", "x")).select("station", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("with " + _TR + "select vec_id, count(*) as n, round(sum(x * (i + 1)), 6) as weighted from t group by vec_id", views=False)
def s12_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces cut into records of 16 samples, one of them sent twice, and joined again."""
    t = traces(spark, sf_dir)
    k = F.explode(F.array(*[F.lit(i) for i in (0, 16, 16, 32, 48)])).alias("k")
    parts = t.select("vec_id", "samples", "rate", k).select("vec_id", (F.col("k") / F.col("rate")).alias("start"), "rate", F.expr("slice(samples, k + 1, 16)").alias("samples"))
    s = tr.stitch(parts, by=["vec_id"])
    return s.select("vec_id", F.posexplode("samples").alias("i", "x")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * (F.col("i") + 1)), 6).alias("weighted"))


@query("with n as (select unnest(range(1872)) as node) select cast(node as int) as node, cast(node % 16 as int) as i, cast(node // 16 % 13 as int) as j, cast(node // 208 as int) as k, round(12.4 + node % 16 * 0.1, 6) as lon, case when node % 11 = 0 then null else round(cast(cast(node * 0.25 as float) as double), 6) end as value from n", views=False)
def s16_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume written and read as a table of nodes; gaps are null."""
    v = np.arange(GRID.nodes) * 0.25
    v[::11] = np.nan
    path = f"{_local(_folder(spark, 'volume'))}/v.qvol"
    volume.write_volume(path, GRID, v, Quantity="Vp")
    return volume.volume_table(spark, path).select(F.col("node").cast("int").alias("node"), *[F.col(c).cast("int").alias(c) for c in "ijk"], F.round("lon", 6).alias("lon"), F.round("value", 6).alias("value"))


@query("with v as (select event, ev_lon, ev_lat, depth_km from ev) select event, round(1 + 2 * ev_lon - ev_lat + 0.5 * depth_km, 4) as value from v")
def s17_sampled_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear field written as a volume, resampled to a finer grid and sampled at the events: interpolation keeps it."""
    x, y, z = GRID.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    path = f"{_local(_folder(spark, 'volume'))}/w.qvol"
    volume.write_volume(path, GRID, (1 + 2 * (xx - 12.4) - (yy - 42.2) + 0.5 * zz).ravel(), Quantity="Vp")
    fine = GRID.refined(2)
    values = volume.on_grid(path, fine)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"event": b["event"], "value": fine.interpolate(values, b["ev_lon"].to_numpy(), b["ev_lat"].to_numpy(), b["depth_km"].to_numpy())})

    got = fx.events(spark, sf_dir).select("event", "ev_lon", "ev_lat", "depth_km").mapInPandas(run, "event long, value double")
    return got.select("event", F.round(F.col("value") + 2 * 12.4 - 42.2, 4).alias("value"))


@query("select cast(p_partkey as int) as a, cast(p_size as int) as e, cast(p_partkey % 100 as int) as s, p_partkey % 2 as p, 3 as points, cast(p_partkey % 50 as double) as last from part", views=False)
def k8_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays written to a file and read back (the format is one machine's file)."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(k.alias("a"), F.col("p_size").alias("e"), (k % 100).alias("s"), (k % 2).alias("p"), (k % 50).alias("last")).toPandas()
    path = f"{_local(_folder(spark, 'rays'))}/r.qray"
    volume.write_rays(path, [(int(r.a), int(r.e), int(r.s), int(r.p), np.array([[0, 0, 0], [1, 1, 1], [2, 2, float(r.last)]], np.float32)) for r in d.itertuples()])
    rows = [(a, e, s, p, len(q), float(q[-1, 2])) for a, e, s, p, q in volume.read_rays(path)]
    return spark.createDataFrame(rows, "a int, e int, s int, p long, points int, last double")


# Kernels


@query(
    "with " + _TR + """,
w as (select vec_id, f.f, k.k, 0.5 - 0.5 * cos(2 * pi() * m.m / 15) as h, m.m, x from (select unnest(range(7)) as f) f, (select unnest(range(9)) as k) k, (select unnest(range(16)) as m) m, t where t.i = f.f * 8 + m.m),
p as (select vec_id, f, k, power(sum(h * x * cos(2 * pi() * k * m / 16)), 2) + power(sum(h * x * sin(2 * pi() * k * m / 16)), 2) as p from w group by all),
d as (select vec_id, f, k, greatest(10 * log10(greatest(p, 1e-300) / max(p) over (partition by vec_id)), -80) as db from p)
select vec_id, cast(f as int) as frame, cast(k as int) as bin, round(db, 4) as db from d
""",
    views=False,
)
def g6_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tr.apply(traces(spark, sf_dir), lambda x, r: sg.spectrogram(x, r, window=16, step=8).ravel())
    return d.select("vec_id", F.posexplode("samples").alias("n", "db")).select("vec_id", F.floor(F.col("n") / 9).cast("int").alias("frame"), (F.col("n") % 9).cast("int").alias("bin"), F.round("db", 4).alias("db"))


@query(
    """
with f as (select distinct on (fit_id) fit_id, freq from spectrum_fits where len(freq) > 0), w as (select fit_id, k, 2 * pi() * freq[k] as w from (select fit_id, freq, unnest(range(1, len(freq) + 1)) as k from f))
select fit_id, cast(k as int) as k, round(w * w / (sqrt(4.4 ** 2 + (w - 4.4) ** 2) * sqrt(4.4 ** 2 + (w + 4.4) ** 2)), 6) as amplitude from w where w is not null and not isnan(w)
""",
    views=False,
)
def g10_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude of a seismometer's response (two poles, two zeros) at the frequencies of all spectra."""
    f = table(spark, sf_dir, "spectrum_fits").where(F.size("freq") > 0).dropDuplicates(["fit_id"]).select("fit_id", F.col("freq").alias("samples"), F.lit(1.0).alias("rate"))
    d = tr.apply(f, lambda x, r: np.abs(sg.response(x, [-4.4 + 4.4j, -4.4 - 4.4j], [0, 0], 1.0)))
    return d.select("fit_id", F.posexplode("samples").alias("k", "a")).where("a is not null and not isnan(a)").select("fit_id", (F.col("k") + 1).alias("k"), F.round("a", 6).alias("amplitude"))


@query(
    "with " + _TR + """,
x as (select vec_id, i, x / case when i >= 40 then 20 else 1 end + case when i = 10 then 100 else 0 end as x from t),
d as (select *, lag(x) over w as a, lead(x) over w as b from x window w as (partition by vec_id order by i)),
m as (select vec_id, greatest(1e-12, list_sort(list(abs(x - a)))[count(x - a) // 2 + 1]) as mad from d where a is not null group by vec_id),
s as (select vec_id, count(*) filter (where sign(x - a) = sign(x - b) and least(abs(x - a), abs(x - b)) > 25 * mad and abs(b - a) < 5 * mad) as spikes from d join m using (vec_id) group by vec_id)
select vec_id, 64 as samples, round(max(abs(x)), 6) as max_abs, round(stddev_pop(x), 6) as rms, false as flat, false as clipped, cast(any_value(spikes) as int) as spikes from x join s using (vec_id) group by vec_id
""",
    views=False,
)
def g16_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality report of traces with one spike."""
    names = ["samples", "max_abs", "rms", "flat", "clipped", "spikes"]

    def kernel(x: np.ndarray, rate: float) -> np.ndarray:
        y = x / np.where(np.arange(len(x)) >= 40, 20.0, 1.0)
        y[10] += 100.0
        r = sg.quality_report([(0.0, rate, y)])
        return np.array([float(r[c]) for c in names])

    d = tr.apply(traces(spark, sf_dir), kernel)
    kind = {"samples": "int", "spikes": "int", "flat": "boolean", "clipped": "boolean"}
    return d.select("vec_id", *[F.col("samples")[i].cast(kind[c]).alias(c) if c in kind else F.round(F.col("samples")[i], 6).alias(c) for i, c in enumerate(names)])


@query("with z as (select event, radians(ev_lat) as p, radians(42.8) as q, radians(ev_lon - 13.2) as l from ev), d as (select event, 2 * 6371 * asin(sqrt(power(sin((p - q) / 2), 2) + cos(p) * cos(q) * power(sin(l / 2), 2))) as d, atan2(sin(l) * cos(p), cos(q) * sin(p) - sin(q) * cos(p) * cos(l)) as a from z) select event, round(d * sin(a), 5) as east_km, round(d * cos(a), 5) as north_km from d")
def f7_local_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = geo.local_offset(F.lit(13.2), F.lit(42.8), F.col("ev_lon"), F.col("ev_lat"))
    return fx.events(spark, sf_dir).select("event", o.alias("o")).select("event", F.round("o.east_km", 5).alias("east_km"), F.round("o.north_km", 5).alias("north_km"))


@query(
    """
with w as (select p_partkey as id, list_sort([cast(p_partkey % 7 as double), cast(p_partkey % 5 as double) - 2, cast(p_partkey % 3 as double) - 4]) as w from part),
i as (select id, w, (w[1] + w[2] + w[3]) / 3 as iso from w),
b as (select *, greatest(abs(w[1] - iso), abs(w[3] - iso)) as big from i)
select id, round(iso / (abs(iso) + big), 6) as iso, round((log10(sqrt((w[1] ** 2 + w[2] ** 2 + w[3] ** 2) / 2)) - 9.1) / 1.5, 6) as mw from b
""",
    views=False,
)
def f13_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotropic share and magnitude of diagonal moment tensors."""
    k, decompose = F.col("p_partkey"), source.decompose  # the function alone: a module would travel with what it holds, sessions of scratch tables too

    def run(batches):
        for b in batches:
            r = [decompose(np.diag([float(i % 7), i % 5 - 2.0, i % 3 - 4.0])) for i in b["id"]]
            yield pd.DataFrame({"id": b["id"], "iso": [x["iso"] for x in r], "mw": [x["mw"] for x in r]})

    d = table(spark, sf_dir, "part").select(k.alias("id")).mapInPandas(run, "id long, iso double, mw double")
    return d.select("id", F.round("iso", 6).alias("iso"), F.round("mw", 6).alias("mw"))


_SMALL = Grid(13.0, 13.3, 42.6, 42.9, 0.0, 9.0, 4, 4, 4)


@query("with n as (select unnest(range(64)) as node), p as (select node, node * 3 + 0 as row, 1 as s from n where node % 4 < 3 union all select node, node * 3 + 1, 4 from n where node // 4 % 4 < 3 union all select node, node * 3 + 2, 16 from n where node // 16 < 3) select cast(row as int) as row, cast(node as int) as node, -1 as side from p union all select row, node + s, 1 from p", views=False)
def n11_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pair of neighbours: which nodes it has, and with which sign."""
    return regular.gradient_rows(spark, _SMALL, 5.0).select(F.col("row").cast("int").alias("row"), F.col("node").cast("int").alias("node"), F.signum("value").cast("int").alias("side"))


_ROWS = "r as (select p_partkey % 40 as c, 1 + p_partkey % 5 as v from part), s as (select c, cast(sum(v * v) as double) as s from r group by c)"


def _system(spark: SparkSession, sf_dir: str) -> linalg.Csr:
    k = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("c"), (1 + F.col("p_partkey") % 5).alias("v")).toPandas()
    return linalg.Csr.build(np.arange(len(k)), k["c"], k["v"], len(k), 40)


@query("with " + _ROWS + " select cast(c as int) as column, round(s / (s + 9), 6) as resolution, round(sqrt(s) / (s + 9), 6) as sigma from s", views=False)
def n10_formal_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal of the resolution matrix and standard errors of a system whose columns do not meet."""
    a = _system(spark, sf_dir)
    r = linalg.formal_resolution(a, linalg.Csr.build(np.arange(40), np.arange(40), np.full(40, 3.0), 40, 40))
    return spark.createDataFrame([(i, round(float(x), 6), round(float(y), 6)) for i, (x, y) in enumerate(zip(r["resolution"], r["sigma"]))], "column int, resolution double, sigma double")


@query("with " + _ROWS + " select cast(c as int) as column, round(s / (s + 9), 5) as resolution from s", views=False)
def n9_stochastic_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same diagonal from random signs and damped least squares: exact where columns do not meet."""
    a = _system(spark, sf_dir)
    r = linalg.resolution_diagonal(lambda b: linalg.lsqr(a, b, 3.0, atol=1e-12, btol=1e-12)[0], a.dot, 40, probes=3)
    return spark.createDataFrame([(i, round(float(x), 5)) for i, x in enumerate(r)], "column int, resolution double")


# Geography and models


@query(
    """
with q as (select distinct rid, lat, lon from quakes where isfinite(lon) and isfinite(lat)),
n as (select rid, lat, case when n = -180 then 180 else n end as n from (select rid, lat, ((lon + 180) - 360 * floor((lon + 180) / 360)) - 180 as n from q))
select rid, regexp_replace(printf('%.2f', abs(n)), '\\.?0+$', '') || case when n < 0 then '°W' else '°E' end as lon_text, regexp_replace(printf('%.2f', abs(lat)), '\\.?0+$', '') || case when lat < 0 then '°S' else '°N' end as lat_text from n
""",
    views=False,
)
def f4_position_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "quakes").where("lon is not null and not isnan(lon) and lat is not null and not isnan(lat)").select("rid", "lat", "lon").distinct()
    return q.select("rid", geo.format_longitude("lon", 2).alias("lon_text"), geo.format_latitude("lat", 2).alias("lat_text"))


@query(
    """
with p as (select p_partkey as id, cast(p_partkey * 7 % 720 - 360 as double) as a, cast(p_partkey * 7 % 720 - 360 + p_partkey % 400 - 20 as double) as z0 from part),
z as (select id, a, case when z0 < a then z0 + 360 * ceil((a - z0) / 360) else z0 end as z from p),
w as (select id, z - a as span, ((a + 180) - 360 * floor((a + 180) / 360)) - 180 as west from z)
select id, round(case when span >= 360 then -180 else west end, 6) as low, round(case when span >= 360 then 180 else least(180, west + span) end, 6) as high from w
union all select id, -180.0, round(west + span - 360, 6) from w where span < 360 and west + span > 180
""",
    views=False,
)
def f4_longitude_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), (k * 7 % 720 - 360).cast("double").alias("a"), (k * 7 % 720 - 360 + k % 400 - 20).cast("double").alias("z"))
    return p.select("id", F.explode(geo.longitude_ranges("a", "z")).alias("r")).select("id", F.round("r.low", 6).alias("low"), F.round("r.high", 6).alias("high"))


@query("select p_partkey as id, round(least(200, ceil((sqrt(power((p_partkey % 500 + 0.5) * 0.02 / 2, 2) + 25) - 5) / 0.02 * 10 - 1e-6) / 10), 4) as depth_km from part", views=False)
def f9_turning_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turning depths in a model whose velocity rises evenly."""
    m = Model1D("even", [(0.0, 5.0, 3.0), (400.0, 13.0, 7.0)])
    z = turning_depths(m, np.arange(500) + 0.5)
    at = F.array(*[F.lit(round(float(x), 4)) for x in z])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), at[(F.col("p_partkey") % 500).cast("int")].alias("depth_km"))


@query("select l_orderkey as arrival, len(list(l_linenumber)) as n, least(3, len(list(l_linenumber))) as kept, min(l_linenumber) as first, max(l_linenumber) as last from lineitem group by l_orderkey order by l_orderkey limit 5000", views=False)
def t6_stored_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5,000 rays with at most three of their points: the limit is the operator."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("arrival")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("points"))
    s = forward.stored_rays(r.withColumn("n", F.size("points").cast("long")), most=5000, most_points=3)
    return s.select("arrival", "n", F.size("points").cast("long").alias("kept"), F.element_at("points", 1).alias("first"), F.element_at("points", -1).alias("last"))


@query(
    """
with b as (select min(ev_lon) - 0.7 as w, max(ev_lon) + 0.7 as e, min(ev_lat) as s, max(ev_lat) as n, max(depth_km) as d from ev),
k as (select greatest(0, ceil((12.4 - (least(12.4, w) - 0.1)) / 0.05 - 1e-9)) as west, greatest(0, ceil(((greatest(13.9, e) + 0.1) - 13.9) / 0.05 - 1e-9)) as east from b)
select cast(31 + west + east as int) as nx, 25 + 2 * 2 as ny, 17 as nz, true as holds from k
"""
)
def n5_covering_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward grid of twice the nodes that also holds points east and west of the model's."""
    e = fx.events(spark, sf_dir).select(F.explode(F.array(F.col("ev_lon") - 0.7, F.col("ev_lon") + 0.7)).alias("lon"), F.col("ev_lat").alias("lat"), "depth_km")
    g, _ = forward.covering_grid(GRID, 2, e)
    holds = e.agg(F.bool_and(g.contains(F.col("lon"), F.col("lat"), F.col("depth_km"))).alias("h")).first()["h"]
    return spark.createDataFrame([(g.nx, g.ny, g.nz, bool(holds))], "nx int, ny int, nz int, holds boolean")


@query("select station, phase, true as same from st, (select unnest(['P', 'S']) as phase)")
def n3_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of all stations in a medium that gets faster with depth and from west to east: whether sweeps and common updates agree."""
    x, y, z = GRID.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    v = 5.0 + 0.08 * zz + 0.3 * (xx - 12.4) + 0.2 * np.sin(yy * 20)

    def compare(batches):
        last, agree = None, False
        for b in batches:
            same = []
            for r in b.itertuples():
                if (place := (r.phase, r.st_lon, r.st_lat, r.elevation_m)) != last:  # stations at one place have the same tables
                    s = 1 / (v if r.phase == "P" else v / 1.73)
                    a, c = (forward.eikonal(GRID, s, (r.st_lon, r.st_lat, -r.elevation_m / 1000), sweep=k) for k in (True, False))
                    last, agree = place, bool(np.abs(a - c).max() < 1e-4)
                same.append(agree)
            yield pd.DataFrame({"station": b["station"], "phase": b["phase"], "same": same})

    st = fx.stations(spark, sf_dir).withColumn("phase", F.explode(F.array(F.lit("P"), F.lit("S"))))
    place = ["phase", "st_lon", "st_lat", "elevation_m"]
    return spread(st.select("station", *place), *place).sortWithinPartitions(*place).mapInPandas(compare, "station long, phase string, same boolean")
