"""Queries of the field operators over generated nodes and the fixture, and SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark import fixtures as fx
from quakespark.catalog_queries import GRID
from quakespark.common import table
from quakespark.engine_queries import _laplacian_sql, usable_arrivals
from quakespark.functions import geo
from quakespark.operators import catalog as cat
from quakespark.operators import fields, regular
from quakespark.operators import stats
from quakespark.plans import mesh
from quakespark.source_queries import _VEC, mechanisms

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (fx.WITH + ",\n" + sql.strip()[5:] if sql.strip().startswith("with ") else fx.WITH + "\n" + sql) if views else sql
        return f

    return add


_NODES = "nd as (select node, node % 16 as i, node // 16 % 13 as j, node // 208 as k from (select unnest(range(1872)) as node)), fi as (select *, cast(node % 50 as double) as hits, cast(node % 17 as double) / 17 as value, cast(node % 13 as double) / 13 as truth from nd)"


def _fields(spark: SparkSession) -> DataFrame:
    n = F.col("node")
    return GRID.node_table(spark).withColumns({"hits": (n % 50).cast("double"), "value": (n % 17).cast("double") / 17, "truth": (n % 13).cast("double") / 13})


@query("with " + _NODES + "select ((k // 2) * 7 + j // 2) * 8 + i // 2 as block, round(avg(value), 6) as mean, round(sum(value), 6) as total, count(*) as nodes from fi group by all")
def a12_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.to_blocks(_fields(spark), GRID).withColumns({"mean": F.round("mean", 6), "total": F.round("total", 6)})


@query(
    "with " + _NODES + """,
m as (select list_sort(list(hits))[count(*) // 2 + 1] as mid from fi where hits > 0)
select round(corr(value, truth), 6) as correlation, round(corr(value, truth) filter (where hits >= mid), 6) as correlation_well, round(sqrt(avg((value - truth) ** 2)), 6) as rms, count(*) as nodes from fi, m where hits > 0
"""
)
def a16_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations and RMS of a recovered and a true field over sampled nodes."""
    return fields.recovery(_fields(spark)).withColumns({c: F.round(c, 6) for c in ("correlation", "correlation_well", "rms")})


_LAP = _laplacian_sql().replace("select cast(row as int) as row, cast(node as int) as node, round(sum(value), 6) as value from b group by all", "").rstrip() + ", la as (select row, node, sum(value) as value from b group by all) "


@query(_LAP + "select cast(node as int) as node, round(sum(abs(value)), 6) as total from la group by all")
def a18_column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.column_sums(regular.laplacian_rows(spark, GRID, 20.0)).withColumn("total", F.round("total", 6))


@query(_LAP + "select round(sqrt(sum(y * y)), 6) as norm from (select row, sum(value * cast(node % 7 as double) / 7) as y from la group by row)")
def a19_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = GRID.node_table(spark).select("node", ((F.col("node") % 7).cast("double") / 7).alias("x"))
    return regular.row_norms(regular.laplacian_rows(spark, GRID, 20.0), m).withColumn("norm", F.round("norm", 6))


@query(_LAP + "select cast(row as int) as row, round(sum(value * cast(node % 11 as double)), 6) as y from la group by row")
def n36_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = GRID.node_table(spark).select("node", (F.col("node") % 11).cast("double").alias("x"))
    return fields.product(regular.laplacian_rows(spark, GRID, 20.0), m).withColumn("y", F.round("y", 6))


@query(_LAP + "select cast(row as int) as row, cast(((node // 208 // 2) * 7 + node // 16 % 13 // 2) * 8 + node % 16 // 2 as bigint) as column, round(sum(value), 6) as value from la group by all")
def j17_projected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing rows on blocks instead of nodes."""
    to = GRID.node_table(spark).select("node", fields.block_of(GRID).alias("column"), F.lit(1.0).alias("w"))
    return mesh.project(regular.laplacian_rows(spark, GRID, 20.0), to).withColumn("value", F.round("value", 6))


@query("with " + _NODES + "select count(*) filter (where value <= 0.1 or value >= 0.9) as on_bounds, round(100 * avg(case when value <= 0.1 or value >= 0.9 then 1.0 else 0.0 end), 6) as percent from fi where hits > 0")
def a27_on_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.on_bounds(_fields(spark), 0.1, 0.9).withColumn("percent", F.round("percent", 6))


@query("with " + _NODES + "select cast(node as int) as node, round(0.05 * sin(pi() * 2 * 6371 * asin(cos(radians(42.2 + j * 0.1)) * sin(radians(i * 0.1) / 2)) / 20) * sin(pi() * radians(j * 0.1) * 6371 / 20) * sin(pi() * (k * 3 + 5) / 10), 6) as dv from nd")
def f18_checkerboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID.node_table(spark).select("node", F.round(fields.checkerboard(GRID, 20.0, 10.0, 5.0), 6).alias("dv"))


@query(
    "with " + _NODES + """,
o as (select node, radians(12.4 + i * 0.1 - 13.1) * 6371 * cos(radians(42.8)) as e, radians(42.2 + j * 0.1 - 42.8) * 6371 as n, -2 + k * 3 - 8.0 as d from nd),
s as (select node, e * cos(radians(40)) - n * sin(radians(40)) as a, e * sin(radians(40)) + n * cos(radians(40)) as l, d from o)
select cast(node as int) as node, round(-0.08 * exp(-ln(2) * (power(abs(l) / 30, 6) + power(abs(a * cos(radians(60)) + d * sin(radians(60))) / 12, 6) + power(abs(d * cos(radians(60)) - a * sin(radians(60))) / 5, 6))), 6) as dv from s
"""
)
def f18_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dipping plate."""
    return GRID.node_table(spark).select("node", F.round(fields.tabular_body(13.1, 42.8, 8.0, 40.0, 60.0, 60.0, 24.0, 10.0, -8.0), 6).alias("dv"))


@query(
    """
with s as (select event, station, phase, seq, path_km, (6371 - depth_km) * cos(radians(ev_lat)) * cos(radians(ev_lon)) as ax, (6371 - depth_km) * cos(radians(ev_lat)) * sin(radians(ev_lon)) as ay, (6371 - depth_km) * sin(radians(ev_lat)) as az,
    (6371 + elevation_m / 1000) * cos(radians(st_lat)) * cos(radians(st_lon)) as bx, (6371 + elevation_m / 1000) * cos(radians(st_lat)) * sin(radians(st_lon)) as by_, (6371 + elevation_m / 1000) * sin(radians(st_lat)) as bz from phys),
p as (select event, seq, ax + i / 20.0 * (bx - ax) as x, ay + i / 20.0 * (by_ - ay) as y, az + i / 20.0 * (bz - az) as z from s, (select unnest(range(1, 20)) as i)),
g as (select event, seq, degrees(atan2(y, x)) as lon, degrees(asin(z / sqrt(x * x + y * y + z * z))) as lat, 6371 - sqrt(x * x + y * y + z * z) as depth from p)
select event, seq, bool_or(lon between 13.0 and 13.2 and lat between 42.6 and 42.8 and depth <= 10) as crosses from g group by all
""",
    views=True,
)
def pr4_chord_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each ray comes through a small box."""
    from quakespark.functions.grid import Grid

    a = fx.arrivals(spark, sf_dir)
    p, q = geo.to_cartesian("ev_lon", "ev_lat", "depth_km"), geo.to_cartesian("st_lon", "st_lat", -F.col("elevation_m") / 1000)
    box = Grid(13.0, 13.2, 42.6, 42.8, 0.0, 10.0, 2, 2, 2)
    a = a.select("event", "seq", p.alias("p"), q.alias("q"))
    return a.groupBy("event", "seq").agg(F.bool_or(fields.chord_crosses(box, F.col("p"), F.col("q"), samples=20)).alias("crosses"))


@query(
    """
with s as (select event, seq, ev_lon, ev_lat, depth_km, st_lon, st_lat, greatest(0.0, -elevation_m / 1000) as st_depth from phys),
c as (select *, (6371 - depth_km) * cos(radians(ev_lat)) * cos(radians(ev_lon)) as ax, (6371 - depth_km) * cos(radians(ev_lat)) * sin(radians(ev_lon)) as ay, (6371 - depth_km) * sin(radians(ev_lat)) as az,
    (6371 - st_depth) * cos(radians(st_lat)) * cos(radians(st_lon)) as bx, (6371 - st_depth) * cos(radians(st_lat)) * sin(radians(st_lon)) as by_, (6371 - st_depth) * sin(radians(st_lat)) as bz from s),
n as (select *, cast(greatest(2, ceil(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2) / 5)) as bigint) as n from c),
p as (select event, seq, ax + i / cast(n as double) * (bx - ax) as x, ay + i / cast(n as double) * (by_ - ay) as y, az + i / cast(n as double) * (bz - az) as z from (select *, unnest(range(1, n)) as i from n)),
g as (
  select event, seq, degrees(atan2(y, x)) as lon, degrees(asin(z / sqrt(x * x + y * y + z * z))) as lat, greatest(0.0, 6371 - sqrt(x * x + y * y + z * z)) as depth from p
  union all select event, seq, ev_lon, ev_lat, depth_km from s
  union all select event, seq, st_lon, st_lat, st_depth from s)
select event, seq, bool_or(lon between 13.0 - 2e-10 and 13.2 + 2e-10 and lat between 42.6 - 2e-10 and 42.8 + 2e-10 and depth between -1e-8 and 10 + 1e-8) as crosses from g group by all
""",
    views=True,
)
def pr4_path_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each ray comes through a small box, sampled every half node spacing and at its ends; stations above the top sit on it."""
    from quakespark.functions.grid import Grid

    a = fx.arrivals(spark, sf_dir)
    p, q = geo.to_cartesian("ev_lon", "ev_lat", "depth_km"), geo.to_cartesian("st_lon", "st_lat", F.greatest(F.lit(0.0), -F.col("elevation_m") / 1000))
    box = Grid(13.0, 13.2, 42.6, 42.8, 0.0, 10.0, 2, 2, 2)
    a = a.select("event", "seq", p.alias("p"), q.alias("q"))
    return a.groupBy("event", "seq").agg(F.bool_or(fields.chord_crosses(box, F.col("p"), F.col("q"))).alias("crosses"))


@query("select rid, round(case when depth_km is null or isnan(depth_km) then 10 + abs(coalesce(magnitude, 0)) else depth_km end, 6) as depth from (select distinct rid, depth_km, case when isnan(magnitude) then null else magnitude end as magnitude from quakes)")
def pr11_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "quakes").select("rid", "depth_km", "magnitude").distinct()
    return q.select("rid", F.round(fields.filled("depth_km", 10 + F.abs(fields.filled("magnitude", F.lit(0.0)))), 6).alias("depth"))


@query(
    """
with nd as (select cast(i as int) as node, 12.8 + i % 5 * 0.2 as lon, 42.4 + i // 5 % 4 * 0.25 as lat, 3.0 + i // 20 * 5.0 as dep from (select unnest(range(60)) as i)),
xy as (select node, (6371 - dep) * cos(radians(lat)) * cos(radians(lon)) as x, (6371 - dep) * cos(radians(lat)) * sin(radians(lon)) as y, (6371 - dep) * sin(radians(lat)) as z from nd),
a as (select event, seq, phase, 1 / greatest(0.01, sigma_s) as w, predicted_s + noise_s as t, (6371 + elevation_m / 1000) * cos(radians(st_lat)) * cos(radians(st_lon)) as bx, (6371 + elevation_m / 1000) * cos(radians(st_lat)) * sin(radians(st_lon)) as by_, (6371 + elevation_m / 1000) * sin(radians(st_lat)) as bz
  from ar where disabled = 0 and quality < 4 and sigma_s > 0),
r as (select event, node, seq, w, t - sqrt((bx - x) ** 2 + (by_ - y) ** 2 + (bz - z) ** 2) / case phase when 'P' then 6.0 else 3.46 end as r from a, xy),
o as (select *, sum(w) over (partition by event, node order by r, seq rows unbounded preceding) as upto, sum(w) over (partition by event, node) as whole from r),
m as (select event, node, min(r) as t0 from o where upto >= whole / 2 group by all),
s as (select event, node, sum(w * abs(r - t0)) as misfit from r join m using (event, node) group by all)
select event, min_by(node, (round(misfit, 6), node)) as node, round(min(misfit), 4) as misfit from s group by event
""",
    views=True,
)
def j13_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best node of a coarse search grid for each event."""
    i = np.arange(60)
    x, y, z = 12.8 + i % 5 * 0.2, 42.4 + i // 5 % 4 * 0.25, 3.0 + i // 20 * 5.0
    nodes = pd.DataFrame({"node": i, "lon": x, "lat": y, "depth": z})

    def cartesian(lon, lat, depth):
        r, a, o = 6371.0 - depth, np.radians(lat), np.radians(lon)
        return np.stack([r * np.cos(a) * np.cos(o), r * np.cos(a) * np.sin(o), r * np.sin(a)], -1)

    def times(g: pd.DataFrame, part: pd.DataFrame) -> np.ndarray:
        p, q = (cartesian(*(d[c].to_numpy(float) for c in ("lon", "lat", "depth"))) for d in (g, part))
        return np.linalg.norm(p[:, None] - q, axis=-1) / np.where(g["phase"] == "P", 6.0, 3.46)[:, None]

    a = usable_arrivals(spark, sf_dir).select("event", "phase", "time_s", cat.weight().alias("weight"), F.col("st_lon").alias("lon"), F.col("st_lat").alias("lat"), (-F.col("elevation_m") / 1000).alias("depth"))
    return fields.search(a, nodes, times).withColumn("misfit", F.round("misfit", 4))


@query("select event, station, 'catalog' as source, travel_time_s as dt from pk where origin = 'catalog' union all select event, station, 'manual', travel_time_s from pk where origin = 'manual'", views=True)
def u2_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.picks(spark, sf_dir)
    one = lambda o: p.where(F.col("origin") == o).select("event", "station", F.lit(o).alias("source"), F.col("travel_time_s").alias("dt"))
    return one("catalog").unionByName(one("manual"))


@query("select event, station from pk where phase = 'P' intersect select event, station from pk where phase = 'S'", views=True)
def u4_common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that have both phases."""
    p = fx.picks(spark, sf_dir)
    return p.where("phase = 'P'").select("event", "station").intersect(p.where("phase = 'S'").select("event", "station"))


@query("select count(distinct a.auto_id) as unknown from auto_picks a where station is not null and not exists (select 1 from stations s where upper(s.id) = upper(a.station) and s.deleted_at is null)")
def u6_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic picks whose station is not in the table of living stations."""
    a = table(spark, sf_dir, "auto_picks").where("station is not null").select("auto_id", F.upper("station").alias("st"))
    s = table(spark, sf_dir, "stations").where("deleted_at is null").select(F.upper("id").alias("st")).distinct()
    return a.join(s, "st", "left_anti").agg(F.count_distinct("auto_id").alias("unknown"))


@query("select count(distinct event_id) as events, count(distinct upper(station_id)) as stations from spectrum_fits where tstar is not null and not isnan(tstar)")
def a25_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "spectrum_fits").where("tstar is not null and not isnan(tstar)")
    return t.agg(F.count_distinct("event_id").alias("events"), F.count_distinct(F.upper("station_id")).alias("stations"))


@query(
    """
with t as (select vec_id, i, abs(cast(embedding[i + 1] as double)) as x from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings)),
r as (select *, lag(x) over (partition by vec_id order by i) as before, max(x) over (partition by vec_id order by i rows between current row and 8 following) as peak from t),
c as (select *, max(peak) over (partition by vec_id) as top from r where x >= 0.15 and before < 0.15)
select vec_id, cast(min_by(i, (abs(i - 30), i)) as int) as i from c where peak >= top / 2 group by vec_id
"""
)
def w9_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger of each trace nearest to sample 30."""
    from quakespark.operators.traces import samples_table

    r = samples_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("x", F.abs("x"))
    return fields.crossings(r, "vec_id", threshold=0.15, ahead=8, expected=30)


@query("with " + _VEC + """,
g as (select id, nn * nn + ne * ne * 0.2 - nd * nd as sigma, nn * nn + ne * ne * 0.04 + nd * nd as s2 from ve)
select id, round(greatest(0, least(1, (sqrt(greatest(0, s2 - sigma * sigma)) - 0.6 * (sigma - 1)) / (0.6 + sqrt(1.36)))), 6) as instability from g""")
def f21_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instability of each mechanism's plane where the largest stress points north and the least down."""
    return mechanisms(spark, sf_dir).select("id", F.round(fields.instability(F.col("n"), 0.4, 0.6), 6).alias("instability"))


@query("select distinct rid, regexp_replace(id, '[^A-Za-z0-9._-]', '_', 'g') as clean, strftime(origin_time, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(microsecond(origin_time) % 1000000 // 100 as varchar), 4, '0') || 'Z' as iso from quakes where origin_time is not null and id is not null")
def f19_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "quakes").where("origin_time is not null and id is not null").select("rid", "id", "origin_time").distinct()
    return q.select("rid", fields.clean_id(F.concat(F.lit("smi:x/event/"), F.col("id"))).alias("clean"), fields.iso_time(F.col("origin_time")).alias("iso")).distinct()


@query("with c as (select event, median(noise_s) as c from ar group by event) select event, seq, round(noise_s - c, 6) as centred from ar join c using (event)", views=True)
def a3_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals without each event's median."""
    a = fx.arrivals(spark, sf_dir)
    m = stats.median(a, ["event"], "noise_s").select("event", "median")
    return a.join(m, "event").select("event", "seq", F.round(F.col("noise_s") - F.col("median"), 6).alias("centred"))


@query("select event, round(2 * 6371 * asin(least(1.0, sqrt(power(sin(radians(ev_lat - 42.8) / 2), 2) + cos(radians(42.8)) * cos(radians(ev_lat)) * power(sin(radians(ev_lon - 13.2) / 2), 2)))), 6) as km, event % 97 = 0 as inside from ev where 2 * 6371 * asin(least(1.0, sqrt(power(sin(radians(ev_lat - 42.8) / 2), 2) + cos(radians(42.8)) * cos(radians(ev_lat)) * power(sin(radians(ev_lon - 13.2) / 2), 2)))) <= 25", views=True)
def s21_radius_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within a radius of a centre."""
    d = geo.distance_km(13.2, 42.8, "ev_lon", "ev_lat")
    return fx.events(spark, sf_dir).where(d <= 25).select("event", F.round(d, 6).alias("km"), (F.col("event") % 97 == 0).alias("inside"))
