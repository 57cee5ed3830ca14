"""Queries of the composite engines over the fixture's physically consistent arrivals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark import fixtures as fx
from quakespark.catalog_queries import _PAIRS, GRID, PAIR_KM
from quakespark.common import Scratch, spread, table
from quakespark.operators import catalog as cat
from quakespark.operators import regular
from quakespark.plans import attenuation, forward, linalg, locate, tomography
from quakespark.plans.advisor import wadati
from quakespark.source_queries import _SPEC, spectra

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (fx.WITH + ",\n" + sql.strip()[5:] if sql.strip().startswith("with ") else fx.WITH + "\n" + sql) if views else sql
        return f

    return add


def usable_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.arrivals(spark, sf_dir).where(cat.usable())
    return a.withColumn("time_s", F.col("predicted_s") + F.col("noise_s"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best usable picks, brought together by event once, for all steps that follow."""
    return cat.best_picks(usable_arrivals(spark, sf_dir).withColumn("origin", F.lit("manual")).repartition("event"), time="time_s")


@query(
    """
with u as (
  select row_number() over () as ray, phase, path_km, (6371 - depth_km) * cos(radians(ev_lat)) * cos(radians(ev_lon)) as ax, (6371 - depth_km) * cos(radians(ev_lat)) * sin(radians(ev_lon)) as ay, (6371 - depth_km) * sin(radians(ev_lat)) as az,
    (6371 + elevation_m / 1000) * cos(radians(st_lat)) * cos(radians(st_lon)) as bx, (6371 + elevation_m / 1000) * cos(radians(st_lat)) * sin(radians(st_lon)) as by_, (6371 + elevation_m / 1000) * sin(radians(st_lat)) as bz
  from ar where disabled = 0 and quality < 4 and sigma_s > 0),
s as (select *, greatest(1, ceil(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2))) as n from u),
m as (select ray, phase, path_km / n as km, (i + 0.5) / n as f, ax, ay, az, bx, by_, bz from (select *, unnest(range(cast(n as bigint))) as i from s)),
p as (select ray, phase, km, ax + f * (bx - ax) as x, ay + f * (by_ - ay) as y, az + f * (bz - az) as z from m),
g as (select ray, phase, km, degrees(atan2(y, x)) as lon, degrees(asin(z / sqrt(x * x + y * y + z * z))) as lat, 6371 - sqrt(x * x + y * y + z * z) as depth from p),
c as (select ray, phase, km, least(greatest((lon - 12.4) / 0.1, 0), 15) as cx, least(greatest((lat - 42.2) / 0.1, 0), 12) as cy, least(greatest((depth + 2) / 3.0, 0), 8) as cz from g),
t as (select *, cast(least(floor(cx), 14) as int) as i, cast(least(floor(cy), 11) as int) as j, cast(least(floor(cz), 7) as int) as k from c),
w as (
  select ray, phase, ((k + dk) * 13 + j + dj) * 16 + i + di as node,
    km * (case di when 1 then cx - i else 1 - (cx - i) end) * (case dj when 1 then cy - j else 1 - (cy - j) end) * (case dk when 1 then cz - k else 1 - (cz - k) end) as l
  from t, (select unnest([0, 1]) as di), (select unnest([0, 1]) as dj), (select unnest([0, 1]) as dk)),
r as (select ray, phase, node, sum(l) as l from w group by all having sum(l) >= 1e-4)
select phase, cast(node as int) as node, round(sum(l), 4) as dws, count(*) as hits from r group by phase, node
"""
)
def n6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed length and number of straight rays at each node of a grid, by phase."""
    return forward.coverage(usable_arrivals(spark, sf_dir), GRID).withColumn("dws", F.round("dws", 4))


_AXES = {"i": (16, 1), "j": (13, 16), "k": (9, 208)}


def _laplacian_sql() -> str:
    hx, hy, hz = GRID.spacing_km
    h = (hx * hy) ** 0.5
    w = {"i": (h / hx) ** 2, "j": (h / hy) ** 2, "k": 0.1 * (h / hz) ** 2}
    parts = [f"select node as row, node + {s * stride} as t, cast({20.0 * w[a]!r} as double) as w from n where {a} {'> 0' if s < 0 else f'< {size - 1}'}" for a, (size, stride) in _AXES.items() for s in (-1, 1)]
    return f"""with n as (select node, node % 16 as i, node // 16 % 13 as j, node // 208 as k from (select unnest(range(1872)) as node)), e as ({' union all '.join(parts)}),
    b as (select row, row as node, w as value from e union all select row, t, -w from e)
    select cast(row as int) as row, cast(node as int) as node, round(sum(value), 6) as value from b group by all"""


@query(_laplacian_sql(), views=False)
def n11_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular.laplacian_rows(spark, GRID, 20.0).withColumn("value", F.round("value", 6))


@query("with n as (select unnest(range(1872)) as node) select node // 208 as k, count(*) as nodes, round(avg(node % 16), 6) as mean_i from n group by all", views=False)
def a13_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID.node_table(spark).groupBy(F.col("k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("i"), 6).alias("mean_i"))


@query(
    "with " + _PAIRS + """,
u as (select event, station, phase, noise_s, sigma_s from ar where disabled = 0 and quality < 4 and sigma_s > 0 qualify row_number() over (partition by event, station, phase order by sigma_s, travel_time_s, seq) = 1),
d as (select pr.a, pr.b, km, x.station, x.phase, x.noise_s - y.noise_s as dd, x.sigma_s as sa, y.sigma_s as sb from pr join u x on x.event = a join u y on y.event = b and x.station = y.station and x.phase = y.phase where km <= 2.0),
w as (select *, case phase when 'P' then 1.0 else 0.5 end * case when km < 2.0 then power(1 - power(km / 2.0, 3), 3) else 0 end * case when abs(dd) < 0.5 then power(1 - power(abs(dd) / 0.5, 3), 3) else 0 end as prior from d)
select a, b, station, phase, round(dd, 6) as dd, round(prior / sqrt(sa * sa + sb * sb), 6) as weight from w where prior >= 0.001
"""
)
def n16_double_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = cat.best_picks(usable_arrivals(spark, sf_dir).withColumn("origin", F.lit("manual")))
    d = locate.near_differences(u, fx.events(spark, sf_dir), residual="noise_s", max_separation_km=PAIR_KM, cutoff_s=0.5)
    return d.withColumns({"dd": F.round("dd", 6), "weight": F.round("weight", 6)})


@query(
    """
with a as (select event, station, min_by(t, (sigma_s, t, seq)) filter (where phase = 'P') as p, min_by(t, (sigma_s, t, seq)) filter (where phase = 'S') as s
  from (select *, predicted_s + noise_s as t from ar where disabled = 0 and quality < 4 and sigma_s > 0) group by event, station),
b as (select *, count(*) over (partition by event) as n from a where p is not null and s is not null),
d as (select p - avg(p) over (partition by event) as x, s - avg(s) over (partition by event) as y from b where n >= 2),
p1 as (select sum(x * y) / sum(x * x) as k from d),
m1 as (select any_value(k) as k, 3 * 1.4826 * list_sort(list(abs(y - k * x)))[count(*) // 2 + 1] as cut from d, p1),
p2 as (select sum(x * y) / sum(x * x) as k, count(*) as n from d, m1 where abs(y - m1.k * x) <= cut),
m2 as (select any_value(k) as k, 3 * 1.4826 * list_sort(list(abs(y - k * x)))[count(*) // 2 + 1] as cut from d, p2),
p3 as (select sum(x * y) / sum(x * x) as k, count(*) as n from d, m2 where abs(y - m2.k * x) <= cut),
m3 as (select any_value(k) as k, 3 * 1.4826 * list_sort(list(abs(y - k * x)))[count(*) // 2 + 1] as cut from d, p3),
p4 as (select sum(x * y) / sum(x * x) as k, count(*) as n from d, m3 where abs(y - m3.k * x) <= cut),
m4 as (select any_value(k) as k, 3 * 1.4826 * list_sort(list(abs(y - k * x)))[count(*) // 2 + 1] as cut from d, p4),
p5 as (select sum(x * y) / sum(x * x) as k, count(*) as n from d, m4 where abs(y - m4.k * x) <= cut)
select round(case when p2.n = (select count(*) from d) then p1.k when p3.n = p2.n then p3.k when p4.n = p3.n then p4.k else p5.k end, 5) as vp_vs from p1, p2, p3, p4, p5
"""
)
def n30_wadati(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wadati slope of events with two stations or more that have P and S, trimmed in up to five passes."""
    w = wadati(cat.p_and_s(usable_arrivals(spark, sf_dir), time="time_s"), min_stations=2)
    return spark.createDataFrame([(round(w["vp_vs"], 5),)], "vp_vs double")


@query(
    "with " + _SPEC + """,
m as (select distinct on (fit_id) fit_id, event_id from spectrum_fits),
y as (select event_id as event, fit_id, f, ln(s) as y, fc from sp join m using (fit_id), (select unnest([0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]) as fc) where s > 0 and not isnan(s)),
r as (select event, fit_id, fc, count(*) as n, regr_slope(y + ln(1 + (f / fc) ** 2), f) as b, regr_syy(y + ln(1 + (f / fc) ** 2), f) as syy, regr_sxy(y + ln(1 + (f / fc) ** 2), f) as sxy, regr_sxx(y + ln(1 + (f / fc) ** 2), f) as sxx from y group by all having count(*) >= 3),
q as (select *, syy - sxy * sxy / sxx as rss from r where sxx > 0), t as (select event, fc, round(sum(rss), 9) as total from q group by all),
b as (select event, min_by(fc, (total, fc)) as fc from t group by event)
select q.event, q.fit_id as fit, cast(q.fc as double) as corner_hz, round(-q.b / pi(), 6) as tstar, round(rss, 6) as rss, n from q join b on q.event is not distinct from b.event and q.fc = b.fc where q.event is not null
""",
    views=False,
)
def n19_tstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t* of every spectrum with the corner frequency that its event's spectra share."""
    e = table(spark, sf_dir, "spectrum_fits").select("fit_id", "event_id").dropDuplicates(["fit_id"]).where("event_id is not null")
    s = spectra(spark, sf_dir).join(e, "fit_id").select(F.col("event_id").alias("event"), F.col("fit_id").alias("fit"), "f", "s")
    t = attenuation.fit_tstar(s, [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0])
    return t.select("event", "fit", "corner_hz", F.round("tstar", 6).alias("tstar"), F.round("rss", 6).alias("rss"), "n")


def _uniform() -> dict[str, np.ndarray]:
    return {"P": np.full(GRID.nodes, 1 / 6.0), "S": np.full(GRID.nodes, 1 / 3.46)}


@query("select station, phase, true as exact from st, (select unnest(['P', 'S']) as phase)")
def n4_travel_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eikonal tables of all stations in a uniform medium: whether all times are within a ten-thousandth of straight rays'."""
    t = locate.travel_time_tables(fx.stations(spark, sf_dir), GRID, _uniform())
    st = fx.stations(spark, sf_dir)
    x, y, z = GRID.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    nodes = forward.cartesian(xx, yy, zz).reshape(-1, 3)

    def compare(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                d = np.sqrt(((nodes - forward.cartesian(r.st_lon, r.st_lat, -r.elevation_m / 1000)) ** 2).sum(-1)) / (6.0 if r.phase == "P" else 3.46)
                out.append(float(np.max(np.abs(np.asarray(r.t) - d)[d > 1] / d[d > 1])) < 1e-4)
            yield pd.DataFrame({"station": b["station"], "phase": b["phase"], "exact": out})

    return t.join(st, "station").mapInPandas(compare, "station long, phase string, exact boolean")


@query(
    """
with u as (select *, row_number() over (partition by event, station, phase order by sigma_s, predicted_s + noise_s, seq) as r from ar where disabled = 0 and quality < 4 and sigma_s > 0)
select event, count(*) as readings, true as inside, true as finite from u where r = 1 group by event having count(*) >= 4
"""
)
def n22_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute hypocentres of all events with four usable arrivals or more: which events have one, from how many readings, inside the grid."""
    scratch = Scratch(spark, "tables")
    places = fx.stations(spark, sf_dir).select(locate.place().alias("station"), "st_lon", "st_lat", "elevation_m").distinct()
    tables = scratch.keep(locate.travel_time_tables(places, GRID, _uniform()))
    a = cat.best_picks(spread(usable_arrivals(spark, sf_dir).withColumn("origin", F.lit("manual")), "event"), time="time_s").withColumn("place", locate.place())
    h = locate.locate(spark, a, tables, GRID, spread_out=False)
    inside = GRID.contains(F.col("lon"), F.col("lat"), F.col("depth_km"))
    return h.select("event", (F.col("phases") + F.col("rejected")).cast("long").alias("readings"), inside.alias("inside"), (~F.isnan("rms_s") & (F.col("rms_s") >= 0) & (F.col("major_km") >= F.col("minor_km"))).alias("finite"))


@query("with l as (select unnest(range(9)) as layer) select phase, cast(layer as int) as layer, true as bounded, true as better from l, (select unnest(['P', 'S']) as phase)")
def n15_layered_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum one-dimensional model from a start that is 5 % too fast: one value a layer and phase, two iterations over all events with
    four readings or more. Whether each value is in its bounds, and whether it lies nearer to the velocity of the data than the start or the RMS fell."""
    a = tomography.select_observations(observations(spark, sf_dir), GRID)
    s = tomography.Settings(iterations=2, layered=True, straight=True, damping=5.0, smoothing=5.0)
    r = tomography.invert(spark, a, GRID, {"P": np.full(GRID.nodes, 6.3), "S": np.full(GRID.nodes, 3.63)}, s)
    fell = r.history[-1]["rms_s"] < r.history[0]["rms_s"]
    rows = [(p, k, bool(lo <= v.min() and v.max() <= hi), bool(fell and abs(float(v.mean()) - true) <= abs(first - true) + 0.2)) for p, lo, hi, first, true in (("P", 1.5, 14.5, 6.3, 6.0), ("S", 0.7, 8.5, 3.63, 3.46)) for k, v in enumerate(r.velocity[p])]
    return spark.createDataFrame(rows, "phase string, layer int, bounded boolean, better boolean")


@query("select phase, 1872 as nodes, true as fewer_cells, true as bounded, true as better from (select unnest(['P', 'S']) as phase)", views=False)
def n14_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vp, Vs and hypocentres on cells that follow the rays, from a start that is 5 % too fast: whether cells are fewer than nodes, velocities
    in their bounds, and the RMS lower after an iteration."""
    a = tomography.select_observations(observations(spark, sf_dir), GRID)
    s = tomography.Settings(iterations=1, adaptive=True, straight=True, damping=5.0, smoothing=5.0, cell_hits=200.0, solver_turns=100)
    r = tomography.invert(spark, a, GRID, {"P": np.full(GRID.nodes, 6.3), "S": np.full(GRID.nodes, 3.63)}, s)
    fell = r.history[-1]["rms_s"] < r.history[0]["rms_s"]
    rows = [(p, int(r.velocity[p].size), bool(r.mesh.n < GRID.nodes), bool(lo <= r.velocity[p].min() and r.velocity[p].max() <= hi), bool(fell)) for p, lo, hi in (("P", 1.5, 14.5), ("S", 0.7, 8.5))]
    return spark.createDataFrame(rows, "phase string, nodes int, fewer_cells boolean, bounded boolean, better boolean")


@query("with u as (select station, event from ar where disabled = 0 and quality < 4 and sigma_s > 0) select cast(station % 97 as int) as column, true as same, true as solved from u union select cast(97 + event % 53 as int), true, true from u")
def n8_lsqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distributed system (distances of all usable rays on terms of events' days and stations) solved by both solvers: whether they agree, and
    whether the normal equations hold, summed over the rows."""
    a = usable_arrivals(spark, sf_dir).select(F.array((F.col("station") % 97).cast("int"), (97 + F.col("event") % 53).cast("int")).alias("columns"), F.array(F.lit(1.0), F.lit(0.5)).alias("values"), F.col("path_km").alias("rhs"))
    rows = Scratch(spark, "system").keep(a)
    x, _ = linalg.solve_rows(rows, 150, damp=1.0, tolerance=1e-10)
    y, _ = linalg.solve_rows(rows, 150, damp=1.0, tolerance=1e-10, driver_entries=0)
    model = F.array(*[F.lit(float(v)) for v in x])
    left = F.col("rhs") - F.aggregate(F.zip_with("columns", "values", lambda c, v: v * model[c]), F.lit(0.0), lambda u, v: u + v)
    g = rows.withColumn("left", left).select(F.explode(F.arrays_zip("columns", "values")).alias("e"), "left", "rhs").groupBy(F.col("e.columns").alias("column"))
    g = g.agg(F.sum(F.col("e.values") * F.col("left")).alias("g"), F.sum(F.abs(F.col("e.values") * F.col("rhs"))).alias("size"))
    same = F.array(*[F.lit(bool(abs(u - v) < 1e-3)) for u, v in zip(x, y)])
    return g.select("column", same[F.col("column")].alias("same"), (F.abs(F.col("g") - model[F.col("column")]) < 1e-6 * F.col("size")).alias("solved"))


@query("with z as (select event, depth_km * 5 as z from ev) select event, round(case when z < 20 then 5.8 when z < 35 then 6.5 when z < 77.5 then 8.04 + (z - 35) / 42.5 * 0.005 end, 6) as vp, round(case when z < 20 then 3.46 when z < 35 then 3.85 when z < 77.5 then 4.48 + (z - 35) / 42.5 * 0.01 end, 6) as vs from z where z < 77.5")
def j11_velocity_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities of a one-dimensional model at five times the events' depths, in the crust and below it."""
    from quakespark.functions.model1d import LIBRARY

    m = LIBRARY["ak135"]
    z = F.col("depth_km") * 5
    return fx.events(spark, sf_dir).where(z < 77.5).select("event", F.round(m.velocity(z, "P"), 6).alias("vp"), F.round(m.velocity(z, "S"), 6).alias("vs"))


@query()
def n25_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanisms of all events with enough polarities, with quality."""
    from quakespark.plans.source import mechanisms
    from quakespark.source_queries import polarities

    return mechanisms(polarities(spark, sf_dir))


@query("select cast(i as int) as realization, true as orthogonal, true as ratio_in_bounds from range(1000) t(i)")
def n26_stress_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress axes of 1,000 resampled sets of all mechanisms, friction searched: whether axes are at right angles and the ratio is one."""
    from quakespark.plans.source import stress_bootstrap
    from quakespark.source_queries import mechanisms

    b = stress_bootstrap(mechanisms(spark, sf_dir).select("strike", "dip", "rake", "weight"))
    return _axes_checked(b).select(F.col("realization").cast("int").alias("realization"), "orthogonal", "ratio_in_bounds")


def _axes_checked(b: DataFrame) -> DataFrame:
    axis = lambda k: (F.radians(f"azimuth{k}"), F.radians(f"plunge{k}"))
    dot = lambda p, q: F.cos(p[1]) * F.cos(q[1]) * F.cos(p[0] - q[0]) + F.sin(p[1]) * F.sin(q[1])
    a = [axis(k) for k in (1, 2, 3) if f"azimuth{k}" in b.columns]
    pairs = [F.abs(dot(p, q)) for i, p in enumerate(a) for q in a[i + 1 :]]
    right = F.greatest(*pairs, F.lit(0.0)) < 1e-6
    return b.withColumn("orthogonal", right).withColumn("ratio_in_bounds", F.col("ratio").between(0, 1))


@query(
    """
with pl as (select p_partkey as id, cast((p_partkey * 7) % 1000 as double) / 10 as x, cast((p_partkey * 11) % 1000 as double) / 10 as y, cast((p_partkey * 3) % 200 as double) / 10 as z from part),
nd as (select cast(i as bigint) as node, cast(i % 10 * 10 as double) as x, cast(i // 10 * 10 as double) as y from range(100) t(i))
select node, cast(count(*) as int) as n, true as orthogonal, true as ratio_in_bounds from nd, pl
where (pl.x - nd.x) ** 2 / 625.0 + (pl.y - nd.y) ** 2 / 625.0 + (pl.z - 10) ** 2 / 81.0 <= 1 group by node having count(*) >= 5
""",
    views=False,
)
def n27_stress_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress at the nodes of a map from the mechanisms around each: which nodes have one, from how many, with axes at right angles."""
    from quakespark.operators.source import weighted_neighbours
    from quakespark.plans.source import stress_map
    from quakespark.source_queries import mechanisms

    k = F.col("id")
    mec = mechanisms(spark, sf_dir).select("id", "strike", "dip", "rake", (((k * 7) % 1000).cast("double") / 10).alias("x"), (((k * 11) % 1000).cast("double") / 10).alias("y"), (((k * 3) % 200).cast("double") / 10).alias("z"))
    nodes = spark.range(100).select(k.alias("node"), (k % 10 * 10).cast("double").alias("x"), (F.floor(k / 10) * 10).cast("double").alias("y"), F.lit(10.0).alias("z"))
    m = stress_map(weighted_neighbours(nodes, mec, radius_km=25.0, half_height_km=9.0), mec)
    return _axes_checked(m).select("node", "n", "orthogonal", "ratio_in_bounds")


@query("select event as id, true as adds_up, true as finite from ev")
def n28_coulomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coulomb stress change of one earthquake on receivers at all events' hypocentres: whether it is shear plus 0.4 times unclamping."""
    from quakespark.plans import source

    p = source.tapered_source(42.8, 13.2, 8.0, 160.0, 50.0, -90.0, 6.0, 12.0, 8.0, 3, 2)
    e = fx.events(spark, sf_dir).select(F.col("event").alias("id"), F.col("ev_lat").alias("lat"), F.col("ev_lon").alias("lon"), "depth_km", F.lit(160.0).alias("strike"), F.lit(50.0).alias("dip"), F.lit(-90.0).alias("rake"))
    c = source.coulomb(e, p, order=2)
    off = F.abs(F.col("coulomb_pa") - F.col("shear_pa") - 0.4 * F.col("unclamping_pa"))
    return c.select("id", (off <= 1e-6 * (1 + F.abs("coulomb_pa"))).alias("adds_up"), (~F.isnan("coulomb_pa") & (F.abs("coulomb_pa") < 1e9)).alias("finite"))


@query()
def n12_octree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that follow the coverage of P rays: number of cells by size."""
    from quakespark.plans import mesh

    c = forward.coverage(usable_arrivals(spark, sf_dir).where("phase = 'P'"), GRID).toPandas()  # of the model's size
    hits = np.zeros(GRID.nodes)
    hits[c["node"]] = c["hits"]
    return spark.createDataFrame(list(mesh.size_histogram(mesh.octree(GRID, hits, threshold=1000.0)).items()), "nodes int, cells int")


@query()
def g14_automatic_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic picks on synthetic waveforms of the stations that have P and S of an event."""
    from quakespark.operators.traces import pick_stations
    from quakespark.plans.synthetic import waveforms

    a = usable_arrivals(spark, sf_dir).groupBy("event", "station", "phase").agg(F.min("predicted_s").alias("time_s"))
    return pick_stations(waveforms(a))
