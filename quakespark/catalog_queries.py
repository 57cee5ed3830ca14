"""Queries of the catalogue operators over the fixture views, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark import fixtures as fx
from quakespark.common import table
from quakespark.functions import geo
from quakespark.functions.grid import Grid
from quakespark.operators import catalog as cat
from quakespark.operators import stats
from quakespark.operators.nearby import common_readings, nearest_within, pairs_within

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A grid over the fixture's area.
GRID = Grid(12.4, 13.9, 42.2, 43.4, -2.0, 22.0, 16, 13, 9)


def query(sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (fx.WITH + ",\n" + sql.strip()[5:] if sql.strip().startswith("with ") else fx.WITH + "\n" + sql) if views else sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Scalar functions


@query("select event, round(2 * 6371 * asin(least(1.0, sqrt(power(sin(radians(ev_lat - 42.8) / 2), 2) + cos(radians(42.8)) * cos(radians(ev_lat)) * power(sin(radians(ev_lon - 13.2) / 2), 2)))), 6) as km, round(fmod(degrees(atan2(sin(radians(ev_lon - 13.2)) * cos(radians(ev_lat)), cos(radians(42.8)) * sin(radians(ev_lat)) - sin(radians(42.8)) * cos(radians(ev_lat)) * cos(radians(ev_lon - 13.2)))) + 360, 360), 6) as azimuth from ev")
def f2_distance_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    return e.select("event", F.round(geo.distance_km(13.2, 42.8, "ev_lon", "ev_lat"), 6).alias("km"), F.round(geo.azimuth(13.2, 42.8, "ev_lon", "ev_lat"), 6).alias("azimuth"))


@query("select event, round((6371 - depth_km) * cos(radians(ev_lat)) * cos(radians(ev_lon)), 6) as x, round((6371 - depth_km) * cos(radians(ev_lat)) * sin(radians(ev_lon)), 6) as y, round((6371 - depth_km) * sin(radians(ev_lat)), 6) as z, round(ev_lon, 6) as lon, round(ev_lat, 6) as lat, round(depth_km, 6) as depth from ev")
def f1_cartesian_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir).withColumn("p", geo.to_cartesian("ev_lon", "ev_lat", "depth_km")).withColumn("g", geo.from_cartesian(F.col("p")))
    return e.select("event", *[F.round(F.col(f"p.{c}"), 6).alias(c) for c in "xyz"], F.round("g.lon", 6).alias("lon"), F.round("g.lat", 6).alias("lat"), F.round("g.depth_km", 6).alias("depth"))


@query(
    """
with d as (select event, radians(ev_lat) as p, radians(ev_lon) as l, radians(cast((event * 7) % 360 as double)) as a, cast(event % 50 as double) / 6371 as d from ev),
q as (select *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(a)) as q from d)
select event, round(degrees(l + atan2(sin(a) * sin(d) * cos(p), cos(d) - sin(p) * sin(q))), 6) as lon, round(degrees(q), 6) as lat from q
"""
)
def f3_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir).withColumn("g", geo.destination("ev_lon", "ev_lat", ((F.col("event") * 7) % 360).cast("double"), (F.col("event") % 50).cast("double")))
    return e.select("event", F.round("g.lon", 6).alias("lon"), F.round("g.lat", 6).alias("lat"))


@query(
    """
select rid, round(((lon + 180) - 360 * floor((lon + 180) / 360)) - 180, 6) as normal, round(lon - 360 * floor((lon - 180 + 180) / 360), 6) as unwrapped,
  ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][cast(((floor((lon + 720) / 22.5 + 0.5)) % 16) as int) + 1] as point
from (select distinct rid, lon from quakes where isfinite(lon))
""",
    views=False,
)
def f4_longitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "quakes").where("lon is not null and not isnan(lon)").select("rid", "lon").distinct()
    return q.select("rid", F.round(geo.normalize_longitude("lon"), 6).alias("normal"), F.round(geo.unwrap_longitude("lon", 180.0), 6).alias("unwrapped"), geo.compass(F.col("lon") + 720).alias("point"))


_CORNERS = """
f as (select event, ev_lon, ev_lat, depth_km, (ev_lon - 12.4) / 0.1 as x, (ev_lat - 42.2) / 0.1 as y, (depth_km + 2.0) / 3.0 as z from ev),
c as (select *, least(greatest(x, 0), 15) as cx, least(greatest(y, 0), 12) as cy, least(greatest(z, 0), 8) as cz from f),
a as (select *, cast(least(floor(cx), 14) as int) as i, cast(least(floor(cy), 11) as int) as j, cast(least(floor(cz), 7) as int) as k from c)
"""


@query(
    "with " + _CORNERS + """
select event, round(sum(w * (12.4 + (i + di) * 0.1)), 6) as lon, round(sum(w * (-2.0 + (k + dk) * 3.0)), 6) as depth, round(sum(w), 6) as total
from (select event, i, j, k, di, dj, dk,
  (case di when 1 then cx - i else 1 - (cx - i) end) * (case dj when 1 then cy - j else 1 - (cy - j) end) * (case dk when 1 then cz - k else 1 - (cz - k) end) as w
  from a, (select unnest([0, 1]) as di), (select unnest([0, 1]) as dj), (select unnest([0, 1]) as dk))
group by event
"""
)
def f5_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trilinear weights give linear fields back."""
    e = fx.events(spark, sf_dir).select("event", F.explode(GRID.corners(F.col("ev_lon"), F.col("ev_lat"), F.col("depth_km"))).alias("c"))
    n = F.col("c.node")
    i, k = n % GRID.nx, F.floor(n / (GRID.nx * GRID.ny))
    dx, _, dz = GRID.steps
    g = e.groupBy("event").agg(F.sum(F.col("c.w") * (GRID.min_lon + i * dx)).alias("lon"), F.sum(F.col("c.w") * (GRID.min_depth + k * dz)).alias("depth"), F.sum("c.w").alias("total"))
    return rounded(g, "lon", "depth", "total")


@query("select event, (ev_lon between 12.8 and 13.4 and ev_lat between 42.4 and 43.0) as inside, round((ev_lon - 12.4) / 0.1, 6) as x from ev")
def pr3_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, _ = GRID.fractional(F.col("ev_lon"), F.col("ev_lat"), F.col("depth_km"))
    return fx.events(spark, sf_dir).select("event", geo.in_box("ev_lon", "ev_lat", 12.8, 13.4, 42.4, 43.0).alias("inside"), F.round(x, 6).alias("x"))


# Selection


@query("select event, station, phase, seq, round(1 / greatest(0.01, sigma_s), 6) as weight from pk where disabled = 0 and quality < 4 and sigma_s > 0")
def pr1_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.picks(spark, sf_dir).where(cat.usable()).select("event", "station", "phase", "seq", F.round(cat.weight(), 6).alias("weight"))


@query(
    "select auto_id, case when phase in ('P','Pg','Pn','Pb','P*','Pp','PG','PN','p') then 'P' when phase in ('S','Sg','Sn','Sb','S*','SG','SN','s') then 'S' end as read_as from (select distinct auto_id, phase from auto_picks)",
    views=False,
)
def pr2_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "auto_picks").select("auto_id", "phase").distinct().select("auto_id", cat.phase_of("phase").alias("read_as"))


_BEST = """
b as (
  select * from (
    select *, count(*) filter (where origin <> 'automatic') over (partition by event) as analyst from pk where disabled = 0 and quality < 4 and sigma_s > 0)
  where origin <> 'automatic' or analyst < 8
  qualify row_number() over (partition by event, station, phase order by case origin when 'manual' then 0 when 'automatic' then 2 else 1 end, sigma_s, travel_time_s, seq) = 1)
"""


@query(
    """
with m as (select * replace (case when (station + seq) % 2 = 0 then 'iv.' else 'IV.' end || cast(station % 5 as varchar) as station) from pk),
u as (select *, count(*) filter (where origin <> 'automatic') over (partition by event) as analyst from m where disabled = 0 and quality < 4 and sigma_s > 0)
select event, station, phase, seq, origin from u where origin <> 'automatic' or analyst < 8
qualify row_number() over (partition by event, upper(station), phase order by case origin when 'manual' then 0 when 'catalog' then 1 else 2 end, sigma_s, travel_time_s, seq) = 1
"""
)
def w1_mixed_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best picks of stations whose codes are written in two ways."""
    s = F.concat(F.when((F.col("station") + F.col("seq")) % 2 == 0, "iv.").otherwise("IV."), (F.col("station") % 5).cast("string"))
    return cat.best_picks(fx.picks(spark, sf_dir).withColumn("station", s)).select("event", "station", "phase", "seq", "origin")


@query("with " + _BEST + "select event, station, phase, seq, origin, sigma_s, travel_time_s from b")
def w1_best_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.best_picks(fx.picks(spark, sf_dir)).select("event", "station", "phase", "seq", "origin", "sigma_s", "travel_time_s")


@query(
    "with " + _BEST + """
select event, count(*) as phases, count(*) filter (where phase = 'P') as n_p from b join ev using (event) where magnitude >= 2.0 group by event having count(*) >= 3
"""
)
def pr8_event_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = cat.best_picks(fx.picks(spark, sf_dir)).join(fx.events(spark, sf_dir).where("magnitude >= 2.0").select("event"), "event")
    return b.groupBy("event").agg(F.count(F.lit(1)).alias("phases"), F.count(F.when(F.col("phase") == "P", 1)).alias("n_p")).where("phases >= 3")


@query(
    """
with o as (select event, case when event % 3 = 0 then ev_lat + 0.01 end as lat2 from ev)
select event, round(coalesce(lat2, ev_lat), 6) as ev_lat, round(ev_lon, 6) as ev_lon from ev left join o using (event)
"""
)
def pr7_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    new = e.where("event % 3 = 0").select("event", (F.col("ev_lat") + 0.01).alias("ev_lat"))
    return rounded(cat.override_hypocentres(e, new, ["ev_lat"]).select("event", "ev_lat", "ev_lon"), "ev_lat", "ev_lon")


@query(
    """
with s as (select distinct id, upper(split_part(id, '.', 2)) as code from stations),
u as (select code, min(id) as id from s group by code having count(distinct upper(id)) = 1),
p as (select distinct auto_id, 'XX.' || split_part(station, '.', 2) as station from auto_picks where station is not null)
select auto_id, coalesce(u.id, station) as station from p left join u on upper(split_part(station, '.', 2)) = u.code
""",
    views=False,
)
def pr6_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "auto_picks").where("station is not null").select("auto_id", F.concat(F.lit("XX."), F.element_at(F.split("station", r"\."), 2)).alias("station")).distinct()
    return cat.relabel_networks(p, table(spark, sf_dir, "stations"))


# Joins


@query(
    """
select ref, n from (
  select 'matched' as ref, count(*) as n from pk join ev on pk.event = ev.event where pk.event % 7 <> 0 union all
  select 'unmatched', count(*) from pk where pk.event % 7 = 0)
"""
)
def j1_pick_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, none = cat.match(fx.picks(spark, sf_dir), fx.events(spark, sf_dir).where("event % 7 <> 0"), ["event"])
    n = lambda d, r: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("ref"), "n")
    return n(ok, "matched").unionByName(n(none, "unmatched"))


@query(
    """
select a.auto_id, s.id as station_id from (select distinct auto_id, station from auto_picks where station is not null) a
join (select distinct id from stations) s on upper(a.station) = upper(s.id)
""",
    views=False,
)
def j2_pick_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "auto_picks").where("station is not null").select("auto_id", "station").distinct()
    s = table(spark, sf_dir, "stations").select("id").distinct().select(F.col("id").alias("station"), F.col("id").alias("station_id"))
    return cat.match(a, s, ["station"], fold=("station",))[0].select("auto_id", "station_id")


@query(
    """
select f.fit_id, q.rid, s.id as station from (select distinct fit_id, event_id, station_id from spectrum_fits) f
join (select distinct rid, id from quakes) q on f.event_id = q.id join (select distinct id from stations) s on upper(f.station_id) = upper(s.id)
""",
    views=False,
)
def j3_tstar_event_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "spectrum_fits").select("fit_id", "event_id", F.col("station_id").alias("station")).distinct()
    q = table(spark, sf_dir, "quakes").select("rid", F.col("id").alias("event_id")).distinct()
    s = table(spark, sf_dir, "stations").select("id").distinct().select(F.col("id").alias("station"), F.col("id").alias("sid"))
    j = cat.match(cat.match(f, q, ["event_id"])[0], s, ["station"], fold=("station",))[0]
    return j.select("fit_id", "rid", F.col("sid").alias("station"))


_PS = """
ps as (
  select p.event, p.station, p.t as p_time, s.t as s_time from
  (select event, station, travel_time_s as t from pk where phase = 'P' and disabled = 0 and quality < 4 and sigma_s > 0 qualify row_number() over (partition by event, station order by sigma_s, travel_time_s, seq) = 1) p
  join (select event, station, travel_time_s as t from pk where phase = 'S' and disabled = 0 and quality < 4 and sigma_s > 0 qualify row_number() over (partition by event, station order by sigma_s, travel_time_s, seq) = 1) s
  on p.event = s.event and p.station = s.station)
"""


@query("with " + _PS + "select event, station, round(p_time, 6) as p_time, round(s_time, 6) as s_time from ps")
def j5_p_and_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cat.p_and_s(fx.picks(spark, sf_dir)), "p_time", "s_time")


_XYZ = "x as (select event, (6371 - depth_km) * cos(radians(ev_lat)) * cos(radians(ev_lon)) as x, (6371 - depth_km) * cos(radians(ev_lat)) * sin(radians(ev_lon)) as y, (6371 - depth_km) * sin(radians(ev_lat)) as z from ev)"
_PAIRS = _XYZ + """,
pr as (
  select a.event as a, b.event as b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as km
  from x a join x b on floor(b.z / 2) between floor(a.z / 2) - 1 and floor(a.z / 2) + 1 and a.event < b.event and abs(a.z - b.z) <= 2.0 and abs(a.x - b.x) <= 2.0 and abs(a.y - b.y) <= 2.0)
"""
#: Kilometres between events of a pair.
PAIR_KM = 2.0
_AT = {"id": "event", "lat": "ev_lat", "lon": "ev_lon", "depth_km": "depth_km"}


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(fx.events(spark, sf_dir), PAIR_KM, **_AT)


def _common(spark: SparkSession, sf_dir: str, readings: DataFrame, values: list[str]) -> DataFrame:
    """(a, b, station, phase, values of both, km) of the pairs' common readings."""
    return common_readings(readings, fx.events(spark, sf_dir), PAIR_KM, values, **_AT)


@query("with " + _PAIRS + "select a, b, round(km, 6) as km from pr where km <= 2.0")
def j6_event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.round("distance_km", 6).alias("km"))


@query(
    "with " + _BEST + "," + _PAIRS + """
select pr.a, pr.b, x.station, x.phase, round(x.travel_time_s - y.travel_time_s, 6) as difference_s from pr
join b x on x.event = pr.a join b y on y.event = pr.b and x.station = y.station and x.phase = y.phase where km <= 2.0
"""
)
def j7_common_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _common(spark, sf_dir, cat.best_picks(fx.picks(spark, sf_dir)), ["travel_time_s"])
    return j.select("a", "b", "station", "phase", F.round(F.col("travel_time_s_a") - F.col("travel_time_s_b"), 6).alias("difference_s"))


@query(
    """
with d as (select distinct dt_id, trim(event_a, ' ') as a, trim(event_b, ' ') as b, upper(station) as st, phase from dt_cc),
q as (select distinct rid, id from quakes), c as (select distinct cid, upper(network || '.' || station) as st from channels),
r as (select distinct q.id, c.st, case flags & 15 when 0 then 'P' when 1 then 'S' end as phase from picks join q on event_rid = rid join c using (cid) where flags & 15 <= 1)
select dt_id, (x.id is not null and y.id is not null) as usable from d left join r x on x.id = a and x.st = d.st and x.phase = d.phase left join r y on y.id = b and y.st = d.st and y.phase = d.phase
""",
    views=False,
)
def j8_cc_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-correlation times whose two arrivals exist."""
    d = table(spark, sf_dir, "dt_cc").select("dt_id", F.trim("event_a").alias("a"), F.trim("event_b").alias("b"), F.upper("station").alias("st"), "phase").distinct()
    q = table(spark, sf_dir, "quakes").select(F.col("rid").alias("event_rid"), "id").distinct()
    c = table(spark, sf_dir, "channels").select("cid", F.upper(F.concat_ws(".", "network", "station")).alias("st")).distinct()
    kind = F.col("flags").bitwiseAND(15)
    r = table(spark, sf_dir, "picks").where(kind <= 1).select("event_rid", "cid", F.when(kind == 0, "P").otherwise("S").alias("phase")).distinct()
    r = r.join(q, "event_rid").join(c, "cid").select("id", "st", "phase").distinct()
    x, y = r.withColumnRenamed("id", "a").withColumn("x", F.lit(1)), r.withColumnRenamed("id", "b").withColumn("y", F.lit(1))
    return d.join(x, ["a", "st", "phase"], "left").join(y, ["b", "st", "phase"], "left").select("dt_id", (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("usable"))


@query(
    """
with ep as (select s_suppkey % 5 as ch, s_suppkey as ordinal, cast((s_suppkey * 37) % 1000 as double) as start, cast((s_suppkey * 37) % 1000 + 5 as double) as "end" from supplier),
t as (select event_id, user_id % 5 as ch, value from events)
select event_id, ordinal from (
  select event_id, ordinal, row_number() over (partition by event_id order by case when value between start and "end" then 0 else 1 end, case when value between start and "end" then ordinal else -ordinal end) as n
  from t left join ep using (ch)) where n = 1
""",
    views=False,
)
def j9_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    ep = s.select((F.col("s_suppkey") % 5).alias("ch"), F.col("s_suppkey").alias("ordinal"), ((F.col("s_suppkey") * 37) % 1000).cast("double").alias("start"), ((F.col("s_suppkey") * 37) % 1000 + 5).cast("double").alias("end"))
    t = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("ch"), "value")
    return cat.epoch_of(t, ep, on="ch", time="value", key="event_id").select("event_id", "ordinal")


@query(
    """
with a as (select event_id as a, user_id % 50 as ch, epoch_us(ts) / 1000000.0 as s0, epoch_us(ts) / 1000000.0 + 30 as s1 from events where event_type = 'view'),
b as (select event_id as b, user_id % 50 as ch, epoch_us(ts) / 1000000.0 as t0, epoch_us(ts) / 1000000.0 + 45 as t1 from events where event_type = 'purchase')
select a, b from a join b on a.ch = b.ch and s0 <= t1 and t0 <= s1
""",
    views=False,
)
def j10_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one channel that overlap those of another kind."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 50).alias("ch"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    a = e.where("event_type = 'view'").select(F.col("event_id").alias("a"), "ch", F.col("t").alias("s0"), (F.col("t") + 30).alias("s1"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("b"), "ch", F.col("t").alias("t0"), (F.col("t") + 45).alias("t1"))
    return cat.overlapping(a, b, on=["ch"], a_span=("s0", "s1"), b_span=("t0", "t1"), width=3600.0).select("a", "b")


@query(
    """
select event, src from (
  select event, 0 as src from ev where event % 2 = 0 union all
  select event, 1 from ev where event % 3 = 0 and event % 2 <> 0)
"""
)
def u1_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir).select("event")
    return cat.first_wins([e.where("event % 2 = 0").withColumn("src", F.lit(0)), e.where("event % 3 = 0").withColumn("src", F.lit(1))], "event")


@query(
    """
select event, station, phase, seq, origin from pk where origin <> 'automatic'
union all select event, station, phase, seq + 100, 'automatic' from pk where origin = 'automatic' and quality < 2
"""
)
def u5_replace_automatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.picks(spark, sf_dir).select("event", "station", "phase", "seq", "origin", "quality")
    new = p.where("origin = 'automatic' and quality < 2").withColumn("seq", F.col("seq") + 100)
    return cat.replace_automatic(p, new).drop("quality")


@query("select distinct least(trim(event_a, ' '), trim(event_b, ' ')) as a, greatest(trim(event_a, ' '), trim(event_b, ' ')) as b from dt_cc where trim(event_a, ' ') <> trim(event_b, ' ')", views=False)
def u3_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.trim("event_a"), F.trim("event_b")
    return table(spark, sf_dir, "dt_cc").where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


# Aggregation


@query("select count(*) filter (where phase = 'P') as picks_p, count(*) filter (where phase = 'S') as picks_s from pk where disabled = 0 and quality < 4 and sigma_s > 0")
def a1_phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.count_phases(fx.picks(spark, sf_dir))


_REJECT = """
m as (select median(noise_s) as c from ar), d as (select ar.*, abs(noise_s - c) as d from ar, m), q as (select 1.4826 * median(d) as mad from d),
rj as (select d.*, d > greatest(0.5, 4 * mad) as rejected from d, q)
"""


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reject_outliers(fx.arrivals(spark, sf_dir), residual="noise_s", floor_s=0.5)


@query(
    "with " + _REJECT + """
select count(*) filter (where not rejected) as used, count(*) filter (where rejected) as rejected, round(sqrt(avg(noise_s * noise_s) filter (where not rejected)), 6) as rms,
  round(sqrt(avg(noise_s * noise_s) filter (where not rejected and phase = 'P')), 6) as rms_p, round(sqrt(avg(noise_s * noise_s) filter (where not rejected and phase = 'S')), 6) as rms_s,
  round(sqrt(sum(noise_s * noise_s / power(greatest(0.01, sigma_s), 2)) filter (where not rejected) / sum(1 / power(greatest(0.01, sigma_s), 2)) filter (where not rejected)), 6) as weighted_rms from rj
"""
)
def a2_residual_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cat.residual_statistics(_rejected(spark, sf_dir), residual="noise_s"), "rms", "rms_p", "rms_s", "weighted_rms")


@query("select station, round(median(noise_s), 6) as median, count(*) as n from ar group by station")
def a3_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.median(fx.arrivals(spark, sf_dir), ["station"], "noise_s"), "median")


@query("select phase, round(median, 6) as median, n from (select phase, list_sort(list(noise_s))[count(*) // 2 + 1] as median, count(*) as n from ar group by phase)")
def a4_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.upper_median(fx.arrivals(spark, sf_dir), ["phase"], "noise_s"), "median")


@query("with m as (select phase, median(noise_s) as c from ar group by phase) select phase, round(c, 6) as median, round(1.4826 * median(abs(noise_s - c)), 6) as mad from ar join m using (phase) group by phase, c")
def a5_scaled_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.scaled_mad(fx.arrivals(spark, sf_dir), ["phase"], "noise_s"), "median", "mad")


@query(
    """
with w as (select event, noise_s, cast(1 + quality as bigint) as wt, l_partkey, seq from ar),
c as (select *, sum(wt) over (partition by event order by noise_s, l_partkey, seq rows unbounded preceding) as upto, sum(wt) over (partition by event) as total from w)
select event, round(min_by(noise_s, upto), 6) as median from c where upto >= total / 2.0 group by event
"""
)
def a6_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.arrivals(spark, sf_dir).withColumn("wt", (1 + F.col("quality")).cast("long"))
    return rounded(stats.weighted_lower_median(a, ["event"], "noise_s", "wt", ["l_partkey", "seq"]), "median")


@query("select station, round(quantile_cont(noise_s, 0.95), 6) as value from ar group by station")
def a7_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.interpolated_percentile(fx.arrivals(spark, sf_dir), ["station"], "noise_s", 0.95), "value")


@query("select phase, round(list_sort(list(path_km))[cast(floor(0.95 * (count(*) - 1)) as bigint) + 1], 6) as value from ar group by phase")
def a8_truncated_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.truncated_percentile(fx.arrivals(spark, sf_dir), ["phase"], "path_km", 0.95), "value")


@query(
    "with " + _REJECT + """
select station, round(avg(noise_s) filter (where phase = 'P' and not rejected), 9) as mean_p, count(*) filter (where phase = 'P' and not rejected) as n_p,
  round(avg(noise_s) filter (where phase = 'S' and not rejected), 9) as mean_s, count(*) filter (where phase = 'S' and not rejected) as n_s from rj group by station
"""
)
def a20_station_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cat.station_statistics(_rejected(spark, sf_dir), "noise_s"), "mean_p", "mean_s", digits=9)


@query(
    "with " + _REJECT + """
select event, round(sqrt(avg(noise_s * noise_s) filter (where not rejected)), 6) as rms, count(*) filter (where phase = 'P' and not rejected) as n_p,
  count(*) filter (where phase = 'S' and not rejected) as n_s, count(*) filter (where rejected) as n_rejected from rj group by event
"""
)
def a20_event_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cat.event_statistics(_rejected(spark, sf_dir), "noise_s"), "rms")


@query(
    """
with c as (select event, median(noise_s) as c from ar group by event), d as (select ar.*, abs(noise_s - c) as d from ar join c using (event)),
q as (select 1.4826 * median(d) as mad from d)
select event, seq, d > greatest(0.3, 4 * mad) or abs(noise_s) > 5 as rejected from d, q
"""
)
def n14_event_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tomography's outliers: centred on each event's median, with an absolute limit."""
    r = stats.reject_outliers(fx.arrivals(spark, sf_dir), residual="noise_s", floor_s=0.3, centre_by=["event"], absolute_s=5.0)
    return r.select("event", "seq", "rejected")


@query("select min(ev_lon) as min_lon, max(ev_lon) as max_lon, min(ev_lat) as min_lat, max(ev_lat) as max_lat, max(depth_km) as max_depth, count(distinct event) as events from ev")
def a24_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    return e.agg(F.min("ev_lon").alias("min_lon"), F.max("ev_lon").alias("max_lon"), F.min("ev_lat").alias("min_lat"), F.max("ev_lat").alias("max_lat"), F.max("depth_km").alias("max_depth"), F.count_distinct("event").alias("events"))


@query(
    """
with d as (
  select a.station, min(2 * 6371 * asin(least(1.0, sqrt(power(sin(radians(b.st_lat - a.st_lat) / 2), 2) + cos(radians(a.st_lat)) * cos(radians(b.st_lat)) * power(sin(radians(b.st_lon - a.st_lon) / 2), 2))))) as km
  from st a join st b on a.station <> b.station group by a.station)
select round(list_sort(list(km))[count(*) // 2 + 1], 6) as median_km, count(*) as stations from d
"""
)
def a21_station_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of each station's distance to the nearest other one. A search in growing strips, not a join of all with all."""
    from quakespark.plans.advisor import nearest_station_km

    m = stats.upper_median(nearest_station_km(fx.stations(spark, sf_dir)), [], "km")
    return m.select(F.round("median", 6).alias("median_km"), F.col("n").alias("stations"))


# Windows


@query(
    """
with z as (
  select distinct event, fmod(degrees(atan2(sin(radians(st_lon - ev_lon)) * cos(radians(st_lat)), cos(radians(ev_lat)) * sin(radians(st_lat)) - sin(radians(ev_lat)) * cos(radians(st_lat)) * cos(radians(st_lon - ev_lon)))) + 360, 360) as a from ar),
d as (select event, a, a - lag(a) over (partition by event order by a) as d from z)
select event, round(case when count(*) < 2 then 360 else greatest(max(d), 360 - max(a) + min(a)) end, 6) as gap_deg from d group by event
"""
)
def w2_azimuthal_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.arrivals(spark, sf_dir).withColumn("azimuth", geo.azimuth("ev_lon", "ev_lat", "st_lon", "st_lat"))
    return rounded(cat.azimuthal_gap(a, ["event"]), "gap_deg")


@query(
    """
with t as (select event, case when t > 90 then 180 - t else t end as t from (select event, cast(20 + (l_partkey * 17) % 140 as double) as t from pk) union all select distinct event, unnest([0.0, 90.0]) from pk),
d as (select event, t - lag(t) over (partition by event order by t) as d from t)
select event, round(max(d), 6) as gap_deg from d group by event
"""
)
def w3_takeoff_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.picks(spark, sf_dir).select("event", (20 + (F.col("l_partkey") * 17) % 140).cast("double").alias("takeoff"))
    return rounded(cat.takeoff_gap(p, ["event"]), "gap_deg")


@query(
    "with " + _PAIRS + """,
s as (select a as event, b as other, km from pr where km <= 2.0 union all select b, a, km from pr where km <= 2.0)
select event, other, rank from (select event, other, row_number() over (partition by event order by round(km, 9), other) as rank from s) where rank <= 5
"""
)
def w4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest events within the pair distance."""
    return nearest_within(fx.events(spark, sf_dir), PAIR_KM, 5, **_AT).withColumnRenamed("id", "event")


@query(
    "with " + _BEST + "," + _PAIRS + """,
l as (select pr.a, pr.b, count(*) as links, any_value(km) as km from pr join b x on x.event = pr.a join b y on y.event = pr.b and x.station = y.station and x.phase = y.phase where km <= 2.0 group by pr.a, pr.b),
s as (select a as event, b as other, links, km from l union all select b, a, links, km from l),
c as (select *, coalesce(sum(case when links >= 2 then 1 else 0 end) over (partition by event order by round(km, 9), other rows between unbounded preceding and 1 preceding), 0) as strong_before from s)
select event, other, links from c where strong_before < 3
"""
)
def w5_strong_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in order of distance until three strong ones (two common readings) are met; weaker ones on the way stay."""
    links = _common(spark, sf_dir, cat.best_picks(fx.picks(spark, sf_dir)), []).groupBy("a", "b").agg(F.count(F.lit(1)).alias("links"), F.max("km").alias("km"))
    s = links.select(F.col("a").alias("event"), F.col("b").alias("other"), "links", "km").unionAll(links.select("b", "a", "links", "km"))
    w = Window.partitionBy("event").orderBy(F.round("km", 9), "other").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("links") >= 2, 1).otherwise(0)).over(w), F.lit(0))
    return s.withColumn("n", before).where("n < 3").select("event", "other", "links")


@query(
    "with " + _BEST + "," + _PAIRS + """,
o as (
  select pr.a, pr.b, x.station, x.phase, row_number() over (partition by pr.a, pr.b order by x.travel_time_s + y.travel_time_s, x.station, x.phase) as rank, count(*) over (partition by pr.a, pr.b) as n
  from pr join b x on x.event = pr.a join b y on y.event = pr.b and x.station = y.station and x.phase = y.phase where km <= 2.0)
select a, b, station, phase from o where rank <= 2 and n >= 1
"""
)
def w6_pair_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair the two nearest common readings (by their summed times)."""
    j = _common(spark, sf_dir, cat.best_picks(fx.picks(spark, sf_dir)), ["travel_time_s"])
    w = Window.partitionBy("a", "b").orderBy(F.col("travel_time_s_a") + F.col("travel_time_s_b"), "station", "phase")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("a", "b", "station", "phase")


@query("select distinct on (upper(id)) upper(id) as station, loaded_at from stations order by upper(id), loaded_at", views=False)
def w16_first_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(F.upper("id")).orderBy("loaded_at")
    return table(spark, sf_dir, "stations").withColumn("n", F.row_number().over(w)).where("n = 1").select(F.upper("id").alias("station"), "loaded_at")


# Top-k and orders


@query("select event, n, cast(row_number() over (order by n desc, event) as int) - 1 as index from (select event, count(*) as n from pk where disabled = 0 and quality < 4 and sigma_s > 0 group by event) order by n desc, event limit 100")
def t1_top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 events with most usable picks, numbered. The limit is the operator."""
    n = fx.picks(spark, sf_dir).where(cat.usable()).groupBy("event").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event").limit(100)
    return n.withColumn("index", F.row_number().over(Window.orderBy(F.desc("n"), "event")) - 1)


@query("select event, min_by(station, (path_km, station)) as nearest, round(min(path_km), 6) as km from ar group by event")
def t3_arg_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest recording station of each event; the smaller station on ties."""
    m = fx.arrivals(spark, sf_dir).groupBy("event").agg(F.min(F.struct("path_km", "station")).alias("m"))
    return m.select("event", F.col("m.station").alias("nearest"), F.round("m.path_km", 6).alias("km"))


@query(
    """
with r as (select event, station, phase, cast(row_number() over (partition by event order by station, phase, seq) as int) - 1 as n, count(*) over (partition by event) as total from pk)
select event, station, phase, n from r where n % (total // 3 + 1) = 0
"""
)
def t4_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th reading of an event, k = n/3 + 1: a sampling operator."""
    w = Window.partitionBy("event")
    r = fx.picks(spark, sf_dir).withColumn("n", F.row_number().over(w.orderBy("station", "phase", "seq")) - 1).withColumn("total", F.count(F.lit(1)).over(w))
    return r.where(F.col("n") % (F.floor(F.col("total") / 3) + 1) == 0).select("event", "station", "phase", "n")
