"""Queries of the operators for data quality and proximity, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.common import table
from quakespark.operators.anomalies import implausible_readings
from quakespark.operators.nearby import pairs_within
from quakespark.operators.orphans import count_by_month, orphan_references

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """
with q as (
  select distinct rid, lat, lon, 6371 - depth_km as r from quakes
  where isfinite(lat) and isfinite(lon) and isfinite(depth_km) and lat between -90 and 90 and not (lat = 0 and lon = 0)),
x as (
  select rid, lat, r * cos(radians(lat)) * cos(radians(lon)) as x, r * cos(radians(lat)) * sin(radians(lon)) as y, r * sin(radians(lat)) as z from q)
select distinct least(a.rid, b.rid) as rid_a, greatest(a.rid, b.rid) as rid_b
from x a join x b on a.rid < b.rid and abs(a.z - b.z) <= 1 and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1
where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 1.0
"""
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_within(table(spark, sf_dir, "quakes"), 1.0, id="rid", lat="lat", lon="lon", depth_km="depth_km")
    return pairs.select(F.col("id_a").alias("rid_a"), F.col("id_b").alias("rid_b"))


_P5 = """
with r as (
  select * from trace_quality where report_id is not null
  qualify row_number() over (partition by report_id order by loaded_at nulls last) = 1),
a as (
  select *, coalesce(
      (not isnan(max_abs) and (max_abs < 0 or isinf(max_abs))), false) or coalesce((not isnan(rms) and (rms < 0 or isinf(rms))), false)
    or coalesce(not isnan(max_abs) and not isnan(rms) and max_abs < rms, false) or coalesce(spikes < 0, false) or coalesce(spikes > samples, false)
    or coalesce(flat and clipped, false) or coalesce(flat and spikes > 0, false) as bad
  from r),
v as (select *, case when not bad and isfinite(max_abs) then ln(greatest(max_abs, 1e-300)) end as l, case when not bad then spikes end as sp from a),
m as (
  select nslc, median(l) as ml, median(sp) as ms, avg(cast(flat as int)) as fs, avg(cast(clipped as int)) as cs from v group by nslc),
d as (select v.nslc, median(abs(l - ml)) as md from v join m on v.nslc = m.nslc group by v.nslc),
w as (
  select *, case when max_abs is not null and not isnan(max_abs) and max_abs = lag(max_abs) over o then 0 else 1 end as new
  from v window o as (partition by nslc order by start_time, report_id)),
g as (select *, sum(new) over (partition by nslc order by start_time, report_id rows unbounded preceding) as run from w),
h as (select *, count(*) over (partition by nslc, run) as len from g),
j as (
  select report_id, bad as impossible, coalesce(abs(l - ml) > 10 * md, false) as off_level, coalesce(sp > 10 * (1 + ms), false) as many_spikes,
    coalesce(flat and fs < 0.2, false) as rare_flat, coalesce(clipped and cs < 0.2, false) as rare_clipped,
    h.nslc is not null and len >= 5 and max_abs is not null and not isnan(max_abs) as stuck_run
  from h left join m on h.nslc = m.nslc left join d on h.nslc = d.nslc)
"""


@query(_P5 + "select report_id from j where impossible or off_level or many_spikes or rare_flat or rare_clipped or stuck_run")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_readings(table(spark, sf_dir, "trace_quality")).where("flagged").select("report_id")


@query(_P5 + "select *, impossible or off_level or many_spikes or rare_flat or rare_clipped or stuck_run as flagged, true as scored from j")
def p5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report with the rules that apply to it, and whether its score is one."""
    r = implausible_readings(table(spark, sf_dir, "trace_quality"))
    return r.withColumn("scored", F.coalesce(F.col("score").between(0, 1), F.lit(False))).drop("score", "candidate")


@query()
def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report with its score and the rules that apply."""
    return implausible_readings(table(spark, sf_dir, "trace_quality")).withColumn("score", F.round("score", 6))


_P6 = """
with p as (select pick_id, event_rid, cid, loaded_at from picks),
r as (
  select 'picks.event_rid' as ref_field, pick_id as record_id, cast(event_rid as varchar) as k, min(loaded_at) as at from picks where event_rid is not null and pick_id is not null group by all
  union all select 'picks.cid', pick_id, cast(cid as varchar), min(loaded_at) from picks where cid is not null and pick_id is not null group by all
  union all select 'dt_cc.station', cast(dt_id as varchar), upper(station), min(loaded_at) from dt_cc where station is not null and dt_id is not null group by all),
t as (
  select 'picks.event_rid' as ref_field, cast(rid as varchar) as k, min(loaded_at) as first, max(cast(deleted_at is not null as int)) as deleted from quakes where rid is not null group by all
  union all select 'picks.cid', cast(cid as varchar), min(loaded_at), max(cast(deleted_at is not null as int)) from channels where cid is not null group by all
  union all select 'dt_cc.station', upper(id), min(loaded_at), max(cast(deleted_at is not null as int)) from stations where id is not null group by all),
f as (
  select r.ref_field, r.record_id, case when t.k is null then 'missing' when t.deleted = 1 then 'deleted' when t.first > r.at then 'late' end as ref_state, strftime(r.at, '%Y-%m') as load_month
  from r left join t on r.ref_field = t.ref_field and r.k = t.k)
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks, dt = table(spark, sf_dir, "picks"), table(spark, sf_dir, "dt_cc").withColumn("station", F.upper("station"))
    stations = table(spark, sf_dir, "stations").withColumn("id", F.upper("id"))
    checks = [
        ("picks.event_rid", picks, "pick_id", "event_rid", table(spark, sf_dir, "quakes"), "rid"),
        ("picks.cid", picks, "pick_id", "cid", table(spark, sf_dir, "channels"), "cid"),
        ("dt_cc.station", dt, "dt_id", "station", stations, "id"),
    ]
    found = []
    for field, refs, record, key, parents, parent in checks:
        o = orphan_references(refs, parents, record_id=record, key=key, loaded_at="loaded_at", parent_key=parent, parent_loaded_at="loaded_at", parent_deleted_at="deleted_at")
        found.append(o.select(F.lit(field).alias("ref_field"), F.col("record").alias("record_id"), "ref_state", F.date_format("first_loaded_at", "yyyy-MM").alias("load_month")))
    return reduce(DataFrame.unionByName, found)


@query(_P6 + "select * from f where ref_state is not null")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


@query(_P6 + "select ref_field, ref_state, load_month, count(*) as records from f where ref_state is not null group by all")
def p6_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_month(_orphans(spark, sf_dir))
