"""Catalogue views (stations, events, picks) over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quakespark.common import table

ST = """select s_suppkey as station,
  cast(12.5 as double)+cast((s_suppkey*37) % 100 as double)*0.012 as st_lon,
  cast(42.3 as double)+cast((s_suppkey*53) % 100 as double)*0.01 as st_lat,
  cast((s_suppkey*71) % 1500 as double) as elevation_m from supplier"""
EV = """select o_orderkey as event, o_orderdate as origin_time,
  cast(12.75 as double)+cast((o_orderkey*29) % 950 as double)*0.001 as ev_lon,
  cast(42.35 as double)+cast((o_orderkey*31) % 850 as double)*0.001 as ev_lat,
  cast(2 as double)+cast((o_orderkey*17) % 140 as double)*0.1 as depth_km,
  cast(1.5 as double)+cast((o_orderkey*7) % 40 as double)*0.1 as magnitude from orders"""
PK = """select l_orderkey as event, l_suppkey as station,
  case when l_partkey % 2 = 0 then 'P' else 'S' end as phase, l_linenumber as seq,
  cast(1 as double)+cast((l_partkey*13+l_suppkey*7+l_linenumber) % 9000 as double)*0.001 as travel_time_s,
  cast(0.02 as double)+cast(cast(l_quantity as bigint) % 10 as double)*0.01 as sigma_s,
  cast(cast(l_quantity as bigint) % 5 as int) as quality,
  case l_returnflag when 'A' then 'manual' when 'R' then 'automatic' else 'catalog' end as origin,
  case when cast(l_tax*100 as bigint) = 8 then 1 else 0 end as disabled, l_partkey from lineitem"""
#: Distances and times that a straight ray explains, with noise and gross outliers.
PHYS = """select pk.*, st.st_lon, st.st_lat, st.elevation_m, ev.ev_lon, ev.ev_lat, ev.depth_km, ev.magnitude,
  sqrt(power((6371-depth_km)*cos(radians(ev_lat))*cos(radians(ev_lon)) - (6371+elevation_m/1000)*cos(radians(st_lat))*cos(radians(st_lon)), 2)
   + power((6371-depth_km)*cos(radians(ev_lat))*sin(radians(ev_lon)) - (6371+elevation_m/1000)*cos(radians(st_lat))*sin(radians(st_lon)), 2)
   + power((6371-depth_km)*sin(radians(ev_lat)) - (6371+elevation_m/1000)*sin(radians(st_lat)), 2)) as path_km
  from pk join ev on pk.event = ev.event join st on pk.station = st.station"""
AR = """select *, path_km / case when phase = 'P' then 6.0 else 3.46 end as predicted_s,
  cast((l_partkey*13+seq) % 200 - 100 as double)*0.001 + case when l_partkey % 51 = 0 then 8.0 else 0.0 end as noise_s from phys"""

#: WITH clause of all views, for SQL.
WITH = f"with st as ({ST}), ev as ({EV}), pk as ({PK}), phys as ({PHYS}), ar as ({AR})"


def _sql(spark: SparkSession, sf_dir: str, text: str, names: list[str]) -> DataFrame:
    return spark.sql(text.replace("from supplier", "from {supplier}").replace("from orders", "from {orders}").replace("from lineitem", "from {lineitem}"), **{n: table(spark, sf_dir, n) for n in names})


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ST, ["supplier"])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EV, ["orders"])


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PK, ["lineitem"])


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks with event and station, path_km, predicted_s and noise_s (the residual)."""
    return _sql(spark, sf_dir, f"{WITH} select * from ar", ["supplier", "orders", "lineitem"])
