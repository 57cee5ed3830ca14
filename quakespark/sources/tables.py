"""Delimited catalogue tables: columns by name with aliases, typed cells, and errors that name file and value."""

from __future__ import annotations

import csv
import io
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark.operators.catalog import phase_of

#: Accepted names of columns.
ALIASES = {
    "lon": ["lon", "longitude"], "lat": ["lat", "latitude"], "depth_km": ["depth_km", "depth"], "time": ["time", "origin_time", "datetime"], "magnitude": ["magnitude", "mag"], "event": ["event", "event_id"],
    "station": ["station", "station_id", "sta"], "phase": ["phase", "phase_hint"], "sigma_s": ["sigma_s", "sigma", "uncertainty"], "tstar_s": ["tstar_s", "tstar"], "elevation_m": ["elevation_m", "elevation"],
}


def separator(header: str) -> str:
    return "\t" if "\t" in header else ";" if ";" in header and "," not in header else ","


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names in lower case. The separator is taken from the header line (the first that is neither blank nor a comment);
    only that line is read on the driver."""
    for r in spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).limit(1).collect():
        head = r["value"].lstrip("﻿")
        break
    else:
        raise ValueError(f"{path}: no header")
    sep = separator(head)
    names = [c.strip().lower() for c in next(csv.reader(io.StringIO(head), delimiter=sep))]
    d = spark.read.option("sep", sep).option("header", True).option("comment", "#").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE").csv(path)
    return d.toDF(*names[: len(d.columns)])


def column(df: DataFrame, name: str, required: bool = False) -> Column | None:
    """The first column present among a name's aliases."""
    for a in ALIASES.get(name, [name]):
        if a in df.columns:
            return F.col(a)
    if required:
        raise ValueError(f"none of the columns {ALIASES.get(name, [name])} is there; there are {df.columns}")
    return None


def number(c: Column, default: float | None = None, where: str = "") -> Column:
    """A number; blank is the default, 'nan' is null, anything else that is none raises an error that names it."""
    t = F.trim(c)
    bad = F.raise_error(F.concat(F.lit(f"{where}: not a number: "), t)).cast("double")
    return F.when(t.isNull() | (t == ""), F.lit(default).cast("double")).when(F.lower(t) == "nan", F.lit(None).cast("double")).when(t.try_cast("double").isNotNull(), t.try_cast("double")).otherwise(bad)


def timestamp(c: Column, where: str = "") -> Column:
    """ISO 8601 (UTC) or seconds since 1970; blank is null, anything else raises an error that names it."""
    t = F.trim(c)
    bad = F.raise_error(F.concat(F.lit(f"{where}: not a time: "), t)).cast("timestamp")
    epoch, iso = t.try_cast("double"), t.try_cast("timestamp")
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("timestamp")).when(epoch.isNotNull() & ~F.isnan(epoch), F.timestamp_micros(F.round(epoch * 1e6).cast("long"))).when(iso.isNotNull(), iso).otherwise(bad)


def flag(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y"), F.lit(False))


def _or(df: DataFrame, name: str, default: float | None, path: str) -> Column:
    c = column(df, name)
    return F.lit(default).cast("double") if c is None else number(c, default, path)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    d = read_table(spark, path)
    sid = column(d, "id")
    sid = sid if sid is not None else F.concat_ws(".", column(d, "network", True), column(d, "station", True))
    elevation = _or(d, "elevation_m", None, path)
    if column(d, "elevation_m") is None and column(d, "depth_km") is not None:
        elevation = -1000 * number(column(d, "depth_km"), 0.0, path)
    return d.select(F.trim(sid).alias("id"), _or(d, "lon", None, path).alias("lon"), _or(d, "lat", None, path).alias("lat"), F.coalesce(elevation, F.lit(0.0)).alias("elevation_m"), _or(d, "correction_p_s", 0.0, path).alias("correction_p_s"), _or(d, "correction_s_s", 0.0, path).alias("correction_s_s"))


def read_events(spark: SparkSession, path: str, *, check: bool = True) -> DataFrame:
    """Events; an id that occurs twice is an error."""
    d = read_table(spark, path)
    e = d.select(F.trim(column(d, "id", True)).alias("id"), timestamp(column(d, "time", True), path).alias("origin_time"), *[number(column(d, c, True), None, path).alias(c) for c in ("lon", "lat", "depth_km")], _or(d, "magnitude", None, path).alias("magnitude"), (flag(column(d, "fixed")) if column(d, "fixed") is not None else F.lit(False)).alias("fixed"))
    if check and (twice := e.groupBy("id").count().where("count > 1").limit(1).collect()):
        raise ValueError(f"{path}: event {twice[0]['id']} occurs twice")
    return e


def read_picks(spark: SparkSession, path: str, events: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(picks of known events and phases, counts of rows left out). Times are absolute or travel times."""
    d = read_table(spark, path).withColumn("_seq", F.monotonically_increasing_id())
    ph = phase_of(F.trim(column(d, "phase", True)))
    tt = number(column(d, "travel_time_s"), None, path) if column(d, "travel_time_s") is not None else F.lit(None).cast("double")
    at = timestamp(column(d, "time"), path) if column(d, "time") is not None else F.lit(None).cast("timestamp")
    o = F.lower(F.trim(column(d, "origin"))) if column(d, "origin") is not None else F.lit("catalog")
    p = d.select(
        F.trim(column(d, "event", True)).alias("event"), F.trim(column(d, "station", True)).alias("station"), ph.alias("phase"), at.alias("_at"), tt.alias("_tt"), _or(d, "sigma_s", None, path).alias("_sigma"), _or(d, "quality", 0.0, path).cast("int").alias("quality"),
        F.when(o.isin("m", "manual"), "manual").when(o.isin("a", "auto", "automatic"), "automatic").otherwise("catalog").alias("origin"), (flag(column(d, "disabled")) if column(d, "disabled") is not None else F.lit(False)).cast("int").alias("disabled"), "_seq",
    )
    e = events.select(F.col("id").alias("event"), "origin_time")
    known = p.where(F.col("phase").isNotNull()).join(e, "event")
    counts = {"later_phases": p.where(F.col("phase").isNull()).count(), "unknown_events": p.where(F.col("phase").isNotNull()).join(e, "event", "left_anti").count()}
    t = F.coalesce("_at", F.timestamp_micros(F.unix_micros("origin_time") + F.round(F.col("_tt") * 1e6).cast("long")))
    tt2 = F.coalesce("_tt", (F.unix_micros("_at") - F.unix_micros("origin_time")) / 1e6)
    sigma = F.coalesce("_sigma", F.when(F.col("phase") == "P", 0.1).otherwise(0.2))
    return known.select("event", "station", "phase", t.alias("time"), tt2.alias("travel_time_s"), sigma.alias("sigma_s"), "quality", "origin", "disabled", F.col("_seq").alias("seq")), counts


def read_tstar(spark: SparkSession, path: str) -> DataFrame:
    d = read_table(spark, path)
    ph = F.coalesce(phase_of(F.trim(column(d, "phase"))), F.lit("P")) if column(d, "phase") is not None else F.lit("P")
    return d.select(F.trim(column(d, "event", True)).alias("event"), F.trim(column(d, "station", True)).alias("station"), ph.alias("phase"), number(column(d, "tstar_s", True), None, path).alias("tstar_s"), _or(d, "sigma_s", 0.005, path).alias("sigma_s"), (flag(column(d, "disabled")) if column(d, "disabled") is not None else F.lit(False)).alias("disabled"))


def read_polarities(spark: SparkSession, path: str) -> DataFrame:
    """Readings with a polarity, in file order (`ordinal`)."""
    d = read_table(spark, path)
    manual = number(column(d, "manual"), 1.0, path) if column(d, "manual") is not None else F.lit(1.0)
    p = d.select(F.trim(column(d, "event", True)).alias("event"), F.trim(column(d, "station", True)).alias("station"), *[number(F.col(c), None, path).alias(c) for c in ("polarity", "azimuth", "takeoff")], manual.cast("int").alias("manual"), F.monotonically_increasing_id().alias("ordinal"))
    return p.where(F.col("polarity").isNotNull() & (F.col("polarity") != 0))


def read_mechanisms(spark: SparkSession, path: str, *, qualities: list[str] | None = None, start: str | None = None, end: str | None = None, centre: tuple[float, float, float] | None = None) -> DataFrame:
    """Mechanisms, filtered while scanning: qualities, [start, end) as ISO text, and (lon, lat, km) around a centre."""
    from quakespark.functions.geo import distance_km

    d = read_table(spark, path)
    for c in ("lon", "lat", "depth_km", "strike1", "dip1", "rake1", "strike2", "dip2", "rake2", "uncert_deg"):
        if c in d.columns:
            d = d.withColumn(c, number(F.col(c), None, path))
    if qualities:
        d = d.where(F.col("quality").isin(qualities))
    if start:
        d = d.where(F.col("time") >= start)
    if end:
        d = d.where(F.col("time") < end)
    return d.where(distance_km(centre[0], centre[1], "lon", "lat") <= centre[2]) if centre else d


def read_receivers(spark: SparkSession, path: str) -> DataFrame:
    d = read_table(spark, path)
    return d.select(F.col("id"), *[number(F.col(c), None, path).alias(n) for c, n in (("lat", "lat"), ("lon", "lon"), ("depth", "depth_km"), ("strike", "strike"), ("dip", "dip"), ("rake", "rake"))])


def read_cc_times(spark: SparkSession, path: str) -> DataFrame:
    """Cross-correlation times by position; rows that do not parse are dropped; a missing file is an empty table."""
    schema = "event_a string, event_b string, station string, phase string, arrival_difference_s double, lag_s double, cc double"
    if path.startswith("/") and not Path(path).exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def write_table(df: DataFrame, path: str, *, order: list[str] = (), one_file: bool = True) -> None:
    """Comma-separated, times to a tenth of a millisecond. `one_file` suits tables for people; large ones are written in parts."""
    for f in df.schema:
        if f.dataType.simpleString().startswith("timestamp"):
            df = df.withColumn(f.name, F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSS'Z'"))
        elif f.dataType.simpleString().startswith("array"):
            df = df.withColumn(f.name, F.array_join(F.col(f.name).cast("array<string>"), " "))
    df = df.orderBy(*order) if order else df
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def first_of_file(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
