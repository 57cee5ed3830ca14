"""A project folder: settings and stations as JSON, catalogue in SQLite with JSON records, and packed pick flags."""

from __future__ import annotations

import json
import shutil
import sqlite3
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds between the years 1 and 1970.
_YEAR_ONE = 62_135_596_800_000_000


def flag_fields(flags: Column) -> dict[str, Column]:
    """Fields of packed flags: bits 0-3 phase, 4-7 quality, 8-11 origin, 12-14 polarity, 15 disabled."""
    part = lambda shift, mask: F.shiftrightunsigned(flags, shift).bitwiseAND(mask)
    return {
        "phase": F.when(part(0, 15) == 0, "P").when(part(0, 15) == 1, "S"), "quality": part(4, 15).cast("int"), "origin": F.when(part(8, 15) == 1, "automatic").when(part(8, 15) == 2, "manual").otherwise("catalog"),
        "polarity": part(12, 7).cast("int"), "disabled": part(15, 1).cast("int"),
    }


def ticks_to_timestamp(ticks: Column) -> Column:
    """From tenths of microseconds since the year 1."""
    return F.timestamp_micros(F.floor(ticks / 10).cast("long") - _YEAR_ONE)


def project_folder(path: str) -> Path:
    p = Path(path)
    return p.parent if p.is_file() else p


def read_settings(path: str) -> dict:
    f = project_folder(path) / "project.json"
    if not f.exists():
        raise FileNotFoundError(f"{f} is missing")
    return json.loads(f.read_text(encoding="utf-8"))


def _query(spark: SparkSession, db: Path, sql: str, schema: str) -> DataFrame:
    """A table of the database, in batches of rows: the file belongs to one machine, so its driver reads it."""
    con = sqlite3.connect(f"file:{db}?mode=ro", uri=True)
    try:
        cur, out = con.execute(sql), None
        while rows := cur.fetchmany(200_000):
            d = spark.createDataFrame([tuple(v.decode("utf-8") if isinstance(v, bytes) else v for v in r) for r in rows], schema)
            out = d if out is None else out.unionAll(d)
        return out if out is not None else spark.createDataFrame([], schema)
    finally:
        con.close()


HYPOCENTRE = "struct<OriginTime string, Longitude double, Latitude double, DepthKm double>"


def read_project(spark: SparkSession, path: str, *, catalog_locations: bool = False) -> dict[str, DataFrame]:
    """stations, events (relocated hypocentres where there are any), picks and tstar of a project; missing files give empty tables."""
    folder = project_folder(path)
    st_file, db = folder / "stations.json", folder / "catalog.sqlite"
    st = json.loads(st_file.read_text(encoding="utf-8")) if st_file.exists() else []
    out = {"stations": spark.createDataFrame([(f"{s['Network']}.{s['Code']}", float(s["Longitude"]), float(s["Latitude"]), float(s.get("ElevationM", 0)), float(s.get("CorrectionP", 0)), float(s.get("CorrectionS", 0))) for s in st], "id string, lon double, lat double, elevation_m double, correction_p_s double, correction_s_s double")}
    if not db.exists():
        return out
    e = _query(spark, db, "select rid, ord, data from events", "rid long, ord long, data string")
    e = e.withColumn("d", F.from_json("data", f"struct<Id string, Magnitude double, Catalog {HYPOCENTRE}, Relocated {HYPOCENTRE}>"))
    h = F.col("d.Catalog") if catalog_locations else F.coalesce("d.Relocated", "d.Catalog")
    ev = e.select("rid", "ord", F.col("d.Id").alias("id"), h["OriginTime"].try_cast("timestamp").alias("origin_time"), h["Longitude"].alias("lon"), h["Latitude"].alias("lat"), h["DepthKm"].alias("depth_km"), F.col("d.Magnitude").alias("magnitude"))
    ch = _query(spark, db, "select cid, network, station from channels", "cid long, network string, station string").select("cid", F.concat_ws(".", "network", "station").alias("station"))
    p = _query(spark, db, "select event_rid, seq, cid, time, uncertainty, flags from picks", "event_rid long, seq int, cid long, ticks long, sigma_s double, flags long")
    p = p.withColumns(flag_fields(F.col("flags"))).where(F.col("phase").isNotNull()).join(ev.select(F.col("rid").alias("event_rid"), F.col("id").alias("event")), "event_rid").join(ch, "cid")
    out["events"] = ev.drop("rid", "ord")
    out["picks"] = p.select("event", "station", "phase", ticks_to_timestamp(F.col("ticks")).alias("time"), "sigma_s", "quality", "origin", "disabled", "seq")
    t = _query(spark, db, "select rid, data from tstar", "rid long, data string").withColumn("d", F.from_json("data", "struct<EventId string, StationId string, Phase string, TStar double, Uncertainty double, Disabled boolean>"))
    sigma = F.when(F.col("d.Uncertainty") > 0, F.col("d.Uncertainty")).otherwise(0.005)
    out["tstar"] = t.select(F.col("d.EventId").alias("event"), F.col("d.StationId").alias("station"), F.coalesce("d.Phase", F.lit("P")).alias("phase"), F.col("d.TStar").alias("tstar_s"), sigma.alias("sigma_s"), F.coalesce("d.Disabled", F.lit(False)).alias("disabled"))
    return out


def register_run(path: str, run: str, volumes: list[dict], *, group: str = "") -> int:
    """Copy a run's folder into a project and enter its volumes in the project's list; entries of the same file are replaced.

    `volumes`: dicts with file, name, quantity and units. The files go to the project's volumes folder, the rest of the run to runs/NAME. The former
    project.json is kept beside it as .bak. Gives the number of volumes.
    """
    folder, source = project_folder(path), Path(run)
    settings = folder / "project.json"
    root = read_settings(path)
    files = {Path(v["file"]).resolve() for v in volumes}
    shutil.copytree(source, folder / "runs" / source.name, dirs_exist_ok=True, ignore=lambda d, names: [n for n in names if (Path(d) / n).resolve() in files or n == "volumes"])
    (folder / "volumes").mkdir(exist_ok=True)
    key = next((k for k in root if k.lower() == "volumes"), "Volumes")
    known = root[key] if isinstance(root.get(key), list) else []
    new = []
    for v in volumes:
        shutil.copy2(v["file"], folder / "volumes" / Path(v["file"]).name)
        new.append({"Id": uuid.uuid4().hex, "Name": v["name"], "File": f"volumes/{Path(v['file']).name}", "Quantity": v["quantity"], "Units": v["units"], "CreatedUtc": datetime.now(timezone.utc).isoformat(), "Source": source.name, "Group": group})
    taken = {v["File"] for v in new}
    root[key] = [v for v in known if not (isinstance(v, dict) and v.get("File") in taken)] + new
    part = settings.with_suffix(".tmp")
    part.write_text(json.dumps(root, indent=2), encoding="utf-8")
    shutil.copy2(settings, settings.with_suffix(".json.bak"))
    part.replace(settings)
    return len(new)
