"""QuakeML and StationXML: files are parsed event by event (station by station) in tasks; elements are matched by local name."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark.common import Scratch
from quakespark.operators.catalog import phase_of


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for p in path:
        e = next((c for c in e if _name(c) == p), None) if e is not None else None
    return e


def _text(e: ET.Element | None, *path: str) -> str | None:
    c = _child(e, *path)
    return c.text.strip() if c is not None and c.text and c.text.strip() else None


def _float(e: ET.Element | None, *path: str) -> float | None:
    t = _text(e, *path)
    try:
        return float(t) if t else None
    except ValueError:
        return None


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e if _name(c) == name]


def clean_id(resource: str) -> str:
    """The last part of a resource name, of letters, digits, dots, dashes and underscores."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", re.split(r"[/=#]", resource.rstrip("/"))[-1])


def _quality(weight: float | None, largest: float) -> int:
    if weight is None:
        return 0
    w = weight / 100 if largest > 1 else weight
    return 0 if w > 0.8 else 1 if w > 0.6 else 2 if w > 0.4 else 3 if w > 0.2 else 4


def parse_quakeml(data: bytes) -> tuple[list[dict], list[dict]]:
    """(events, picks): preferred origin and magnitude, else the first; picks that the preferred origin uses, or all where it names none."""
    events, picks = [], []
    for _, ev in ET.iterparse(io.BytesIO(data), events=("end",)):
        if _name(ev) != "event":
            continue
        chosen = {}
        for kind, pref in (("origin", "preferredOriginID"), ("magnitude", "preferredMagnitudeID")):
            found = _all(ev, kind)
            wanted = _text(ev, pref)
            chosen[kind] = next((c for c in found if c.get("publicID") == wanted), found[0] if found else None)
        o = chosen["origin"]
        if o is not None:
            eid = clean_id(ev.get("publicID") or "")
            depth = _float(o, "depth", "value")
            events.append({"id": eid, "time": _text(o, "time", "value"), "lon": _float(o, "longitude", "value"), "lat": _float(o, "latitude", "value"), "depth_km": (depth or 0.0) / 1000, "magnitude": _float(chosen["magnitude"], "mag", "value")})
            arrivals: dict[str, ET.Element] = {}
            for a in _all(o, "arrival"):
                if (k := _text(a, "pickID")) is not None:
                    arrivals.setdefault(k, a)
            weights = [w for a in arrivals.values() if (w := _float(a, "timeWeight")) is not None]
            largest = max(weights, default=1.0)
            for p in _all(ev, "pick"):
                a = arrivals.get(p.get("publicID") or "")
                if arrivals and a is None:
                    continue
                w = _child(p, "waveformID")
                low, high = _float(p, "time", "lowerUncertainty"), _float(p, "time", "upperUncertainty")
                sigma = _float(p, "time", "uncertainty")
                picks.append({
                    "event": eid, "station": f"{w.get('networkCode', '') if w is not None else ''}.{w.get('stationCode', '') if w is not None else ''}".strip("."), "label": _text(a, "phase") or _text(p, "phaseHint"), "time": _text(p, "time", "value"),
                    "sigma_s": sigma if sigma is not None else (low + high) / 2 if low is not None and high is not None else None, "quality": _quality(_float(a, "timeWeight") if a is not None else None, largest),
                    "origin": {"automatic": "automatic", "manual": "manual"}.get(_text(p, "evaluationMode") or "", "catalog"),
                })
        ev.clear()
    return events, picks


def read_quakeml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, picks) of all files at a path (a folder or pattern): one file is one unit of work, parsed once. Times as timestamps, phases as P or S."""
    fields = [
        "id string, lon double, lat double, depth_km double, magnitude double, time string".split(", "),
        "event string, station string, label string, time string, sigma_s double, quality int, origin string".split(", "),
    ]
    schema = list(dict.fromkeys(fields[0] + fields[1]))
    names = [f.split()[0] for f in schema]

    def run(batches):
        for b in batches:
            for f, c in zip(b["path"], b["content"]):
                for kind, rows in enumerate(parse_quakeml(c)):
                    if rows:
                        yield pd.DataFrame({"kind": kind, "file": f, "ordinal": range(len(rows)), **{c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    both = Scratch(spark, "quakeml").keep(files.mapInPandas(run, "kind int, file string, ordinal int, " + ", ".join(schema)))
    e = both.where("kind = 0").select("id", "time", "lon", "lat", "depth_km", "magnitude", "file", "ordinal")
    w = Window.partitionBy("id").orderBy("file", "ordinal")
    e = e.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", F.col("time").try_cast("timestamp").alias("origin_time"), "lon", "lat", "depth_km", "magnitude")
    p = both.where("kind = 1").withColumn("phase", phase_of("label")).where(F.col("phase").isNotNull())
    sigma = F.coalesce("sigma_s", F.when(F.col("phase") == "P", 0.1).otherwise(0.2))
    return e, p.select("event", "station", "phase", F.col("time").try_cast("timestamp").alias("time"), sigma.alias("sigma_s"), "quality", "origin", F.lit(0).alias("disabled"), F.col("ordinal").alias("seq"))


CHANNEL = "network string, station string, location string, channel string, lon double, lat double, elevation_m double, start string, end string, azimuth double, dip double, rate double, gain double, units string, poles array<double>, zeros array<double>, fir array<double>, symmetric boolean, file string, ordinal int"


def parse_stationxml(data: bytes) -> list[dict]:
    """Channel epochs. Poles and zeros as flat (real, imaginary) lists; the gain is the product of stage gains if all stages have one, else the
    overall sensitivity; half-given FIR coefficients are completed."""
    out = []
    root = ET.parse(io.BytesIO(data)).getroot()
    for net in _all(root, "Network"):
        for st in _all(net, "Station"):
            for ch in _all(st, "Channel"):
                resp = _child(ch, "Response")
                stages = _all(resp, "Stage") if resp is not None else []
                gains = [_float(s, "StageGain", "Value") for s in stages]
                poles, zeros, fir, symmetric, norm = [], [], [], False, 1.0
                units = _text(resp, "InstrumentSensitivity", "InputUnits", "Name") if resp is not None else None
                for s in stages:
                    pz = _child(s, "PolesZeros")
                    if pz is not None and not poles and not zeros:
                        pair = lambda e: [_float(e, "Real") or 0.0, _float(e, "Imaginary") or 0.0]
                        poles = [v for e in _all(pz, "Pole") for v in pair(e)]
                        zeros = [v for e in _all(pz, "Zero") for v in pair(e)]
                        norm = _float(pz, "NormalizationFactor") or 1.0
                        units = units or _text(pz, "InputUnits", "Name")
                    f = _child(s, "FIR")
                    if f is not None:
                        half = [float(c.text) for c in _all(f, "NumeratorCoefficient")]
                        kind = (_text(f, "Symmetry") or "NONE").upper()
                        whole = half + half[::-1] if kind == "EVEN" else half + half[-2::-1] if kind == "ODD" else half
                        fir, symmetric = whole, kind != "NONE"
                total = 1.0
                for g in gains:
                    total *= g if g is not None else float("nan")
                gain = total if gains and total == total else _float(resp, "InstrumentSensitivity", "Value") if resp is not None else None
                place = lambda k: _float(ch, k) if _float(ch, k) is not None else _float(st, k)
                out.append({
                    "network": net.get("code"), "station": st.get("code"), "location": (ch.get("locationCode") or "").strip(), "channel": ch.get("code"), "lon": place("Longitude"), "lat": place("Latitude"), "elevation_m": place("Elevation"), "start": ch.get("startDate"), "end": ch.get("endDate"),
                    "azimuth": _float(ch, "Azimuth"), "dip": _float(ch, "Dip"), "rate": _float(ch, "SampleRate"), "gain": (gain or 1.0) * norm, "units": units, "poles": poles, "zeros": zeros, "fir": fir, "symmetric": symmetric,
                })
    return out


def read_stationxml(spark: SparkSession, path: str) -> DataFrame:
    """Channel epochs of all files, with start and end as timestamps."""
    names = [c.split()[0] for c in CHANNEL.split(", ")]

    def run(batches):
        for b in batches:
            for f, c in zip(b["path"], b["content"]):
                yield pd.DataFrame([{**r, "file": f, "ordinal": i} for i, r in enumerate(parse_stationxml(c))], columns=names)

    d = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CHANNEL)
    return d.withColumns({"start": F.col("start").try_cast("timestamp"), "end": F.col("end").try_cast("timestamp")})


def station_coordinates(channels: DataFrame) -> DataFrame:
    """Coordinates of each station in its latest epoch; of equal ones the later row."""
    last = F.max_by(F.struct("lon", "lat", "elevation_m"), F.struct("start", "file", "ordinal"))
    return channels.groupBy(F.concat_ws(".", "network", "station").alias("id")).agg(last.alias("c")).select("id", "c.lon", "c.lat", "c.elevation_m")
