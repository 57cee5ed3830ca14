"""Geography on a sphere as Column expressions: all stay inside code generation.

Latitude counts as geocentric, depth in km is positive downwards, longitudes may be written in any range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

Number = Column | str | float


def _c(x: Number) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def to_cartesian(lon: Number, lat: Number, depth_km: Number) -> Column:
    """struct(x, y, z) in km, from the centre of the sphere."""
    lo, la, r = F.radians(_c(lon)), F.radians(_c(lat)), EARTH_KM - _c(depth_km)
    return F.struct((r * F.cos(la) * F.cos(lo)).alias("x"), (r * F.cos(la) * F.sin(lo)).alias("y"), (r * F.sin(la)).alias("z"))


def from_cartesian(p: Column) -> Column:
    """struct(lon, lat, depth_km) of struct(x, y, z)."""
    r = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
    return F.struct(F.degrees(F.atan2(p["y"], p["x"])).alias("lon"), F.degrees(F.asin(p["z"] / r)).alias("lat"), (EARTH_KM - r).alias("depth_km"))


def chord_km(a: Column, b: Column) -> Column:
    """Straight distance of two Cartesian structs."""
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + F.pow(a["z"] - b["z"], 2))


def angular_distance(lon1: Number, lat1: Number, lon2: Number, lat2: Number) -> Column:
    """Haversine distance in radians."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def distance_km(lon1: Number, lat1: Number, lon2: Number, lat2: Number) -> Column:
    return EARTH_KM * angular_distance(lon1, lat1, lon2, lat2)


def azimuth(lon1: Number, lat1: Number, lon2: Number, lat2: Number) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    p1, p2, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lon: Number, lat: Number, azimuth_deg: Number, km: Number) -> Column:
    """struct(lon, lat) at a distance along an azimuth."""
    p, a, d = F.radians(_c(lat)), F.radians(_c(azimuth_deg)), _c(km) / EARTH_KM
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(a))
    lon2 = F.radians(_c(lon)) + F.atan2(F.sin(a) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.struct(normalize_longitude(F.degrees(lon2)).alias("lon"), F.degrees(q).alias("lat"))


def intermediate(lon1: Number, lat1: Number, lon2: Number, lat2: Number, fraction: Number) -> Column:
    """struct(lon, lat) on the great circle, at a fraction of the way."""
    d, f = angular_distance(lon1, lat1, lon2, lat2), _c(fraction)
    near = d < 1e-12
    a = F.when(near, 1 - f).otherwise(F.sin((1 - f) * d) / F.sin(d))
    b = F.when(near, f).otherwise(F.sin(f * d) / F.sin(d))
    p1, p2, l1, l2 = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon1)), F.radians(_c(lon2))
    x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
    y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"))


def normalize_longitude(lon: Number) -> Column:
    """Into -180 (included) to 180."""
    return F.pmod(_c(lon) + 180, F.lit(360.0)) - 180


def unwrap_longitude(lon: Number, centre: Number) -> Column:
    """The longitude within 180 degrees of `centre`."""
    return _c(lon) - 360 * F.floor((_c(lon) - _c(centre) + 180) / 360)


def compass(azimuth_deg: Number) -> Column:
    """One of 16 points."""
    points = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
    at = F.pmod(F.floor(_c(azimuth_deg) / 22.5 + 0.5), F.lit(16)).cast("int")
    return F.element_at(F.array(*[F.lit(p) for p in points]), at + 1)


def crosses_antimeridian(min_lon: Number, max_lon: Number) -> Column:
    """Ranges of longitude to draw: one, or two on each side of 180 degrees."""
    a, b = normalize_longitude(min_lon), normalize_longitude(max_lon)
    one = lambda x, y: F.struct(x.alias("min_lon"), y.alias("max_lon"))
    return F.when(a <= b, F.array(one(a, b))).otherwise(F.array(one(a, F.lit(180.0)), one(F.lit(-180.0), b)))


def in_box(lon: Number, lat: Number, min_lon: float, max_lon: float, min_lat: float, max_lat: float) -> Column:
    """Containment, the longitude unwrapped to the box's centre."""
    x = unwrap_longitude(lon, (min_lon + max_lon) / 2)
    return x.between(min_lon, max_lon) & _c(lat).between(min_lat, max_lat)


def local_offset(lon0: Number, lat0: Number, lon: Number, lat: Number) -> Column:
    """struct(east_km, north_km) in the plane that touches the sphere at (lon0, lat0)."""
    d, a = distance_km(lon0, lat0, lon, lat), F.radians(azimuth(lon0, lat0, lon, lat))
    return F.struct((d * F.sin(a)).alias("east_km"), (d * F.cos(a)).alias("north_km"))


def _plain(x: Column, digits: int) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", x), r"\.?0+$", "")


def format_longitude(lon: Number, digits: int = 4) -> Column:
    """With its hemisphere: 12.3°E; 180° is east."""
    x = normalize_longitude(lon)
    x = F.when(x == -180, F.lit(180.0)).otherwise(x)
    return F.concat(_plain(F.abs(x), digits), F.when(x < 0, "°W").otherwise("°E"))


def format_latitude(lat: Number, digits: int = 4) -> Column:
    return F.concat(_plain(F.abs(_c(lat)), digits), F.when(_c(lat) < 0, "°S").otherwise("°N"))


def longitude_ranges(low: Number, high: Number) -> Column:
    """One or two structs (low, high) inside -180..180 that make a range of longitudes, also one across the antimeridian."""
    a, z = _c(low), _c(high)
    z = F.when(z < a, z + 360 * F.ceil((a - z) / 360)).otherwise(z)
    west = normalize_longitude(a)
    east = west + (z - a)
    part = lambda x, y: F.struct(x.cast("double").alias("low"), y.cast("double").alias("high"))
    whole = F.array(part(F.lit(-180.0), F.lit(180.0)))
    return F.when(z - a >= 360, whole).when(east <= 180, F.array(part(west, east))).otherwise(F.array(part(west, F.lit(180.0)), part(F.lit(-180.0), east - 360)))
