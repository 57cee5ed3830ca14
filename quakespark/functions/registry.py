"""Functions for SQL text: registered as SQL functions, so that Catalyst sees their expressions and no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALARS = {
    "qs_distance_km": ("lon1 double, lat1 double, lon2 double, lat2 double", "double", "2 * 6371 * asin(least(1.0D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "qs_azimuth": ("lon1 double, lat1 double, lon2 double, lat2 double", "double", "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360, 360D)"),
    "qs_normalize_lon": ("lon double", "double", "pmod(lon + 180, 360D) - 180"),
    "qs_unwrap_lon": ("lon double, centre double", "double", "lon - 360 * floor((lon - centre + 180) / 360)"),
    "qs_x": ("lon double, lat double, depth_km double", "double", "(6371 - depth_km) * cos(radians(lat)) * cos(radians(lon))"),
    "qs_y": ("lon double, lat double, depth_km double", "double", "(6371 - depth_km) * cos(radians(lat)) * sin(radians(lon))"),
    "qs_z": ("lat double, depth_km double", "double", "(6371 - depth_km) * sin(radians(lat))"),
    "qs_phase": ("label string", "string", "case when label in ('P','Pg','Pn','Pb','P*','Pp','PG','PN','p') then 'P' when label in ('S','Sg','Sn','Sb','S*','SG','SN','s') then 'S' end"),
    "qs_origin_rank": ("origin string", "int", "case origin when 'manual' then 0 when 'automatic' then 2 else 1 end"),
    "qs_usable": ("disabled int, quality int, sigma_s double", "boolean", "coalesce(disabled = 0 and quality < 4 and sigma_s > 0 and not isnan(sigma_s) and sigma_s < double('infinity'), false)"),
    "qs_tricube": ("x double, limit_ double", "double", "case when abs(x / limit_) < 1 then pow(1 - pow(abs(x / limit_), 3), 3) else 0D end"),
    "qs_corner_hz": ("magnitude double, stress_mpa double", "double", "0.37D * 3500 * cbrt(16 * stress_mpa * 1e6D / (7 * pow(10D, 1.5D * magnitude + 9.1D)))"),
    "qs_moment": ("magnitude double", "double", "pow(10D, 1.5D * magnitude + 9.1D)"),
    "qs_pick_field": ("flags bigint, first_bit int, bits int", "bigint", "shiftrightunsigned(flags, first_bit) & (shiftleft(1L, bits) - 1)"),
}
TABLES = {
    "qs_grid_nodes": (
        "min_lon double, max_lon double, min_lat double, max_lat double, min_depth double, max_depth double, nx int, ny int, nz int", "node int, lon double, lat double, depth_km double",
        "select cast(id as int), min_lon + id % nx * (max_lon - min_lon) / (nx - 1), min_lat + id div nx % ny * (max_lat - min_lat) / (ny - 1), min_depth + id div (nx * ny) * (max_depth - min_depth) / (nz - 1) from (select explode(sequence(0, nx * ny * nz - 1)) as id)",
    ),
    "qs_ray_points": (
        "x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, piece_km double", "i int, x double, y double, z double, km double",
        "select i, x1 + (i + 0.5D) / n * (x2 - x1), y1 + (i + 0.5D) / n * (y2 - y1), z1 + (i + 0.5D) / n * (z2 - z1), d / n from (select d, n, explode(sequence(0, n - 1)) as i from (select d, cast(greatest(1, ceil(d / piece_km)) as int) as n from (select sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2) + pow(z2 - z1, 2)) as d)))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session's SQL; gives their names."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    for name, (args, kind, body) in TABLES.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns table({kind}) return {body}")
    return [*SCALARS, *TABLES]
