"""Rays through small regions."""

from pyspark.sql import functions as F

from quakespark.functions.geo import to_cartesian
from quakespark.functions.grid import Grid
from quakespark.operators.fields import chord_crosses
from quakespark.plans.tomography import select_observations

BOX = Grid(13.0, 13.2, 42.6, 42.8, 0.0, 10.0, 3, 3, 3)


def test_rays_cross_whatever_their_length(spark):
    rays = [
        (1, 13.1, 42.7, 5.0, 30.0, 42.7, 0.0, True),  # starts inside
        (2, 30.0, 42.7, 0.0, 13.1, 42.7, 5.0, True),  # ends inside
        (3, 13.19, 42.7, 0.0, 14.19, 42.7, 0.0, True),  # leaves at once
        (4, 12.6, 42.7, 0.0, 14.51, 42.7, 0.0, True),  # 157 km, comes through 16 km of it
        (5, 12.9, 42.7, 5.0, 13.3, 42.7, 5.0, True),
        (6, 12.9, 42.9, 5.0, 13.3, 42.9, 5.0, False),
        (7, 13.1, 42.7, 30.0, 13.1, 42.7, 15.0, False),
        (8, 13.1, 38.0, 0.0, 13.1, 47.4, 0.0, False),  # 1,000 km, below it
        (9, 13.1, 42.65, 2.0, 13.1, 51.0, 600.0, True),  # 1,000 km and more, starts inside
        (10, 13.1, 42.55, 2.0, 13.1, 51.0, 20.0, True),  # comes in and leaves within 10 km
    ]
    d = spark.createDataFrame(rays, "id int, lon double, lat double, dep double, lon2 double, lat2 double, dep2 double, want boolean")
    got = d.select("id", "want", chord_crosses(BOX, to_cartesian("lon", "lat", "dep"), to_cartesian("lon2", "lat2", "dep2")).alias("crosses")).collect()
    assert {r["id"]: r["crosses"] for r in got} == {r["id"]: r["want"] for r in got}


def test_outside_observations_must_cross(spark):
    rows = [(1, "IN", 13.1, 42.7, 5.0, 13.15, 42.65, 0.0), (1, "OUT", 13.1, 42.7, 5.0, 14.0, 42.7, 0.0), (2, "THROUGH", 12.8, 42.7, 5.0, 13.4, 42.7, 1000.0), (3, "BESIDE", 12.8, 43.2, 5.0, 13.4, 43.2, 0.0)]
    d = spark.createDataFrame(rows, "event int, station string, ev_lon double, ev_lat double, depth_km double, st_lon double, st_lat double, elevation_m double")
    kept = lambda outside: {r["station"] for r in select_observations(d, BOX, min_phases=1, outside=outside).collect()}
    assert kept("include") == {"IN", "OUT", "THROUGH"} and kept("exclude") == {"IN"}
