"""Regular geographic grids: node numbers, containment and trilinear weights, as Columns and as numpy."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.functions.geo import EARTH_KM, unwrap_longitude


@dataclass(frozen=True)
class Grid:
    """Bounds and numbers of nodes; node number = (k * ny + j) * nx + i, longitude fastest."""

    min_lon: float
    max_lon: float
    min_lat: float
    max_lat: float
    min_depth: float
    max_depth: float
    nx: int
    ny: int
    nz: int

    def __post_init__(self):
        if min(self.nx, self.ny, self.nz) < 2:
            raise ValueError("a grid has two nodes or more along each axis")
        if not (self.min_lon < self.max_lon and self.min_lat < self.max_lat and self.min_depth < self.max_depth):
            raise ValueError("a grid's bounds rise")

    @property
    def nodes(self) -> int:
        return self.nx * self.ny * self.nz

    @property
    def steps(self) -> tuple[float, float, float]:
        """Degrees, degrees, km between nodes."""
        return (self.max_lon - self.min_lon) / (self.nx - 1), (self.max_lat - self.min_lat) / (self.ny - 1), (self.max_depth - self.min_depth) / (self.nz - 1)

    @property
    def spacing_km(self) -> tuple[float, float, float]:
        dx, dy, dz = self.steps
        mid = math.radians((self.min_lat + self.max_lat) / 2)
        km = math.radians(1) * (EARTH_KM - self.min_depth)
        return dx * km * math.cos(mid), dy * km, dz

    @property
    def min_spacing_km(self) -> float:
        return min(self.spacing_km)

    @classmethod
    def from_spacing(cls, min_lon, max_lon, min_lat, max_lat, min_depth, max_depth, horizontal_km, vertical_km) -> Grid:
        km = math.radians(1) * EARTH_KM
        mid = math.cos(math.radians((min_lat + max_lat) / 2))
        n = lambda span, step: max(2, round(span / step) + 1)  # noqa: E731 - half to even
        return cls(min_lon, max_lon, min_lat, max_lat, min_depth, max_depth, n((max_lon - min_lon) * km * mid, horizontal_km), n((max_lat - min_lat) * km, horizontal_km), n(max_depth - min_depth, vertical_km))

    def refined(self, factor: int) -> Grid:
        n = lambda k: (k - 1) * factor + 1
        return Grid(self.min_lon, self.max_lon, self.min_lat, self.max_lat, self.min_depth, self.max_depth, n(self.nx), n(self.ny), n(self.nz))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Grid:
        return cls(**json.loads(text))

    # Columns

    def fractional(self, lon: Column, lat: Column, depth: Column) -> tuple[Column, Column, Column]:
        """Node coordinates, not clamped."""
        dx, dy, dz = self.steps
        x = unwrap_longitude(lon, (self.min_lon + self.max_lon) / 2)
        return (x - self.min_lon) / dx, (lat - self.min_lat) / dy, (depth - self.min_depth) / dz

    def contains(self, lon: Column, lat: Column, depth: Column, tolerance: float = 1e-9) -> Column:
        out = F.lit(True)
        for f, n in zip(self.fractional(lon, lat, depth), (self.nx, self.ny, self.nz)):
            out = out & f.between(-tolerance, n - 1 + tolerance)
        return out

    def corners(self, lon: Column, lat: Column, depth: Column) -> Column:
        """array of 8 struct(node, w): trilinear weights at a point, clamped to the grid."""
        axis = []
        for f, n in zip(self.fractional(lon, lat, depth), (self.nx, self.ny, self.nz)):
            c = F.least(F.greatest(f, F.lit(0.0)), F.lit(float(n - 1)))
            a = F.least(F.floor(c), F.lit(n - 2))
            axis.append((a, c - a))
        out = []
        for k in (0, 1):
            for j in (0, 1):
                for i in (0, 1):
                    w, at = F.lit(1.0), []
                    for (a, t), o in zip(axis, (i, j, k)):
                        w = w * (t if o else 1 - t)
                        at.append(a + o)
                    node = (at[2] * self.ny + at[1]) * self.nx + at[0]
                    out.append(F.struct(node.cast("int").alias("node"), w.alias("w")))
        return F.array(*out)

    def node_table(self, spark: SparkSession) -> DataFrame:
        """(node, i, j, k, lon, lat, depth_km) of every node."""
        dx, dy, dz = self.steps
        d = spark.range(self.nodes).select(F.col("id").cast("int").alias("node"))
        d = d.withColumn("i", F.col("node") % self.nx).withColumn("j", F.floor(F.col("node") / self.nx).cast("int") % self.ny).withColumn("k", F.floor(F.col("node") / (self.nx * self.ny)).cast("int"))
        return d.select("node", "i", "j", "k", (self.min_lon + F.col("i") * dx).alias("lon"), (self.min_lat + F.col("j") * dy).alias("lat"), (self.min_depth + F.col("k") * dz).alias("depth_km"))

    # numpy

    def axes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.linspace(self.min_lon, self.max_lon, self.nx), np.linspace(self.min_lat, self.max_lat, self.ny), np.linspace(self.min_depth, self.max_depth, self.nz)

    def weights(self, lon: np.ndarray, lat: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 8) nodes and trilinear weights, clamped."""
        dx, dy, dz = self.steps
        centre = (self.min_lon + self.max_lon) / 2
        lon = lon - 360 * np.floor((lon - centre + 180) / 360)
        at, part = [], []
        for f, n in (((lon - self.min_lon) / dx, self.nx), ((lat - self.min_lat) / dy, self.ny), ((depth - self.min_depth) / dz, self.nz)):
            c = np.clip(f, 0, n - 1)
            a = np.minimum(np.floor(c), n - 2).astype(np.int64)
            at.append(a)
            part.append(c - a)
        first = (at[2] * self.ny + at[1]) * self.nx + at[0]
        (x, y, z) = ((1 - p, p) for p in part)
        nodes, ws = np.empty((len(first), 8), np.int64), np.empty((len(first), 8))
        for j in (0, 1):
            for i in (0, 1):
                xy = x[i] * y[j]
                for k in (0, 1):
                    c = 4 * k + 2 * j + i
                    np.add(first, (k * self.ny + j) * self.nx + i, out=nodes[:, c])
                    np.multiply(xy, z[k], out=ws[:, c])
        return nodes, ws

    def interpolate(self, values: np.ndarray, lon: np.ndarray, lat: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Values at points; nodes without data (NaN) are left out where the others weigh more than half."""
        n, w = self.weights(np.asarray(lon, float), np.asarray(lat, float), np.asarray(depth, float))
        v = values.ravel()[n]
        bad = np.isnan(v)
        if bad.any():
            ww = np.where(bad, 0.0, w)
            total = ww.sum(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(total > 0.5, (np.where(bad, 0.0, v) * ww).sum(1) / total, np.nan)
        return (v * w).sum(1)

    def resample(self, values: np.ndarray, to: Grid) -> np.ndarray:
        x, y, z = to.axes()
        zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
        return self.interpolate(values, xx.ravel(), yy.ravel(), zz.ravel())


def interpolate_table(points: DataFrame, grid: Grid, values: DataFrame, *, lon: str, lat: str, depth: str, key: str, node: str = "node", value: str = "value") -> DataFrame:
    """(key, value): trilinear value at each point from a table of node values; nodes without data are left out where the others weigh
    more than half. Join on node numbers; the table's size, not the caller, decides whether it is broadcast."""
    c = points.select(F.col(key).alias("p"), F.explode(grid.corners(F.col(lon), F.col(lat), F.col(depth))).alias("c")).select("p", "c.node", "c.w")
    v = values.select(F.col(node).alias("node"), F.when(~F.isnan(F.col(value)), F.col(value)).alias("v"))
    j = c.join(v, "node", "left").groupBy("p").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("ww"), F.sum(F.col("v") * F.col("w")).alias("s"))
    return j.select(F.col("p").alias(key), F.when(F.col("ww") > 0.5, F.col("s") / F.col("ww")).alias("value"))
