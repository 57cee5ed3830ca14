"""Volumes (gridded fields), rays and matrices on disk, and their exports."""

from __future__ import annotations

import json
import math
import os
import struct
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.functions.geo import EARTH_KM
from quakespark.functions.grid import Grid

#: The first bytes of the formats.
VOLUME, RAYS, MATRIX = b"QVOL\x01\0\0\0", b"QRAY", b"QCSR"
_KEYS = {"min_lon": "MinLon", "max_lon": "MaxLon", "min_lat": "MinLat", "max_lat": "MaxLat", "min_depth": "MinDepthKm", "max_depth": "MaxDepthKm", "nx": "Nx", "ny": "Ny", "nz": "Nz"}


def _atomic(path: str, *parts: bytes) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".tmp", "wb") as f:
        for p in parts:
            f.write(p)
    os.replace(path + ".tmp", path)


def write_volume(path: str, grid: Grid, values: np.ndarray, **header) -> None:
    """Magic, header length, JSON header, zeros up to 64 bytes, float32 with longitude fastest."""
    v = np.asarray(values, float).ravel()
    if len(v) != grid.nodes:
        raise ValueError(f"{len(v)} values for {grid.nodes} nodes")
    ok = v[np.isfinite(v)]
    h = {"Name": "", "Quantity": "", "Units": "", "Source": "", **header, "Grid": {b: getattr(grid, a) for a, b in _KEYS.items()}, "NoData": "NaN", "Min": float(ok.min()) if len(ok) else "NaN", "Max": float(ok.max()) if len(ok) else "NaN"}
    text = json.dumps(h).encode()
    start = len(VOLUME) + 4 + len(text)
    _atomic(path, VOLUME, struct.pack("<i", len(text)), text, bytes(-start % 64), np.where(np.isfinite(v), v, np.nan).astype("<f4").tobytes())


def read_header(path: str) -> tuple[dict, Grid, int]:
    with open(path, "rb") as f:
        head = f.read(12)
        if head[:8] != VOLUME:
            raise ValueError(f"{path} is no volume")
        n = struct.unpack("<i", head[8:])[0]
        if not 0 < n <= 16 << 20:
            raise ValueError(f"{path}: a damaged header")
        h = json.loads(f.read(n))
    g = {k.lower(): v for k, v in next(v for k, v in h.items() if k.lower() == "grid").items()}
    grid = Grid(*[g[b.lower()] for b in _KEYS.values()])
    start = 12 + n + -(12 + n) % 64
    if os.path.getsize(path) < start + 4 * grid.nodes:
        raise ValueError(f"{path} is cut short")
    return h, grid, start


def read_volume(path: str) -> tuple[dict, Grid, np.ndarray]:
    """(header, grid, values as a memory map (nz, ny, nx))."""
    h, g, start = read_header(path)
    return h, g, np.memmap(path, "<f4", "r", start, (g.nz, g.ny, g.nx))


def volume_table(spark: SparkSession, path: str) -> DataFrame:
    """(node, i, j, k, lon, lat, depth_km, value): slices along depth are read where they are needed, from a folder that all share."""
    h, g, start = read_header(path)
    plane = g.nx * g.ny

    def run(batches):
        import pandas as pd

        for b in batches:
            for k in b["k"]:
                v = np.fromfile(path, "<f4", plane, offset=start + 4 * plane * int(k))
                yield pd.DataFrame({"node": np.arange(plane, dtype=np.int32) + int(k) * plane, "value": v.astype(float)})

    d = spark.range(g.nz).select(F.col("id").alias("k")).repartition(min(g.nz, 64)).mapInPandas(run, "node int, value double")
    return g.node_table(spark).join(d, "node").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def sample(path: str, lon, lat, depth) -> np.ndarray:
    _, g, v = read_volume(path)
    return g.interpolate(np.asarray(v, float), lon, lat, depth)


def on_grid(path: str, grid: Grid) -> np.ndarray:
    """Values on another grid, resampled only where bounds or sizes differ."""
    _, g, v = read_volume(path)
    same = all(abs(getattr(g, k) - getattr(grid, k)) <= 1e-6 for k in _KEYS)
    return np.asarray(v, float).ravel() if same else g.resample(np.asarray(v, float), grid)


def to_csv(path: str, out: str) -> None:
    _, g, v = read_volume(path)
    x, y, z = g.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    rows = (f"{a:.5f},{b:.5f},{c:.3f},{d:.6g}\n" for a, b, c, d in zip(xx.ravel(), yy.ravel(), zz.ravel(), np.asarray(v, float).ravel()))
    _atomic(out, ("lon,lat,depth_km,value\n" + "".join(rows)).encode())


def to_vtk(path: str, out: str) -> None:
    """Legacy structured grid in kilometres east, north and up of the grid's middle."""
    h, g, v = read_volume(path)
    x, y, z = g.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    lo, la = np.radians(xx - (g.min_lon + g.max_lon) / 2), np.radians(yy)
    l0, r = math.radians((g.min_lat + g.max_lat) / 2), EARTH_KM - zz
    a, b, c = r * np.cos(la) * np.cos(lo), r * np.cos(la) * np.sin(lo), r * np.sin(la)
    p = np.stack([b, -a * math.sin(l0) + c * math.cos(l0), a * math.cos(l0) + c * math.sin(l0) - EARTH_KM], -1)
    name = quote(str(h.get("Quantity") or "value"), safe="")
    title = f"volume;lon={g.min_lon},{g.max_lon},{g.nx};lat={g.min_lat},{g.max_lat},{g.ny};dep={g.min_depth},{g.max_depth},{g.nz};q={name}"[:255]
    parts = [f"# vtk DataFile Version 3.0\n{title}\nBINARY\nDATASET STRUCTURED_GRID\nDIMENSIONS {g.nx} {g.ny} {g.nz}\nPOINTS {g.nodes} float\n".encode(), p.astype(">f4").tobytes(), f"\nPOINT_DATA {g.nodes}\n".encode()]
    for n, d in ((name, np.asarray(v)), ("depth_km", zz), ("lon", xx), ("lat", yy)):
        parts += [f"SCALARS {n} float 1\nLOOKUP_TABLE default\n".encode(), np.asarray(d).astype(">f4").tobytes(), b"\n"]
    _atomic(out, *parts)


def write_rays(path: str, rays: list[tuple[int, int, int, int, np.ndarray]]) -> None:
    """(arrival, event, station, phase number, points (n, 3) lon lat depth)."""
    parts = [RAYS, struct.pack("<i", len(rays))]
    for a, e, s, p, q in rays:
        q = np.asarray(q, "<f4")
        parts += [struct.pack("<iiiBi", a, e, s, p, len(q)), q.T.tobytes()]
    _atomic(path, *parts)


def read_rays(path: str) -> list[tuple[int, int, int, int, np.ndarray]]:
    data = open(path, "rb").read()
    if data[:4] != RAYS:
        raise ValueError(f"{path} holds no rays")
    out, at = [], 8
    for _ in range(struct.unpack("<i", data[4:8])[0]):
        a, e, s, p, n = struct.unpack("<iiiBi", data[at : at + 17])
        at += 17
        out.append((a, e, s, p, np.frombuffer(data, "<f4", 3 * n, at).reshape(3, n).T.copy()))
        at += 12 * n
    return out


def write_matrix(path: str, a) -> None:
    _atomic(path, MATRIX, struct.pack("<iii", a.m, a.n, len(a.value)), a.start.astype("<i4").tobytes(), a.column.astype("<i4").tobytes(), a.value.astype("<f4").tobytes())


def curve_svg(points, chosen: int | None = None, width: int = 640, height: int = 480) -> str:
    """A trade-off curve (residual, model, label) as a drawing with logarithmic axes."""
    xs, ys = ([math.log10(max(1e-300, p[i])) for p in points] for i in (0, 1))
    sx = lambda v: 60 + (v - min(xs)) / ((max(xs) - min(xs)) or 1) * (width - 100)
    sy = lambda v: height - 50 - (v - min(ys)) / ((max(ys) - min(ys)) or 1) * (height - 90)
    dots = "".join(f'<circle cx="{sx(x):.1f}" cy="{sy(y):.1f}" r="{6 if i == chosen else 3}"/><text x="{sx(x) + 8:.1f}" y="{sy(y):.1f}" font-size="11">{p[2]}</text>' for i, (x, y, p) in enumerate(zip(xs, ys, points)))
    line = " ".join(f"{sx(x):.1f},{sy(y):.1f}" for x, y in zip(xs, ys))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><rect width="100%" height="100%" fill="white"/><polyline points="{line}" fill="none" stroke="black"/>{dots}<text x="{width / 2}" y="{height - 12}" font-size="12">residual norm</text><text x="8" y="20" font-size="12">model norm</text></svg>'
