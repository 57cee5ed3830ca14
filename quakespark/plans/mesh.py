"""Model parameters other than nodes: octree cells that follow the data, and rotated lattices. Meshes are of the model's size."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.functions.geo import EARTH_KM
from quakespark.functions.grid import Grid


@dataclass
class Mesh:
    """Cells as blocks [i0, i1) x [j0, j1) x [k0, k1) of nodes, and the cell of each node."""

    cells: np.ndarray
    of_node: np.ndarray

    @property
    def n(self) -> int:
        return len(self.cells)


def _sums(field: np.ndarray) -> np.ndarray:
    return np.pad(field.cumsum(0).cumsum(1).cumsum(2), ((1, 0), (1, 0), (1, 0)))


def _box(s: np.ndarray, c) -> float:
    i0, i1, j0, j1, k0, k1 = c
    return s[k1, j1, i1] - s[k0, j1, i1] - s[k1, j0, i1] - s[k1, j1, i0] + s[k0, j0, i1] + s[k0, j1, i0] + s[k1, j0, i0] - s[k0, j0, i0]


def octree(grid: Grid, hits: np.ndarray, *, largest: int = 8, largest_depth: int = 4, threshold: float = 10.0, covered: float = 0.5, balance: bool = True) -> Mesh:
    """Cells halved while at least a share of their nodes has `threshold` hits; with `balance` neighbours differ by one halving at most."""
    shape = (grid.nz, grid.ny, grid.nx)
    good = _sums((np.asarray(hits, float).reshape(shape) >= threshold).astype(float))
    todo = [(i, min(i + largest, grid.nx), j, min(j + largest, grid.ny), k, min(k + largest_depth, grid.nz), 0) for k in range(0, grid.nz, largest_depth) for j in range(0, grid.ny, largest) for i in range(0, grid.nx, largest)]

    def halves(c):
        *b, level = c
        cut = [(b[0], (b[0] + b[1] + 1) // 2, b[1]), (b[2], (b[2] + b[3] + 1) // 2, b[3]), (b[4], (b[4] + b[5] + 1) // 2, b[5])]
        parts = [[(lo, mid), (mid, hi)] if hi - lo > 1 else [(lo, hi)] for lo, mid, hi in cut]
        return [(*x, *y, *z, level + 1) for x in parts[0] for y in parts[1] for z in parts[2]]

    leaves = []
    while todo:
        c = todo.pop()
        size = (c[1] - c[0]) * (c[3] - c[2]) * (c[5] - c[4])
        if size > 1 and _box(good, c[:6]) >= covered * size:
            todo += halves(c)
        else:
            leaves.append(c)
    while balance:
        level = np.zeros(shape, int)
        for c in leaves:
            level[c[4] : c[5], c[2] : c[3], c[0] : c[1]] = c[6]
        coarse = []
        for n, c in enumerate(leaves):
            ring = level[max(0, c[4] - 1) : c[5] + 1, max(0, c[2] - 1) : c[3] + 1, max(0, c[0] - 1) : c[1] + 1]
            if ring.max() > c[6] + 1 and (c[1] - c[0]) * (c[3] - c[2]) * (c[5] - c[4]) > 1:
                coarse.append(n)
        if not coarse:
            break
        split = set(coarse)
        leaves = [c for n, c in enumerate(leaves) if n not in split] + [h for n in coarse for h in halves(leaves[n])]
    leaves.sort(key=lambda c: (c[4], c[2], c[0]))
    of_node = np.full(shape, -1)
    for n, c in enumerate(leaves):
        of_node[c[4] : c[5], c[2] : c[3], c[0] : c[1]] = n
    if (of_node < 0).any():
        raise ValueError("cells do not cover the grid")
    return Mesh(np.array([c[:6] for c in leaves]), of_node.ravel())


def edges(mesh: Mesh, grid: Grid) -> np.ndarray:
    """(a, b, axis, contact): neighbouring cells and the number of node pairs across their border."""
    f = mesh.of_node.reshape(grid.nz, grid.ny, grid.nx)
    out = []
    for axis, (p, q) in enumerate(((f[:, :, :-1], f[:, :, 1:]), (f[:, :-1], f[:, 1:]), (f[:-1], f[1:]))):
        p, q = p.ravel(), q.ravel()
        d = p != q
        lo, hi = np.minimum(p[d], q[d]), np.maximum(p[d], q[d])
        code, n = np.unique(lo * mesh.n + hi, return_counts=True)
        out.append(np.stack([code // mesh.n, code % mesh.n, np.full(len(code), axis), n], 1))
    return np.concatenate(out)


def to_cells(mesh: Mesh, values: np.ndarray, mean: bool = True) -> np.ndarray:
    s = np.bincount(mesh.of_node, np.asarray(values, float).ravel(), mesh.n)
    return s / np.bincount(mesh.of_node, minlength=mesh.n) if mean else s


def to_nodes(mesh: Mesh, values: np.ndarray) -> np.ndarray:
    return np.asarray(values)[mesh.of_node]


def mapping(spark: SparkSession, mesh: Mesh) -> DataFrame:
    """(node, column, w) for joins with kernels."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"node": np.arange(len(mesh.of_node), dtype=np.int32), "column": mesh.of_node.astype(np.int32), "w": 1.0}))


def lattice(grid: Grid, spacing_km: float, depth_spacing_km: float, rotation_deg: float = 0.0, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[np.ndarray, np.ndarray, int]:
    """(columns (n, 8), weights (n, 8), number of parameters): trilinear weights of nodes on a rotated lattice; unused parameters are left out."""
    x, y, z = grid.axes()
    zz, yy, xx = (v.ravel() for v in np.meshgrid(z, y, x, indexing="ij"))
    mid = math.radians((grid.min_lat + grid.max_lat) / 2)
    e, n = np.radians(xx - (grid.min_lon + grid.max_lon) / 2) * EARTH_KM * math.cos(mid), np.radians(yy - (grid.min_lat + grid.max_lat) / 2) * EARTH_KM
    a = math.radians(rotation_deg)
    q = np.stack([(e * math.cos(a) - n * math.sin(a) + offset[0]) / spacing_km, (e * math.sin(a) + n * math.cos(a) + offset[1]) / spacing_km, (zz + offset[2]) / depth_spacing_km], 1)
    lo = np.floor(q).astype(int)
    f = q - lo
    cols, ws = [], []
    for c in range(8):
        o = np.array([c & 1, c >> 1 & 1, c >> 2 & 1])
        cols.append(lo + o)
        ws.append(np.prod(np.where(o, f, 1 - f), 1))
    keys = np.stack(cols, 1)
    w = np.stack(ws, 1)
    used = keys[w > 1e-9]
    _, inv = np.unique(np.concatenate([used, keys.reshape(-1, 3)]), axis=0, return_inverse=True)
    inv = inv.ravel()[len(used) :].reshape(w.shape)
    live = np.unique(inv[w > 1e-9])
    number = np.full(inv.max() + 1, 0)
    number[live] = np.arange(len(live))
    return number[inv], np.where(w > 1e-9, w, 0.0), len(live)


def project(kernels: DataFrame, map_: DataFrame) -> DataFrame:
    """Rows (row, column, value) of kernels (row, node, value) on other parameters."""
    j = kernels.join(map_, "node")
    return j.groupBy("row", "column").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def size_histogram(mesh: Mesh) -> dict[int, int]:
    size = np.bincount(mesh.of_node, minlength=mesh.n)
    return {int(k): int(v) for k, v in zip(*np.unique(size, return_counts=True))}


def save(mesh: Mesh, grid: Grid, path: str) -> None:
    import json
    import os

    with open(path + ".tmp", "w") as f:
        json.dump({"grid": json.loads(grid.to_json()), "cells": mesh.cells.tolist()}, f)
    os.replace(path + ".tmp", path)


def load(path: str) -> tuple[Mesh, Grid]:
    """Cells that cover the grid without overlap; anything else is an error."""
    import json

    with open(path) as f:
        d = json.load(f)
    g = Grid(**d["grid"])
    count = np.zeros((g.nz, g.ny, g.nx), int)
    of_node = np.full(count.shape, -1)
    for n, (i0, i1, j0, j1, k0, k1) in enumerate(d["cells"]):
        count[k0:k1, j0:j1, i0:i1] += 1
        of_node[k0:k1, j0:j1, i0:i1] = n
    if (count != 1).any():
        raise ValueError(f"{path}: cells overlap or leave nodes out")
    return Mesh(np.array(d["cells"]), of_node.ravel()), g
