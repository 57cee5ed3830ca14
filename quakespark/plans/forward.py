"""Travel times and rays: eikonal tables per station, back-traced rays, and kernels on a model grid."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quakespark.common import spread
from quakespark.functions.geo import EARTH_KM, unwrap_longitude
from quakespark.functions.grid import Grid

#: Kernel entries below this length (km) are dropped.
LEAST_KM = 1e-4


def cartesian(lon, lat, depth) -> np.ndarray:
    """(n, 3) kilometres from the centre of the sphere."""
    lo, la, r = np.radians(lon), np.radians(lat), EARTH_KM - np.asarray(depth, float)
    return np.stack([r * np.cos(la) * np.cos(lo), r * np.cos(la) * np.sin(lo), r * np.sin(la)], -1)


def geographic(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.sqrt((p * p).sum(-1))
    return np.degrees(np.arctan2(p[..., 1], p[..., 0])), np.degrees(np.arcsin(p[..., 2] / r)), EARTH_KM - r


def local_axes(lon, lat) -> np.ndarray:
    """(n, 3, 3) rows east, north, down."""
    lo, la = np.radians(lon), np.radians(lat)
    z = np.zeros_like(lo)
    east = np.stack([-np.sin(lo), np.cos(lo), z], -1)
    north = np.stack([-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)], -1)
    down = -np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], -1)
    return np.stack([east, north, down], -2)


def eikonal(grid: Grid, slowness: np.ndarray, source: tuple[float, float, float], *, tolerance: float = 1e-7, max_turns: int = 2000, sweep: bool | None = None) -> np.ndarray:
    """First-arrival times (nz, ny, nx) from a point (lon, lat, depth).

    Upwind differences of the difference to the time in a uniform medium of the source's slowness, whose derivative is known exactly: so a
    uniform medium is exact, and the source's singularity costs no accuracy. Of small grids all nodes are updated together until none gets
    earlier; larger ones are swept in the eight diagonal orders, plane by plane, which solves the same equations in a few turns.
    """
    s = slowness.reshape(grid.nz, grid.ny, grid.nx)
    x, y, z = grid.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    p = cartesian(xx, yy, zz)
    ps = cartesian(*source)
    d = np.sqrt(((p - ps) ** 2).sum(-1))
    s0 = float(grid.interpolate(s, *[np.array([v]) for v in source])[0])
    t0 = s0 * d
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = np.where(d[..., None] > 1e-9, (p - ps) / d[..., None], 0.0)
    g = s0 * np.einsum("...ij,...j->...i", local_axes(xx, yy), unit)
    r = EARTH_KM - zz
    h = [r * np.cos(np.radians(yy)) * math.radians(grid.steps[0]), r * math.radians(grid.steps[1]), np.full_like(r, grid.steps[2])]
    axis = [2, 1, 0]  # east, north, down in the array
    inf = np.inf
    t = np.full(s.shape, inf)
    near = d <= 1.5 * max(float(np.median(v)) for v in h)
    near |= d <= d.min() + 1e-9
    t[near] = (0.5 * (s + s0) * d)[near]
    fixed = near.copy()

    def neighbour(a: np.ndarray, ax: int, side: int, fill: float) -> np.ndarray:
        out = np.full(a.shape, fill)
        to, of = [slice(None)] * 3, [slice(None)] * 3
        to[ax], of[ax] = (slice(1, None), slice(None, -1)) if side < 0 else (slice(None, -1), slice(1, None))
        out[tuple(to)] = a[tuple(of)]
        return out

    # What the uniform medium's curvature adds to a difference, for the neighbour on either side.
    fix = []
    for a, ax in enumerate(axis):
        fix.append([t0 - neighbour(t0, ax, side, 0.0) + side * g[..., a] * h[a] for side in (-1, 1)])
    w = [1 / (v * v) for v in h]
    if s.size > (SWEEP_NODES if sweep is None else 0 if sweep else s.size):
        return _sweep(t, fixed, s, axis, fix, w, tolerance, max_turns)
    uses, s2 = [(use, sum(w[a] for a in use)) for use in ((0, 1, 2), (0, 1), (0, 2), (1, 2), (0,), (1,), (2,))], s * s
    for _ in range(max_turns):
        known, best_c = [], []
        for a, ax in enumerate(axis):
            lo, hi = neighbour(t, ax, -1, inf), neighbour(t, ax, 1, inf)
            known.append(np.isfinite(np.minimum(lo, hi)))
            best_c.append(np.minimum(lo + fix[a][0], hi + fix[a][1]))
        new = np.full(s.shape, inf)
        with np.errstate(invalid="ignore", over="ignore"):
            b1, b2, late = [w[a] * c for a, c in enumerate(best_c)], [w[a] * c**2 for a, c in enumerate(best_c)], [c - 1e-12 for c in best_c]
            # The solution with all three axes, with pairs, and with one; the earliest that is later than its neighbours.
            for use, aa in uses:
                bb, cc = b1[use[0]], b2[use[0]]
                for a in use[1:]:
                    bb, cc = bb + b1[a], cc + b2[a]
                disc = bb * bb - aa * (cc - s2)
                v = (bb + np.sqrt(np.maximum(disc, 0))) / aa
                ok = (disc >= 0) & (v < new)
                for a in use:
                    ok &= known[a] & (v >= late[a])
                np.copyto(new, v, where=ok)
        new = np.where(fixed, t, np.minimum(t, new))
        with np.errstate(invalid="ignore"):
            change = np.where(np.isfinite(new), np.where(np.isfinite(t), t - new, inf), 0.0).max()
        t = new
        if change <= tolerance:
            break
    return t


#: Nodes above which the eikonal equation is solved by sweeps.
SWEEP_NODES = 20_000


@lru_cache(maxsize=4)
def _planes(shape: tuple[int, int, int]) -> list[list[np.ndarray]]:
    """For each of the eight orders the nodes of its diagonal planes, as places in the array padded by one on all sides."""
    padded = np.arange(np.prod([n + 2 for n in shape])).reshape([n + 2 for n in shape])[1:-1, 1:-1, 1:-1]
    plane = np.add.outer(np.add.outer(np.arange(shape[0]), np.arange(shape[1])), np.arange(shape[2])).ravel()
    order = np.argsort(plane, kind="stable")
    cuts = np.flatnonzero(np.diff(plane[order])) + 1
    out = []
    for a in (1, -1):
        for b in (1, -1):
            for c in (1, -1):
                out.append(np.split(padded[::a, ::b, ::c].ravel()[order], cuts))
    return out


def _sweep(t: np.ndarray, fixed: np.ndarray, s: np.ndarray, axis: list[int], fix: list, w: list, tolerance: float, max_turns: int) -> np.ndarray:
    pad = lambda x, v: np.pad(x, 1, constant_values=v).ravel()
    strides = [(t.shape[1] + 2) * (t.shape[2] + 2), t.shape[2] + 2, 1]
    near, still, slow = pad(t, np.inf), pad(fixed, True), pad(s, 1.0)
    lows, highs, ww = ([pad(f[0], 0.0) for f in fix], [pad(f[1], 0.0) for f in fix], [pad(v, 1.0) for v in w])
    orders = _planes(t.shape)
    for _ in range(max_turns):
        change = 0.0
        for planes in orders:
            for at in planes:
                at = at[~still[at]]
                if not len(at):
                    continue
                c = np.stack([np.minimum(near[at - strides[ax]] + lows[a][at], near[at + strides[ax]] + highs[a][at]) for a, ax in enumerate(axis)])
                v = np.stack([ww[a][at] for a in range(3)])
                by = np.argsort(c, 0)
                c, v, ss = np.take_along_axis(c, by, 0), np.take_along_axis(v, by, 0), slow[at] ** 2
                # One axis, and another as long as the time is later than its neighbour's.
                best = c[0] + np.sqrt(ss / v[0])
                for k in (2, 3):
                    go = best > c[k - 1]
                    if not go.any():
                        break
                    x, y = c[:k, go], v[:k, go]
                    aa, bb, cc = y.sum(0), (y * x).sum(0), (y * x * x).sum(0) - ss[go]
                    best[go] = (bb + np.sqrt(np.maximum(0.0, bb * bb - aa * cc))) / aa
                old = near[at]
                earlier = best < old
                if earlier.any():
                    gain = old[earlier] - best[earlier]
                    change = max(change, float(gain.max()))
                    near[at[earlier]] = best[earlier]
        if change <= tolerance:
            break
    return near.reshape([n + 2 for n in t.shape])[1:-1, 1:-1, 1:-1].copy()


def covering_grid(grid: Grid, refinement: int, points: DataFrame, *, lon: str = "lon", lat: str = "lat", depth: str = "depth_km", max_nodes: int = 12_000_000) -> tuple[Grid, float]:
    """(forward grid, coarsening): the refined grid if it holds all points, else one that holds them too, with a margin of two cells, on the same
    nodes; coarser by factors of 1.25 while it would have more than `max_nodes`. Points above the top lie on it. One row reaches the driver."""
    fine = grid.refined(max(1, refinement))
    x = unwrap_longitude(F.col(lon), (grid.min_lon + grid.max_lon) / 2)
    b = points.agg(F.min(x).alias("w"), F.max(x).alias("e"), F.min(lat).alias("s"), F.max(lat).alias("n"), F.max(depth).alias("d")).first()
    if b["w"] is None or (b["w"] >= grid.min_lon and b["e"] <= grid.max_lon and b["s"] >= grid.min_lat and b["n"] <= grid.max_lat and b["d"] <= grid.max_depth):
        return fine, 1.0
    steps = np.array(fine.steps)
    west, east = min(grid.min_lon, b["w"]) - 2 * steps[0], max(grid.max_lon, b["e"]) + 2 * steps[0]
    south, north = max(-89.0, min(grid.min_lat, b["s"]) - 2 * steps[1]), min(89.0, max(grid.max_lat, b["n"]) + 2 * steps[1])
    bottom = b["d"] + 2 * steps[2] if b["d"] > grid.max_depth else grid.max_depth
    if east - west >= 359:
        raise ValueError("points outside the grid go around the globe; restrict the data")
    span, factor = np.array([east - west, north - south, bottom - grid.min_depth]), 1.0
    while np.prod(np.ceil(span / (steps * factor)) + 1) > max_nodes:
        factor *= 1.25
    steps = steps * factor
    low = np.array([grid.min_lon, grid.min_lat, grid.min_depth])
    before = np.ceil((low - [west, south, grid.min_depth]) / steps - 1e-9).astype(int)
    inner = np.round((np.array([grid.max_lon, grid.max_lat, grid.max_depth]) - low) / steps).astype(int)
    after = np.maximum(0, np.ceil((np.array([east, north, bottom]) - [grid.max_lon, grid.max_lat, grid.max_depth]) / steps - 1e-9).astype(int))
    begin, n = low - before * steps, before + inner + after
    end = begin + n * steps
    return Grid(begin[0], end[0], begin[1], end[1], begin[2], end[2], *(int(k) + 1 for k in n)), factor


def decimated(points: Column, most: int) -> Column:
    """At most `most` points of a ray's array, the ends among them, evenly by number."""
    n = F.size(points)
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(points, (F.bround(i * (n - 1) / (most - 1)) + 1).cast("int")))
    return F.when(n <= most, points).otherwise(at)


def stored_rays(rays: DataFrame, points: str = "points", *, order: str = "arrival", most: int = 50_000, most_points: int = 64) -> DataFrame:
    """The first rays that are kept for display, each with a bounded number of points."""
    return rays.orderBy(order).limit(most).withColumn(points, decimated(F.col(points), most_points))


def time_and_gradient(grid: Grid, t: np.ndarray, lon, lat, depth) -> tuple[np.ndarray, np.ndarray]:
    """Times and (n, 3) gradients (east, north, down; s/km) at points, by trilinear interpolation and central differences."""
    lon, lat, depth = (np.asarray(v, float) for v in (lon, lat, depth))
    at = grid.interpolate(t, lon, lat, depth)
    dx, dy, dz = (v / 2 for v in grid.steps)
    r = EARTH_KM - depth
    km = (r * np.cos(np.radians(lat)) * np.radians(dx), r * np.radians(dy), np.full_like(r, dz))
    out = []
    for k, (a, b, c) in enumerate(((dx, 0, 0), (0, dy, 0), (0, 0, dz))):
        lo = [np.clip(v - o, m, n) for v, o, m, n in zip((lon, lat, depth), (a, b, c), (grid.min_lon, grid.min_lat, grid.min_depth), (grid.max_lon, grid.max_lat, grid.max_depth))]
        hi = [np.clip(v + o, m, n) for v, o, m, n in zip((lon, lat, depth), (a, b, c), (grid.min_lon, grid.min_lat, grid.min_depth), (grid.max_lon, grid.max_lat, grid.max_depth))]
        share = (hi[k] - lo[k]) / (2 * (a, b, c)[k])
        out.append((grid.interpolate(t, *hi) - grid.interpolate(t, *lo)) / np.maximum(2 * km[k] * share, 1e-12))
    return at, np.stack(out, -1)


def trace_rays(grid: Grid, t: np.ndarray, source: tuple[float, float, float], lon, lat, depth, *, step: float | None = None, max_steps: int = 4000) -> list[np.ndarray]:
    """Rays from points back to the source down the time's gradient: (n_i, 3) Cartesian points each. All rays step together."""
    step = step or 0.5 * grid.min_spacing_km
    end = cartesian(*source)
    p = cartesian(np.asarray(lon, float), np.asarray(lat, float), np.asarray(depth, float))
    paths = [[q.copy()] for q in p]
    alive = np.arange(len(p))
    for _ in range(max_steps):
        d = np.sqrt(((p[alive] - end) ** 2).sum(-1))
        alive = alive[d > 1.5 * step]
        if not len(alive):
            break
        lo, la, de = geographic(p[alive])
        _, g = time_and_gradient(grid, t, lo, la, de)
        v = -np.einsum("nij,ni->nj", local_axes(lo, la), g)
        size = np.sqrt((v * v).sum(-1))
        toward = end - p[alive]
        toward /= np.sqrt((toward**2).sum(-1))[:, None]
        v = np.where(size[:, None] > 1e-9, v / np.maximum(size, 1e-12)[:, None], toward)
        q = p[alive] + step * v
        lo, la, de = geographic(q)  # rays stay inside the table
        q = cartesian(np.clip(lo, grid.min_lon, grid.max_lon), np.clip(la, grid.min_lat, grid.max_lat), np.clip(de, grid.min_depth, grid.max_depth))
        p[alive] = q
        for i, v_ in zip(alive, q):
            paths[i].append(v_.copy())
    return [np.array([*path, end]) for path in paths]


def kernel(grid: Grid, points: np.ndarray, piece_km: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, km): the length of a ray given to nodes, each piece's by trilinear weights at its middle."""
    piece_km = piece_km or 0.5 * grid.min_spacing_km
    a, b = points[:-1], points[1:]
    length = np.sqrt(((b - a) ** 2).sum(-1))
    n = np.maximum(1, np.ceil(length / piece_km).astype(int))
    f = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 0.5) / np.repeat(n, n)
    mid = np.repeat(a, n, 0) + f[:, None] * np.repeat(b - a, n, 0)
    nodes, w = grid.weights(*geographic(mid))
    out = np.bincount(nodes.ravel(), (w * np.repeat(length / n, n)[:, None]).ravel(), grid.nodes)
    at = np.flatnonzero(out >= LEAST_KM)
    return at, out[at]


#: Rays whose kernels are made at once: their lengths at all nodes stay in the cache.
RAYS = 200


def straight_kernels(grid: Grid, a: np.ndarray, b: np.ndarray, piece_km: float = 1.0):
    """Kernels of straight rays, many at once: (ray, node, km) arrays."""
    out = [_straight_kernels(grid, a[k : k + RAYS], b[k : k + RAYS], piece_km) for k in range(0, max(1, len(a)), RAYS)]
    return np.concatenate([r + k * RAYS for k, (r, _, _) in enumerate(out)]), np.concatenate([n for _, n, _ in out]), np.concatenate([km for _, _, km in out])


def _straight_kernels(grid: Grid, a: np.ndarray, b: np.ndarray, piece_km: float):
    d = b - a
    length = np.sqrt((d**2).sum(-1))
    n = np.maximum(1, np.ceil(length / piece_km).astype(int))
    ray = np.repeat(np.arange(len(a)), n)
    f = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 0.5) / n[ray]
    x, y, z = (a[:, c][ray] + f * d[:, c][ray] for c in range(3))
    r = np.sqrt(x * x + y * y + z * z)
    code, w = grid.weights(np.degrees(np.arctan2(y, x)), np.degrees(np.arcsin(z / r)), EARTH_KM - r)
    code += (ray * grid.nodes)[:, None]
    w *= (length / n)[ray][:, None]
    total = np.bincount(code.ravel(), w.ravel(), len(a) * grid.nodes)
    hit = np.flatnonzero(total >= LEAST_KM)
    of = hit // grid.nodes
    return of, hit - of * grid.nodes, total[hit]


def layer_kernels(grid: Grid, a: np.ndarray, b: np.ndarray, piece_km: float):
    """Kernels of straight rays summed by layer, many at once: (ray, layer, km) arrays. A piece's length goes to the two layers around its middle."""
    length = np.sqrt(((b - a) ** 2).sum(-1))
    n = np.maximum(1, np.ceil(length / piece_km).astype(int))
    ray = np.repeat(np.arange(len(a)), n)
    f = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 0.5) / n[ray]
    mid = a[ray] + f[:, None] * (b - a)[ray]
    at = np.clip((EARTH_KM - np.sqrt((mid * mid).sum(-1)) - grid.min_depth) / grid.steps[2], 0, grid.nz - 1)
    k = np.minimum(at.astype(int), max(0, grid.nz - 2))
    km, share = (length / n)[ray], at - k
    total = np.bincount(ray * grid.nz + k, km * (1 - share), len(a) * grid.nz) + np.bincount(ray * grid.nz + np.minimum(k + 1, grid.nz - 1), km * share, len(a) * grid.nz)
    hit = np.flatnonzero(total >= LEAST_KM)
    return hit // grid.nz, hit % grid.nz, total[hit]


def coverage(arrivals: DataFrame, grid: Grid, *, piece_km: float = 1.0, rays_at_once: int = 1000) -> DataFrame:
    """(phase, node, dws, hits): summed ray length and number of rays at each node, of straight rays.

    Each task adds its rays to one dense array of the grid and emits it once, so the shuffle is tasks x nodes rows, however many rays.
    """
    nodes = grid.nodes

    def run(batches):
        dws, hits = {}, {}
        for b in batches:
            d = b.to_pandas()
            for ph, g in d.groupby("phase"):
                for k in range(0, len(g), rays_at_once):
                    c = g.iloc[k : k + rays_at_once]
                    p = cartesian(c["ev_lon"].to_numpy(), c["ev_lat"].to_numpy(), c["depth_km"].to_numpy())
                    q = cartesian(c["st_lon"].to_numpy(), c["st_lat"].to_numpy(), -c["elevation_m"].to_numpy() / 1000)
                    _, node, km = straight_kernels(grid, p, q, piece_km)
                    dws[ph] = dws.get(ph, 0) + np.bincount(node, km, nodes)
                    hits[ph] = hits.get(ph, 0) + np.bincount(node, minlength=nodes)
        for ph in dws:
            at = np.flatnonzero(hits[ph])
            yield pa.RecordBatch.from_arrays([pa.array([ph] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(dws[ph][at]), pa.array(hits[ph][at].astype(np.int64))], names=["phase", "node", "dws", "hits"])

    cols = ["phase", "ev_lon", "ev_lat", "depth_km", "st_lon", "st_lat", "elevation_m"]
    part = arrivals.select(*cols).mapInArrow(run, "phase string, node int, dws double, hits long")
    return part.groupBy("phase", "node").agg(F.sum("dws").alias("dws"), F.sum("hits").alias("hits"))


def kernel_rows(arrivals: DataFrame, grid: Grid, slowness: dict[str, np.ndarray], *, straight: bool = False, layered: bool = False, carry: list[str] = (), forward: Grid | None = None, chunk_rows: int = 20_000) -> DataFrame:
    """(arrival, event, station, phase, t_calc, ge, gn, gd, nodes, km, and the columns in `carry`) of every arrival.

    Straight rays are narrow. Else there is one table a (station, phase), made where its arrivals are; a station with many arrivals is split into chunks that each make it. Slowness
    (one value a node of `grid`, the model's size) travels with the function. With `layered`, lengths are summed by layer and `nodes` are
    layers: for models of one value a layer, rows are then as short as the grid is deep.
    """
    plane = grid.nx * grid.ny
    fwd = forward or grid
    fields = {p: (grid.resample(s, fwd).reshape(fwd.nz, fwd.ny, fwd.nx) if fwd is not grid else s.reshape(grid.nz, grid.ny, grid.nx)) for p, s in slowness.items()}
    kinds = {c: arrivals.schema[c].dataType.simpleString() for c in ["arrival", "event", "station", "phase", *carry]}
    head = ["arrival", "event", "station", "phase"]
    out = ", ".join(f"{c} {kinds[c]}" for c in head) + ", t_calc double, ge double, gn double, gd double, nodes array<int>, km array<double>" + "".join(f", {c} {kinds[c]}" for c in carry)
    needed = [*head, "ev_lon", "ev_lat", "depth_km", "st_lon", "st_lat", "elevation_m", *carry]
    if straight:
        return _straight_rows(arrivals.select(*needed), grid, slowness, layered, out)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        f, s = g.iloc[0], fields[g["phase"].iloc[0]]
        source = (float(f["st_lon"]), float(f["st_lat"]), -float(f["elevation_m"]) / 1000)
        lon, lat, dep = (g[c].to_numpy(float) for c in ("ev_lon", "ev_lat", "depth_km"))
        rows = []
        table = eikonal(fwd, s, source)
        t, v = time_and_gradient(fwd, table, lon, lat, dep)
        for i, path in enumerate(trace_rays(fwd, table, source, lon, lat, dep)):
            nodes, km = kernel(grid, path)
            if layered:
                km = np.bincount(nodes // plane, km, grid.nz)
                nodes = np.flatnonzero(km)
                km = km[nodes]
            rows.append((t[i], *v[i], nodes, km))
        r = pd.DataFrame(rows, columns=["t_calc", "ge", "gn", "gd", "nodes", "km"])
        g = g.reset_index(drop=True)
        return pd.concat([g[["arrival", "event", "station", "phase"]], r, g[list(carry)]], axis=1)

    per = arrivals.select(*needed).withColumn("chunk", F.floor(F.pmod(F.xxhash64("arrival"), F.lit(1 << 20)) / F.greatest(F.lit(1), F.ceil(F.lit(1 << 20) / F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(_by_station()) / chunk_rows))))))
    return spread(per, "station", "phase", "chunk").groupBy("station", "phase", "chunk").applyInPandas(run, out)


def _by_station():
    from pyspark.sql import Window

    return Window.partitionBy("station", "phase")


def straight_geometry(grid: Grid, full: dict[str, np.ndarray], short: dict[str, np.ndarray], layered: bool, phase, lon, lat, depth, st_lon, st_lat, elevation_m):
    """(ray, node, km, t, v) of straight rays: kernel entries, times, and derivatives of the times by the events' places (east, north, down).
    `full` is slowness by node, `short` by node or layer."""
    a, b = cartesian(lon, lat, depth), cartesian(st_lon, st_lat, -elevation_m / 1000)
    ray, node, km = (layer_kernels if layered else straight_kernels)(grid, a, b, 0.5 * grid.min_spacing_km)
    cost, here = np.zeros(len(ray)), np.zeros(len(a))
    for p in full:
        of = phase == p
        here[of] = grid.interpolate(full[p], lon[of], lat[of], depth[of])
        of = of[ray]
        cost[of] = km[of] * short[p][node[of]]
    away = (a - b) / np.maximum(1e-9, np.sqrt(((a - b) ** 2).sum(-1)))[:, None]
    return ray, node, km, np.bincount(ray, cost, len(a)), np.einsum("nij,nj->ni", local_axes(lon, lat), away) * here[:, None]


def _straight_rows(arrivals: DataFrame, grid: Grid, slowness: dict[str, np.ndarray], layered: bool, out: str, at_once: int = 2000) -> DataFrame:
    """`kernel_rows` of straight rays: no table, so no grouping."""
    arrow = to_arrow_schema(arrivals.sparkSession.createDataFrame([], out).schema)
    plane = grid.nx * grid.ny
    short = {p: np.asarray(s, float).ravel()[:: plane if layered else 1] for p, s in slowness.items()}
    full = {p: np.asarray(s, float).ravel() for p, s in slowness.items()}
    names = arrivals.columns

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, at_once):
                batch = whole.slice(k, at_once)
                col = lambda c, b=batch: b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float)
                phase = batch.column(names.index("phase")).to_numpy(zero_copy_only=False)
                ray, node, km, t, v = straight_geometry(grid, full, short, layered, phase, *[col(c) for c in ("ev_lon", "ev_lat", "depth_km", "st_lon", "st_lat", "elevation_m")])
                offsets = pa.array(np.searchsorted(ray, np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (node.astype(np.int32), km)]
                made = {"t_calc": pa.array(t), "ge": pa.array(v[:, 0]), "gn": pa.array(v[:, 1]), "gd": pa.array(v[:, 2]), "nodes": lists[0], "km": lists[1]}
                yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else batch.column(names.index(f.name)) for f in arrow], schema=arrow)

    return arrivals.mapInArrow(run, out)
