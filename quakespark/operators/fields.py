"""Operators on node tables (node, value) and sparse rows (row, node, value): sums, norms, products and choices, all as aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.common import spread
from quakespark.functions import geo
from quakespark.functions.geo import EARTH_KM
from quakespark.functions.grid import Grid
from quakespark.operators import stats


def block_of(grid: Grid, size: int = 2) -> Column:
    """Number of the block of size^3 nodes that holds a node."""
    bx, by = -(-grid.nx // size), -(-grid.ny // size)
    i, j, k = F.col("node") % grid.nx, F.floor(F.col("node") / grid.nx) % grid.ny, F.floor(F.col("node") / (grid.nx * grid.ny))
    return ((F.floor(k / size) * by + F.floor(j / size)) * bx + F.floor(i / size)).cast("long")


def to_blocks(values: DataFrame, grid: Grid, size: int = 2) -> DataFrame:
    """(block, mean, total, nodes) of a node table."""
    return values.groupBy(block_of(grid, size).alias("block")).agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("value").alias("nodes"))


def recovery(nodes: DataFrame) -> DataFrame:
    """One row from (hits, value, truth): correlation over sampled and over well-sampled nodes (at least the upper median of hits), and the RMS
    difference over sampled ones."""
    seen = nodes.where("hits > 0")
    mid = stats.upper_median(seen, [], "hits").select(F.col("median").alias("mid"))
    j = seen.crossJoin(F.broadcast(mid))  # one row
    well = F.col("hits") >= F.col("mid")
    return j.agg(F.corr("value", "truth").alias("correlation"), F.corr(F.when(well, F.col("value")), F.when(well, F.col("truth"))).alias("correlation_well"), F.sqrt(F.avg(F.pow(F.col("value") - F.col("truth"), 2))).alias("rms"), F.count(F.lit(1)).alias("nodes"))


def product(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(row, y): a sparse matrix times a model (node, x)."""
    return rows.join(model, "node").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("y"))


def column_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.sum(F.abs("value")).alias("total"))


def on_bounds(nodes: DataFrame, low: float, high: float) -> DataFrame:
    """How many sampled nodes lie on the bounds of a parameter."""
    at = (F.col("value") <= low) | (F.col("value") >= high)
    return nodes.where("hits > 0").agg(F.count(F.when(at, 1)).alias("on_bounds"), (100 * F.avg(at.cast("double"))).alias("percent"))


def checkerboard(grid: Grid, cell_km: float, depth_cell_km: float, percent: float) -> Column:
    """Perturbation of a node from its lon, lat, depth_km: sines of the distances along the surface from the western and southern edges, and of
    depth, whose first cell begins half a cell above the top."""
    pi, lon, lat = F.pi(), F.col("lon"), F.col("lat")
    e, n = geo.distance_km(F.lit(grid.min_lon), lat, lon, lat), geo.distance_km(lon, F.lit(grid.min_lat), lon, lat)
    return percent / 100 * F.sin(pi * e / cell_km) * F.sin(pi * n / cell_km) * F.sin(pi * (F.col("depth_km") - grid.min_depth + 0.5 * depth_cell_km) / depth_cell_km)


def tabular_body(lon0: float, lat0: float, depth0: float, strike: float, dip: float, length_km: float, width_km: float, thickness_km: float, percent: float) -> Column:
    """Perturbation of a point (lon, lat, depth_km) by a plate around a centre: whole inside, half at its faces, falling with the sixth power."""
    km = math.radians(1) * EARTH_KM
    s, d = math.radians(strike), math.radians(dip)
    east, north, down = (F.col("lon") - lon0) * (km * math.cos(math.radians(lat0))), (F.col("lat") - lat0) * km, F.col("depth_km") - depth0
    across = east * math.cos(s) - north * math.sin(s)  # to the right of the strike, where it dips
    along = east * math.sin(s) + north * math.cos(s)
    sides = ((along, length_km), (across * math.cos(d) + down * math.sin(d), width_km), (down * math.cos(d) - across * math.sin(d), thickness_km))
    return percent / 100 * F.exp(-math.log(2) * sum(F.pow(F.abs(x) / (0.5 * size), 6) for x, size in sides))


def chord_crosses(grid: Grid, a: Column, b: Column, samples: int | None = None) -> Column:
    """Whether a straight ray between Cartesian structs comes inside the grid; above the top counts as at the top.

    An end inside counts, and points at most half the smallest node spacing apart between them. With `samples`: only samples - 1 points
    between the ends, whatever the ray's length.
    """

    def point(f: Column) -> Column:
        return F.struct(*[(a[c] + f * (b[c] - a[c])).alias(c) for c in "xyz"])

    if samples is not None:

        def inside(i: Column) -> Column:
            p = geo.from_cartesian(point(i / samples))
            return p["lon"].between(grid.min_lon, grid.max_lon) & p["lat"].between(grid.min_lat, grid.max_lat) & (p["depth_km"] <= grid.max_depth)

        return F.exists(F.sequence(F.lit(1), F.lit(samples - 1)), inside)

    dx, dy, dz = grid.steps
    km = math.radians(1) * (EARTH_KM - grid.max_depth)
    spacing = min(dz, dy * km, dx * km * min(math.cos(math.radians(x)) for x in (grid.min_lat, grid.max_lat)))
    n = F.greatest(F.lit(2), F.ceil(geo.chord_km(a, b) / max(0.1, 0.5 * spacing)).cast("int"))

    def contains(p: Column, depth: Column) -> Column:
        return grid.contains(p["lon"], p["lat"], depth)

    def between(i: Column) -> Column:
        p = geo.from_cartesian(point(i / n))
        return contains(p, F.greatest(p["depth_km"], F.lit(grid.min_depth)))

    ends = [geo.from_cartesian(x) for x in (a, b)]
    return contains(ends[0], ends[0]["depth_km"]) | contains(ends[1], ends[1]["depth_km"]) | F.exists(F.sequence(F.lit(1), n - 1), between)


def filled(value: str, default: Column) -> Column:
    """A value, or the default where it is null or NaN."""
    return F.coalesce(F.when(~F.isnan(value), F.col(value)), default)


def weighted_lower_medians(r: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each column of r (..., n, columns): the first value, in order, at which the weights w (..., n) so far reach half of all; NaN does not
    count (0 where nothing does)."""
    order = np.argsort(r, axis=-2, kind="stable")  # NaN last
    value = np.take_along_axis(r, order, -2)
    weight = np.take_along_axis(np.broadcast_to(w[..., None], r.shape), order, -2)
    upto = np.cumsum(np.where(np.isnan(value), 0.0, weight), axis=-2)
    at = (upto >= upto[..., -1:, :] / 2).argmax(-2)
    got = np.take_along_axis(value, at[..., None, :], -2)[..., 0, :]
    return np.where(np.isnan(got), 0.0, got)


def search(arrivals: DataFrame, nodes: pd.DataFrame, times: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], *, at_once: int = 4_000_000) -> DataFrame:
    """(event, node, misfit) of the node of least weighted sum of absolute residuals of each event (event, time_s, weight, ...); the
    origin time of a node is the weighted lower median of what its travel times leave. An arrival without a travel time at a node counts 10 s.

    `nodes` is a search grid whose size is a parameter, with a column `node`; it travels with the function. `times`: travel times (arrivals x nodes) of
    some events' arrivals to some of the nodes. Many events are searched at once, those with equally many arrivals together.
    """
    kind = arrivals.schema["event"].dataType.simpleString()

    nodes = nodes.sort_values("node", kind="stable").reset_index(drop=True)
    node = nodes["node"].to_numpy()
    rows_at_once = max(1, at_once // max(1, len(nodes)))

    def best_nodes(g: pd.DataFrame) -> pd.DataFrame:
        """Of whole events, whose rows are together."""
        event = g["event"].to_numpy()
        begin = np.flatnonzero(np.append(True, event[1:] != event[:-1]))
        size, w_all, t_all = np.diff(np.append(begin, len(g))), g["weight"].to_numpy(float), g["time_s"].to_numpy(float)
        best, least, at = np.full(len(begin), np.inf), np.full(len(begin), np.inf), np.zeros(len(begin), np.int64)
        step = max(1, at_once // len(g))
        for k in range(0, len(nodes), step):
            part = nodes.iloc[k : k + step]
            left = t_all[:, None] - times(g, part)
            for n in np.unique(size):
                of = np.flatnonzero(size == n)
                rows = begin[of][:, None] + np.arange(n)
                r, w = left[rows], w_all[rows]
                d = np.abs(r - weighted_lower_medians(r, w)[:, None, :])
                misfit = (np.where(np.isnan(d), 10.0, d) * w[..., None]).sum(1)
                rounded = np.round(misfit, 6)
                first = rounded.argmin(1)  # of equal ones the first node
                every = np.arange(len(of))
                better = rounded[every, first] < best[of]
                to = of[better]
                best[to], least[to], at[to] = rounded[every, first][better], misfit[every, first][better], node[k + first[better]]
        return pd.DataFrame({"event": event[begin], "node": at, "misfit": least})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n < rows_at_once:
                continue
            g = pd.concat(held, ignore_index=True)
            whole = np.flatnonzero(g["event"].to_numpy() != g["event"].iloc[-1])
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield best_nodes(g.iloc[:cut])
            # Where one event is larger, it is read on, twice as far each time.
            held, n = [g.iloc[cut:]], len(g) - cut if cut else rows_at_once - len(g)
        g = pd.concat(held, ignore_index=True) if held else []
        if len(g):
            yield best_nodes(g)

    a = spread(arrivals, "event").sortWithinPartitions("event")
    return a.mapInPandas(run, f"event {kind}, node int, misfit double")


def crossings(rows: DataFrame, id: str, *, threshold: float, ahead: int, expected: int) -> DataFrame:
    """(id, i): the upward crossing whose peak over the next samples reaches half of the strongest, nearest to the expected sample, the
    first on ties."""
    w = Window.partitionBy(id).orderBy("i")
    r = rows.withColumn("before", F.lag("x").over(w)).withColumn("peak", F.max("x").over(w.rowsBetween(0, ahead)))
    c = r.where((F.col("x") >= threshold) & (F.col("before") < threshold)).withColumn("top", F.max("peak").over(Window.partitionBy(id)))
    return c.where(F.col("peak") >= F.col("top") / 2).groupBy(id).agg(F.min(F.struct(F.abs(F.col("i") - expected).alias("d"), "i")).alias("b")).select(id, "b.i")


def instability(n: Column, ratio: float, friction: float) -> Column:
    """Fault instability of a plane with unit normal struct (n, e, d) whose components lie along the principal stresses, the largest first."""
    s = [1.0, 1 - 2 * ratio, -1.0]
    sq = [F.pow(n[c], 2) for c in ("n", "e", "d")]
    sigma = sum(a * b for a, b in zip(sq, s))
    tau = F.sqrt(F.greatest(F.lit(0.0), sum(a * b * b for a, b in zip(sq, s)) - sigma * sigma))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (tau - friction * (sigma - 1)) / (friction + (1 + friction**2) ** 0.5)))


def clean_id(c: Column) -> Column:
    """The last part of a resource name, other characters than letters, digits, dots, dashes and underscores replaced."""
    return F.regexp_replace(F.element_at(F.split(F.rtrim(c, F.lit("/")), r"[/=#]"), -1), r"[^A-Za-z0-9._-]", "_")


def iso_time(c: Column) -> Column:
    """UTC to a tenth of a millisecond."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSS'Z'")
