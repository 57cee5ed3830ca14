"""Operators on polarities, mechanisms and trade-off tables: relational parts of source studies and choices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.common import Scratch, shuffle_partitions, spread
from quakespark.functions import mechanism as m
from quakespark.operators import stats


def first_readings(polarities: DataFrame, *, order: str, manual: str = "manual") -> DataFrame:
    """First reading per (event, station) with a polarity other than 0; weight 0.5 where `manual` is 0."""
    p = polarities.where(F.col("polarity").isNotNull() & ~F.isnan(F.col("polarity").cast("double")) & (F.col("polarity") != 0))
    w = Window.partitionBy("event", "station").orderBy(order)
    p = p.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return p.withColumn("weight", F.when(F.col(manual) == 0, 0.5).otherwise(1.0)).withColumn("polarity", F.signum(F.col("polarity").cast("double")).cast("int"))


def mechanism_grid(step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strikes, dips, rakes) of a search grid in scan order: strikes outermost, rakes innermost; dips start at one step, as a level plane has no strike."""
    n = round(360 / step)
    g = np.meshgrid(np.arange(n) * step, np.arange(1, round(90 / step) + 1) * step, np.arange(n) * step - 180, indexing="ij")
    return tuple(x.ravel().astype(float) for x in g)


def grid_misfit(g: pd.DataFrame, normal: np.ndarray, slip: np.ndarray, at_once: int = 1_000_000) -> np.ndarray:
    """Weighted share of an event's readings (azimuth, takeoff, polarity, weight) that each mechanism gets wrong."""
    az, to = np.radians(g["azimuth"].to_numpy(float)), np.radians(g["takeoff"].to_numpy(float))
    ray = np.stack([np.sin(to) * np.cos(az), np.sin(to) * np.sin(az), np.cos(to)])
    sign, w = np.sign(g["polarity"].to_numpy(float)), g["weight"].to_numpy(float)
    k = max(1, at_once // max(1, len(g)))  # mechanisms at once, so that memory does not grow with them times the readings
    return np.concatenate([((np.sign((normal[i : i + k] @ ray) * (slip[i : i + k] @ ray)) != sign) * w).sum(1) for i in range(0, len(normal), k)]) / w.sum()


def counted(polarities: DataFrame) -> DataFrame:
    """Readings that count: a polarity other than 0 and a positive weight."""
    return polarities.where((F.col("polarity") != 0) & (F.col("weight") > 0))


def polarity_misfit(polarities: DataFrame, step: float = 5.0) -> DataFrame:
    """(event, strike, dip, rake, misfit, n): weighted share of n readings that each mechanism of a grid gets wrong.

    One group is an event's readings, of which there are a few per station; the grid is made in the task, so nothing but readings is shuffled.
    """
    kind = polarities.schema["event"].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        strike, dip, rake = mechanism_grid(step)
        misfit = grid_misfit(g, *m.vectors(strike, dip, rake))
        return pd.DataFrame({"event": [g["event"].iloc[0]] * len(strike), "strike": strike, "dip": dip, "rake": rake, "misfit": misfit, "n": len(g)})

    readings = counted(polarities).select("event", "azimuth", "takeoff", "polarity", "weight")
    return spread(readings, "event").groupBy("event").applyInPandas(run, f"event {kind}, strike double, dip double, rake double, misfit double, n long")


def acceptable_mechanisms(misfits: DataFrame, error_fraction: float = 0.1) -> DataFrame:
    """Mechanisms within the least misfit plus the spread of a binomial number of wrong readings (at least one)."""
    f = min(max(error_fraction, 0.01), 0.5)
    extra = F.greatest(F.lit(1.0), F.sqrt(F.col("n") * f * (1 - f))) / F.col("n")
    least = F.min("misfit").over(Window.partitionBy("event"))
    return misfits.withColumn("least", least).where(F.col("misfit") <= F.col("least") + extra + 1e-12).drop("least")


def valid_mechanisms(rows: DataFrame) -> DataFrame:
    """Dips in (0, 90], positive weights, and a second plane that is whole or absent."""
    two = F.col("strike2").isNotNull().cast("int") + F.col("dip2").isNotNull().cast("int") + F.col("rake2").isNotNull().cast("int")
    return rows.where((F.col("dip1") > 0) & (F.col("dip1") <= 90) & (F.col("weight") > 0) & ((two == 0) | ((two == 3) & (F.col("dip2") > 0) & (F.col("dip2") <= 90))))


def stress_normal_equations(planes: DataFrame) -> DataFrame:
    """One row: sums of the 5 x 5 normal equations that fit a deviatoric stress to slip directions (shear parallel to slip).

    Unknowns are nn, ne, nd, ee, ed with dd = -nn - ee. Shear traction of each basis tensor on the plane: (B n) - n (n . B n).
    """
    n, u = m.normal(F.col("strike"), F.col("dip")), m.slip(F.col("strike"), F.col("dip"), F.col("rake"))
    a, b, c = n["n"], n["e"], n["d"]
    basis = [(a, F.lit(0.0), -c), (b, a, F.lit(0.0)), (c, F.lit(0.0), a), (F.lit(0.0), b, -c), (F.lit(0.0), c, b)]
    cols = []
    for t in basis:
        along = t[0] * a + t[1] * b + t[2] * c
        cols.append([t[0] - along * a, t[1] - along * b, t[2] - along * c])
    s = [u["n"], u["e"], u["d"]]
    w = F.col("weight")
    agg = [F.sum(w * sum(cols[i][k] * cols[j][k] for k in range(3))).alias(f"a{i}{j}") for i in range(5) for j in range(i, 5)]
    agg += [F.sum(w * sum(cols[i][k] * s[k] for k in range(3))).alias(f"b{i}") for i in range(5)]
    return planes.agg(*agg)


def weighted_neighbours(nodes: DataFrame, mechanisms: DataFrame, *, radius_km: float, half_height_km: float, deviations: float = 3.0, gaussian: bool = True) -> DataFrame:
    """(node, id, weight): mechanisms within reach of each node of a stress map, weighted by distance.

    Both sides meet in cells as large as the reach; a node looks at the 27 cells around it.
    """
    step = [radius_km, radius_km, half_height_km]
    cell = lambda c: [F.floor(F.col(x) / s).alias(f"c{i}") for i, (x, s) in enumerate(zip(c, step))]
    mec = mechanisms.select("id", "x", "y", "z", *cell("xyz"))
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("ijk", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    nd = nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"), near.alias("o"))
    nd = nd.select("node", "nx", "ny", "nz", *[(F.floor(F.col(c) / s) + F.col(f"o.{k}")).alias(f"c{i}") for i, (c, s, k) in enumerate(zip(("nx", "ny", "nz"), step, "ijk"))])
    j = nd.join(mec, ["c0", "c1", "c2"])
    h2 = F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2)
    r2 = h2 / radius_km**2 + F.pow(F.col("z") - F.col("nz"), 2) / half_height_km**2
    w = F.exp(-0.5 * deviations**2 * r2) if gaussian else F.lit(1.0)
    return j.where(r2 <= 1).select("node", "id", w.alias("weight"))


def effective_count(rows: DataFrame, by: str, weight: str = "weight") -> DataFrame:
    return rows.groupBy(by).agg((F.pow(F.sum(weight), 2) / F.sum(F.pow(weight, 2))).alias("effective_n"))


def curve_corner(points: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """(by..., order, distance): the point of each curve farthest from the chord between its ends, both axes in logarithms and scaled to
    0..1; of equally far ones the last by `order`. Curves of fewer than three points give their last."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    up = w.orderBy(order)
    p = points.withColumn("_x", F.ln(F.greatest(F.lit(1e-300), F.col(x)))).withColumn("_y", F.ln(F.greatest(F.lit(1e-300), F.col(y))))
    for c in ("_x", "_y"):
        span = F.max(c).over(w) - F.min(c).over(w)
        p = p.withColumn(c + "s", (F.col(c) - F.min(c).over(w)) / F.when(span > 0, span).otherwise(1.0))
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a, b = [F.first(c).over(whole) for c in ("_xs", "_ys")], [F.last(c).over(whole) for c in ("_xs", "_ys")]
    dx, dy = b[0] - a[0], b[1] - a[1]
    chord = F.sqrt(dx * dx + dy * dy)
    d = F.when(chord > 0, F.abs(dx * (a[1] - F.col("_ys")) - (a[0] - F.col("_xs")) * dy) / chord).otherwise(0.0)
    p = p.withColumn("distance", d).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(up))
    p = p.withColumn("_best", F.max("distance").over(w))
    ok = F.when(F.col("_n") < 3, F.col("_r") == F.col("_n")).otherwise(F.col("distance") >= F.col("_best") - 1e-12)
    last = p.where(ok).withColumn("_k", F.row_number().over(w.orderBy(F.col("_r").desc()))).where("_k = 1")
    return last.select(*by, order, "distance")


def magnitude_windows(events: DataFrame, *, min_window: int = 5) -> DataFrame:
    """(magnitude, event, fraction): share of resolved corners in windows of max(5, n/6) events in order of magnitude.

    Events are range-partitioned; running numbers and sums of a partition begin where the partitions before it end (one row a partition on the
    driver), and a window is the difference of two sums, met by a join on the running number.
    """
    kind = events.schema["event"].dataType.simpleString()

    def number(batches):
        part, n, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            x = b["resolved"].fillna(False).astype(bool).to_numpy().cumsum() + total
            yield b.assign(part=part, r=n + np.arange(1, len(b) + 1), upto=x)
            if len(b):
                n, total = n + len(b), int(x[-1])

    s = events.select(F.col("magnitude").cast("double"), "event", F.col("resolved").cast("boolean")).repartitionByRange(shuffle_partitions(events.sparkSession), "magnitude", "event").sortWithinPartitions("magnitude", "event")
    s = Scratch(events.sparkSession, "windows").keep(s.mapInPandas(number, f"magnitude double, event {kind}, resolved boolean, part int, r long, upto long"))
    parts = s.groupBy("part").agg(F.max("r").alias("r"), F.max("upto").alias("upto")).orderBy("part").collect()
    n = sum(p["r"] for p in parts)
    k = max(min_window, n // 6)
    before = {p["part"]: (sum(q["r"] for q in parts[:i]), sum(q["upto"] for q in parts[:i])) for i, p in enumerate(parts)}
    at = lambda i: F.create_map(*[F.lit(x) for p, v in before.items() for x in (p, v[i])])[F.col("part")] if before else F.lit(0)
    s = s.select("magnitude", "event", (F.col("r") + at(0)).alias("r"), (F.col("upto") + at(1)).alias("upto"), F.coalesce(F.col("resolved").cast("int"), F.lit(0)).alias("own"))
    end = s.select((F.col("r") - (k - 1)).alias("r"), F.col("upto").alias("last"))
    return s.join(end, "r").select("magnitude", "event", ((F.col("last") - F.col("upto") + F.col("own")) / k).alias("fraction"))


def corner_interval(grid: DataFrame, by: str, order: str, rss: str, parameters: int, data: str) -> DataFrame:
    """(by, best, low, high): the least rss of each group and the unbroken range around it with rss <= least (1 + 3.84 / freedom)."""
    w = Window.partitionBy(by)
    best = F.min(F.struct(rss, order)).over(w)
    limit = best[rss] * (1 + 3.84 / F.greatest(F.lit(1), F.col(data) - parameters))
    g = grid.withColumn("_in", F.col(rss) <= limit).withColumn("_b", best[order])
    g = g.withColumn("_lag", F.lag("_in").over(w.orderBy(order)))
    g = stats.runs(g, [by], order, F.col("_in") == F.col("_lag"))
    r = g.groupBy(by, "run", "_b").agg(F.min(order).alias("low"), F.max(order).alias("high"))
    return r.where((F.col("_b") >= F.col("low")) & (F.col("_b") <= F.col("high"))).select(by, F.col("_b").alias("best"), "low", "high")


def longest_run_above(rows: DataFrame, by: str, order: str, ok: Column) -> DataFrame:
    """(by, first, last, n): the longest unbroken run of rows where `ok` holds, the first of equally long ones."""
    g = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    g = g.withColumn("_lag", F.lag("_ok").over(Window.partitionBy(by).orderBy(order)))
    g = stats.runs(g, [by], order, F.col("_ok") == F.col("_lag")).where("_ok")
    r = g.groupBy(by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    best = r.groupBy(by).agg(F.max(F.struct("n", (-F.col("run")).alias("k"), "first", "last")).alias("b"))
    return best.select(by, "b.first", "b.last", "b.n")
