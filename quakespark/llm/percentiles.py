"""Exact percentiles per group of very large columns by bisection, and mergeable counts with a stated error.

The first pass counts rows per group on a fixed ladder of value intervals: its counts add, so those of days or other parts can be
stored and combined (`count_ladder`, `merge_ladders`, `ladder_percentiles`) with a stated error. It equals a dozen bisection steps at
once. Exact percentiles go on from there: the interval that holds a target rank is kept for each group and percentile, its
rows are counted below many midpoints in each pass, and it narrows until all values left in it are equal (`exact_percentiles`).

Scale. A pass is a map-side combined count; a hot group costs no more than another, and no group is ever gathered. After the first
pass only rows inside a wanted interval are read again, from a table in the shared folder. State (one interval a group and percentile)
stays in DataFrames; only the number of open intervals reaches the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.common import Scratch, finite

#: Values of at most this size share the interval around zero.
SCALE = 1e-6
#: Intervals for each factor e in value.
STEPS = 128
#: Midpoints by which an interval is cut in each later pass.
CUTS = 1024
#: Open intervals of all sets (some 100 bytes each) up to which they are sent to the rows, by their counted number.
BROADCAST_INTERVALS = 20_000


def ladder_error(scale: float = SCALE, steps: int = STEPS) -> tuple[float, float]:
    """(relative, absolute): a ladder's percentile is within relative x |value| + absolute of the exact order statistic."""
    r = math.expm1(1.0 / steps)
    return r, r * scale


def _rung(x: Column, scale: float, steps: int) -> Column:
    return F.floor(F.signum(x) * F.log1p(F.abs(x) / F.lit(scale)) * F.lit(float(steps))).cast("int")


def count_ladder(df: DataFrame, by: list[str], value: str, *, scale: float = SCALE, steps: int = STEPS) -> DataFrame:
    """Rows per group and value interval: (by..., rung, n, lo, hi). Ladders of parts made with the same scale and steps add up.

    Null, NaN and infinite values are left out. A null in `by` is a group of its own. Repeated rows count as often as they occur.
    """
    x = F.col(value).cast("double")
    rows = df.where(finite(value)).select(*by, (x + F.lit(0.0)).alias("x"))  # -0.0 becomes 0.0
    return rows.groupBy(*by, _rung(F.col("x"), scale, steps).alias("rung")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def merge_ladders(ladders: DataFrame, by: list[str]) -> DataFrame:
    """The ladder of the union of parts, from the union of their ladders; `by` may be coarser than in the parts (days to months)."""
    return ladders.groupBy(*by, "rung").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _targets(ladder: DataFrame, by: list[str], percentiles: list[float], cell: str) -> DataFrame:
    """For each group, percentile and end of the linear interpolation: the cell that holds the target rank, and the rank in it."""
    up = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy(*by)
    c = ladder.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(all_))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.lit(e).alias("end")) for p in percentiles for e in (0, 1)])
    c = c.withColumn("want", F.explode(wanted))
    position = F.col("want.percentile") * (F.col("total") - 1)
    rank = F.when(F.col("want.end") == 0, F.floor(position)).otherwise(F.ceil(position))
    c = c.withColumn("rank", rank.cast("long")).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return c.select(
        *by, F.col("want.percentile").alias("percentile"), F.col("want.end").alias("end"), F.col("total"), (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), F.col(cell).alias("cell"), "n", "lo", "hi"
    )


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equal in all columns, null being equal to null."""
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in columns])


def _interpolate(ends: DataFrame, by: list[str]) -> DataFrame:
    """Percentile between the two order statistics around it."""
    v = lambda e: F.max(F.when(F.col("end") == e, F.col("x")))
    w = ends.groupBy(*by, "percentile").agg(F.max("total").alias("n"), v(0).alias("a"), v(1).alias("b"))
    position = F.col("percentile") * (F.col("n") - 1)
    return w.select(*by, "percentile", "n", (F.col("a") + (F.col("b") - F.col("a")) * (position - F.floor(position))).alias("value"))


def ladder_percentiles(ladder: DataFrame, by: list[str], percentiles: list[float], *, scale: float = SCALE, steps: int = STEPS) -> DataFrame:
    """Percentiles from a ladder alone: (by..., percentile, n, value, error), each within `error` of the exact value."""
    r, a = ladder_error(scale, steps)
    t = _targets(ladder, by, percentiles, "rung")
    ends = t.select(*by, "percentile", "end", "total", ((F.col("lo") + F.col("hi")) / 2).alias("x"), ((F.col("hi") - F.col("lo")) / 2).alias("e"))
    out = _interpolate(ends, by)
    err = ends.groupBy(*by, "percentile").agg(F.max("e").alias("error"))
    return out.join(err, _same(out, err, [*by, "percentile"])).select(*[out[c] for c in [*by, "percentile", "n", "value"]], "error")


def _grouped(ladder: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """The ladder of each set of keys, from that of all keys: (gs, keys..., cell, n, lo, hi). Keys outside a set are null."""
    out = []
    coarse = [i for i, s in enumerate(sets) if len(s) < len(keys)]
    if coarse:
        part = F.explode(F.array(*[_member(ladder, keys, sets, i) for i in coarse])).alias("m")
        few = ladder.select(part, "cell", "n", "lo", "hi").select("m.*", "cell", "n", "lo", "hi")
        out.append(few.groupBy("gs", *keys, "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    out += [ladder.select(F.lit(i).alias("gs"), *keys, "cell", "n", "lo", "hi") for i, s in enumerate(sets) if len(s) == len(keys)]
    return reduce(DataFrame.unionByName, out)


def _member(df: DataFrame, keys: list[str], sets: list[list[str]], i: int) -> Column:
    return F.struct(F.lit(i).alias("gs"), *[(F.col(k) if k in sets[i] else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys])


def exact_percentiles(
    df: DataFrame, by: list[str], value: str, percentiles: list[float], *, groupings: list[list[str]] | None = None, scale: float = SCALE, steps: int = STEPS, cuts: int = CUTS, max_passes: int = 64
) -> DataFrame:
    """Exact percentiles with linear interpolation between order statistics: (by..., percentile, n, value). The error is zero up to
    the rounding of the interpolation.

    With `groupings`, lists of columns of `by`, there is one set of groups for each list, all from one count of the rows by all columns of
    `by`, whose ladders are merged; the result has a column `grouping` (the list's columns, joined by commas) and null in the other columns.

    Null, NaN and infinite values are left out; a group without other values gives no row, as does an empty table. A null in `by` is a
    group of its own. Repeated rows count as often as they occur (take first deliveries before). Ties need no rule, as equal values are
    the same percentile. `df` is read twice; give a stored table where it is costly to compute. Other columns are ignored, whatever their names.
    """
    if not by:
        return exact_percentiles(df.withColumn("__all", F.lit(1)), ["__all"], value, percentiles, scale=scale, steps=steps, cuts=cuts, max_passes=max_passes).drop("__all")
    if {"percentile", "n", "value"} & set(by) or (groupings and "grouping" in by):
        raise ValueError("rename groups called percentile, n, value or grouping: the result has these columns")
    named = [f"g{i}" for i in range(len(by))]
    sets = [[named[by.index(c)] for c in g] for g in groupings or [by]]
    scratch = Scratch(df.sparkSession, "percentiles")
    rows = df.where(finite(value)).select(*[F.col(b).alias(k) for b, k in zip(by, named)], (F.col(value).cast("double") + F.lit(0.0)).alias("x"))
    rows = rows.withColumn("cell", _rung(F.col("x"), scale, steps))
    ladder = rows.groupBy(*named, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    parts = scratch.keep(ladder) if len(sets) > 1 or len(sets[0]) < len(by) else ladder
    ladder = _grouped(parts, named, sets)
    keys = ["gs", *named]
    state = scratch.keep(_targets(ladder, keys, percentiles, "cell"))
    scratch.drop(parts)
    done = [state.where("lo = hi")]
    for _ in range(max_passes):
        todo = state.where("lo < hi")
        open_ = {r["gs"]: r["count"] for r in todo.groupBy("gs").count().collect()}  # one row a set
        if not open_:
            break
        # Open intervals of a group are numbered from 1; at most two a percentile.
        todo = todo.withColumn("k", F.dense_rank().over(Window.partitionBy(*keys).orderBy("cell")))
        cells = todo.select(*keys, "cell", "k", "lo", "hi").distinct()
        cut = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cuts), F.lit(cuts - 1)).cast("int")
        # Rows meet few intervals where they are; many intervals (sets of small groups) take a shuffle of the rows of those sets only.
        few, total = [], 0
        for g, n in sorted(open_.items(), key=lambda x: x[1]):
            if (total := total + n) <= BROADCAST_INTERVALS:
                few.append(g)
        met = []
        for kind in (few, [g for g in open_ if g not in few]):
            if kind:
                r = rows.where(F.col("gs").isin(kind)) if "gs" in rows.columns else rows.select(F.explode(F.array(*[_member(rows, named, sets, g) for g in kind])).alias("m"), "x", "cell").select("m.*", "x", "cell")
                c = cells.where(F.col("gs").isin(kind))
                met.append(r.join(F.broadcast(c) if kind is few else c, _same(r, c, [*keys, "cell"])).select(*[r[k] for k in keys], "x", (F.col("k") * cuts + cut).alias("cell")))
        inner = scratch.keep(reduce(DataFrame.unionByName, met))
        scratch.drop(rows)
        rows = inner
        part = F.floor(F.col("cell") / cuts).cast("int")
        up = Window.partitionBy(*keys, "k").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = rows.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("lo2"), F.max("x").alias("hi2"))
        counts = counts.withColumn("k", part).withColumn("upto", F.sum("m").over(up)).withColumnRenamed("cell", "cell2")
        inside = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m"))
        state = scratch.keep(
            todo.join(counts, _same(todo, counts, [*keys, "k"]) & inside).select(
                *[todo[k] for k in keys], "percentile", "end", "total", (F.col("rank") - (F.col("upto") - F.col("m"))).alias("rank"), F.col("cell2").alias("cell"), F.col("m").alias("n"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi")
            )
        )
        done.append(state.where("lo = hi"))
    else:
        raise RuntimeError("intervals did not close; raise max_passes")
    scratch.drop(rows)
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    out = _interpolate(ends.withColumn("x", F.col("lo")), keys)
    names = F.array(*[F.lit(",".join(g)) for g in groupings or [by]])
    return out.select(*([names[F.col("gs")].alias("grouping")] if groupings else []), *[F.col(k).alias(b) for k, b in zip(named, by)], "percentile", "n", "value")
