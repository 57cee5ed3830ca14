"""Robust statistics per group. Medians that average and medians that do not are different operators: callers choose.

Order statistics are exact without gathering or sorting a whole group: a mergeable sketch brackets the wanted ranks, and only the rows
inside the bracket (a few thousandths of a large group) are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.common import Scratch


#: Groups of at most this many rows are ordered whole.
WHOLE = 2000
#: Estimated bytes of a table above which brackets are narrowed again before anything is ordered.
NARROW_BYTES = 1 << 30


def order_statistics(df: DataFrame, by: list[str], value: str, p: float, picks: dict[str, Column], *, narrow: bool | None = None) -> DataFrame:
    """(by..., names..., n): for each name the value at a rank (from 0, near p of the way), an expression over `n`, the group's number of
    values. Null and NaN are left out. Exact: a sketch brackets the ranks, rows below the bracket are counted, those inside ordered.

    The bracket holds about a two-hundredth of a large group. In large tables (`narrow`, by default from the estimated size) a second sketch, of the
    values inside, cuts it to a few hundredths of that, and equal values are counted together, so that what one task orders stays small.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).alias("_v"))
    if narrow is None:
        narrow = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > NARROW_BYTES
    e, accuracy = 0.002, 1000
    q = F.percentile_approx("_v", [max(0.0, p - e), min(1.0, p + e)], accuracy)
    b = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q.alias("_q"))
    big = F.col("n") > WHOLE
    b = b.select(*by, "n", F.when(big, F.col("_q")[0]).alias("_lo"), F.when(big, F.col("_q")[1]).alias("_hi"))
    # Without groups the bracket is one row.
    with_ = lambda x, y: x.join(y, by) if by else x.crossJoin(F.broadcast(y))
    inside_ = lambda d: d.where(F.coalesce(F.col("_v") >= F.col("_lo"), F.lit(True)) & F.coalesce(F.col("_v") <= F.col("_hi"), F.lit(True)))
    count_below = lambda d: d.groupBy(*by, "n", "_lo", "_hi").agg(F.count(F.when(F.col("_v") < F.col("_lo"), 1)).alias("_below"), F.count(F.when(F.col("_v").between(F.col("_lo"), F.col("_hi")), 1)).alias("_in"))
    r = with_(rows, b)
    below = count_below(r)
    if narrow:
        parts = 64
        grid = F.percentile_approx("_v", [k / parts for k in range(parts + 1)], 10 * accuracy)
        cut = with_(inside_(r).groupBy(*by).agg(grid.alias("_g")), below)
        # The picks lie between these steps of the second sketch, with one to spare on either side for its error.
        step = [(rank - F.col("_below")) * parts / F.greatest(F.lit(1), F.col("_in") - 1) for rank in picks.values()]
        first, last = F.floor(F.least(*step, F.lit(parts))) - 1, F.ceil(F.greatest(*step, F.lit(0))) + 1
        at = lambda i: F.element_at("_g", F.least(F.greatest(i, F.lit(0)), F.lit(parts)).cast("int") + 1)
        whole = F.col("_lo").isNull()
        b = cut.select(*by, "n", F.when(~whole, at(first)).alias("_lo"), F.when(~whole, at(last)).alias("_hi"))
        r = with_(rows, b)
        below = count_below(r)
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_v")
    if narrow:
        inside = inside_(r).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_k", F.sum("_c").over(order))
    else:
        inside = inside_(r).select(*by, "_v", F.lit(1).alias("_c")).withColumn("_k", F.row_number().over(order))
    j = with_(inside, below)
    upto = F.col("_k") + F.col("_below")
    return j.groupBy(*by).agg(*[F.max(F.when((rank < upto) & (rank >= upto - F.col("_c")), F.col("_v"))).alias(name) for name, rank in picks.items()], F.max("n").alias("n"))


def median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., median, n): the mean of the middle two where their number is even."""
    o = order_statistics(df, by, value, 0.5, {"_a": F.floor((F.col("n") - 1) / 2), "_b": F.floor(F.col("n") / 2)})
    return o.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias("median"), "n")


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., median, n): the value at n/2, never a mean."""
    return order_statistics(df, by, value, 0.5, {"median": F.floor(F.col("n") / 2)})


def scaled_mad(df: DataFrame, by: list[str], value: str, scale: float = 1.4826) -> DataFrame:
    """(by..., median, mad): averaging median, and the averaging median of distances from it, scaled."""
    scratch = Scratch(df.sparkSession, "mad")  # what is read several times is stored once
    df = scratch.keep(df.select(*by, value))
    m = scratch.keep(median(df, by, value).drop("n"))
    j = df.join(m, by) if by else df.crossJoin(F.broadcast(m))  # one row
    d = order_statistics(j.withColumn("_d", F.abs(F.col(value) - F.col("median"))), [*by, "median"], "_d", 0.5, {"_a": F.floor((F.col("n") - 1) / 2), "_b": F.floor(F.col("n") / 2)})
    return d.select(*by, "median", (scale * (F.col("_a") + F.col("_b")) / 2).alias("mad"))


def weighted_lower_median(df: DataFrame, by: list[str], value: str, weight: str, order: list[str] = ()) -> DataFrame:
    """(by..., median): the first value at which the weights so far reach half of all."""
    w = Window.partitionBy(*by).orderBy(value, *order)
    r = df.withColumn("_c", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum(weight).over(Window.partitionBy(*by)))
    return r.where(F.col("_c") >= F.col("_t") / 2).groupBy(*by).agg(F.min_by(value, "_c").alias("median"))


def interpolated_percentile(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """(by..., value): linear interpolation between order statistics."""
    at = p * (F.col("n") - 1)
    o = order_statistics(df, by, value, p, {"_a": F.floor(at), "_b": F.ceil(at)})
    return o.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))).alias("value"))


def truncated_percentile(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """(by..., value): the order statistic at the whole part of p (n - 1)."""
    return order_statistics(df, by, value, p, {"value": F.floor(p * (F.col("n") - 1))}).drop("n")


def reject_outliers(rows: DataFrame, *, residual: str, floor_s: float, mads: float = 4.0, centre_by: list[str] = (), absolute_s: float | None = None, scale: float = 1.4826, scratch: Scratch | None = None) -> DataFrame:
    """Rows with `rejected`: further than max(floor, mads x scaled MAD) from the centre. The groups of `centre_by` are small, such as an event's
    readings.

    The centre is the averaging median of all rows, or of each group in `centre_by`; the MAD is that of all distances. With
    `absolute_s`, residuals beyond it are rejected as well. Unknown residuals (null, NaN) are rejected. The distances, which are read several times, are
    stored once.
    """
    ok = F.col(residual).isNotNull() & ~F.isnan(residual)
    scratch = scratch or Scratch(rows.sparkSession, "outliers")
    distance = lambda d: d.withColumn("_d", F.when(ok, F.abs(F.col(residual) - F.col("_c"))))
    if centre_by:
        r = distance(rows.withColumn("_c", F.median(F.when(ok, F.col(residual))).over(Window.partitionBy(*centre_by))))
        far = scratch.keep(r.select("_d"))
    else:
        x = scratch.keep(rows.where(ok).select(residual))
        c = F.broadcast(scratch.keep(median(x, [], residual).select(F.col("median").alias("_c"))))  # one row
        r, far = distance(rows.crossJoin(c)), distance(x.crossJoin(c)).select("_d")
    m = median(far, [], "_d").select((scale * F.col("median")).alias("_m"))
    r = r.crossJoin(F.broadcast(m))  # one row
    bad = ~ok | (F.col("_d") > F.greatest(F.lit(floor_s), mads * F.col("_m")))
    if absolute_s is not None:
        bad = bad | (F.abs(F.col(residual)) > absolute_s)
    return r.withColumn("rejected", F.coalesce(bad, F.lit(True))).drop("_c", "_d", "_m")


def runs(rows: DataFrame, by: list[str], order: str, same: Column) -> DataFrame:
    """Rows with `run`, numbered per group: a row goes on with the run before it where `same` holds (null counts as no)."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w)).drop("_new")


def trimmed_slope(rows: DataFrame, x: str, y: str, *, factor: float = 3.0, passes: int = 5) -> tuple[float, int, int]:
    """(slope, rows kept, rows): least-squares line through the origin, rows trimmed at `factor` x 1.4826 x upper median of |residual|.

    A bounded number of passes over the two columns, which are stored once; each collects one row of sums.
    """
    rows = Scratch(rows.sparkSession, "slope").keep(rows.select(x, y))
    kept, total, n = rows, rows.count(), None
    slope = float("nan")
    for _ in range(passes):
        s = kept.agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.count(F.lit(1)).alias("n")).first()
        if not s["n"] or not s["xx"]:
            break
        slope = s["xy"] / s["xx"]
        if s["n"] == n:
            break
        n = s["n"]
        res = F.abs(F.col(y) - slope * F.col(x))
        limit = upper_median(rows.withColumn("_r", res), [], "_r").first()["median"] * 1.4826 * factor
        kept = rows.where(res <= limit)
    return slope, n or 0, total
