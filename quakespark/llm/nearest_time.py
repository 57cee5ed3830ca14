"""Matching records of two tables by nearest time within a tolerance.

Both tables are co-grouped by (entity, time range). Ranges overlap: a right row within the largest tolerance of a range's edge is
also sent to the neighbouring range, so each left row is in exactly one range and sees every right row it can match. Inside a
co-group, one vectorised binary search over (entity, time) finds the right neighbours of all left rows at once.

Scale. A range is a day of an entity, cut in halves until none holds more than `target_rows` rows of both tables, where they really lie: a
hot entity or a burst is cut finer, others are not. A range never becomes narrower than some margins; if it is still too full there, its left rows are
spread over several tasks, and its right rows are first reduced to one for each microsecond, which bounds them. Ranges are hashed onto slots of
about a quarter of `target_rows` rows, since one Python call a range would cost more than the search. Each side is shuffled once, with key, time and
id only; what reaches the driver is two numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quakespark.common import Scratch, micros, shuffle_partitions

_DAY = 86_400_000_000
#: A day is cut in halves at most so often (its microseconds can be).
_HALVES = 13


def _runs(code: np.ndarray, time: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (code, time) in order, and for each the row with the smallest id."""
    order = np.lexsort((time, code))
    c, t = code[order], time[order]
    first = np.ones(len(c), bool)
    first[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1])
    starts = np.flatnonzero(first)
    rep = order[starts]
    length = np.diff(np.append(starts, len(c)))
    many = np.flatnonzero(length > 1)
    if len(many):  # repeated rows and exact ties
        group = np.repeat(many, length[many])
        rows = order[np.repeat(starts[many], length[many]) + np.arange(len(group)) - np.repeat(np.cumsum(length[many]) - length[many], length[many])]
        rank = pc.rank(ids.take(pa.array(rows))).to_numpy()
        best = np.lexsort((rank, group))
        rep[many] = rows[best[np.searchsorted(group, many)]]
    return c[starts], t[starts], rep


def _search(left: pa.Table, right: pa.Table, schema: pa.Schema) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    both = pa.chunked_array(left["ent"].chunks + right["ent"].chunks).combine_chunks().dictionary_encode()
    code = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lt, rt = (x["t"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right))
    tol = left["tol"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    lc, ids = code[: len(lt)], right["rid"].combine_chunks()
    rc, rt, rep = _runs(code[len(lt) :], rt, ids)

    times = np.concatenate([lt, rt])
    low, span = int(times.min()), int(times.max()) - int(times.min()) + 1
    if (len(both.dictionary) + 1) * span < 2**62:
        lk, rk = lc * span + (lt - low), rc * span + (rt - low)
    else:  # ranks of times keep the order and always fit
        rank = np.unique(times, return_inverse=True)[1].astype(np.int64)
        lk, rk = lc * (len(times) + 1) + rank[: len(lt)], rc * (len(times) + 1) + rank[len(lt) :]

    far = np.int64(2**62)
    at = np.searchsorted(rk, lk, "left")
    after, before = np.minimum(at, len(rk) - 1), np.maximum(at - 1, 0)
    d_after = np.where((at < len(rk)) & (rc[after] == lc), rt[after] - lt, far)
    d_before = np.where((at > 0) & (rc[before] == lc), lt - rt[before], far)
    earlier = d_before <= d_after  # of equally near neighbours the earlier one
    gap = np.where(earlier, d_before, d_after)
    hit = np.flatnonzero(gap <= tol)
    take = rep[np.where(earlier, before, after)[hit]]
    out = pa.table(
        [left["lid"].combine_chunks().take(pa.array(hit)), ids.take(pa.array(take)), pa.array(np.where(earlier, -gap, gap)[hit] / 1e6)],
        schema=schema,
    )
    return out.group_by(schema.names).aggregate([]).select(schema.names)  # repeated left rows share a range


def _cut(a: DataFrame, b: DataFrame, counts: DataFrame, unit: int, halves: int, margin: int, target_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Both sides with (block, part, salt): parts of full blocks, halved until each holds `target_rows` rows or is as narrow as may be."""
    narrow = unit >> halves
    block = lambda t: F.floor(t / F.lit(unit))
    cell = lambda t: F.floor(F.pmod(t, F.lit(unit)) / F.lit(narrow)).cast("int")
    hot = scratch.keep(counts.where(F.col("count") > target_rows).select("ent", "block"))
    place = lambda d, left: d.select("ent", block(F.col("t")).alias("block"), cell(F.col("t")).alias("cell"), F.lit(left).alias("l"))
    fine = place(a, 1).unionAll(place(b, 0)).join(hot, ["ent", "block"], "left_semi").groupBy("ent", "block", "cell").agg(F.sum("l").alias("nl"), F.count(F.lit(1)).alias("n"))
    fine = scratch.keep(fine)
    part = F.expr(f"shiftright(cell, {halves} - level)")
    levels = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(halves)))).groupBy("ent", "block", "level", part.alias("part")).agg(F.sum("n").alias("n"))
    levels = levels.groupBy("ent", "block", "level").agg(F.max("n").alias("n")).where((F.col("n") <= target_rows) | (F.col("level") == halves))
    levels = scratch.keep(levels.groupBy("ent", "block").agg(F.min("level").alias("level")))
    nr = F.col("n") - F.col("nl")
    full = fine.where((F.col("nl") > target_rows) | (nr > target_rows)).select("ent", "block", F.col("cell").alias("part"), F.ceil(F.greatest(F.col("nl"), F.lit(1)) / target_rows).cast("int").alias("salts"), (nr > target_rows).alias("dense"))
    full = scratch.keep(full)

    def parts(d: DataFrame) -> DataFrame:
        d = d.join(levels, ["ent", "block"], "left").withColumn("part", F.when(F.col("level").isNull(), 0).otherwise(part))
        return d.join(full, ["ent", "block", "part"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))

    a = parts(a.withColumn("block", block(F.col("t"))).withColumn("cell", cell(F.col("t")))).withColumn("salt", F.pmod(F.xxhash64("lid", "t"), F.col("salts")).cast("int"))
    # A right row goes to the ranges of both ends of its margin; they are one range or two, as none is narrower than the margins.
    ends = F.array(*[F.struct(block(e).alias("block"), cell(e).alias("cell")) for e in (F.col("t") - margin, F.col("t") + margin)])
    b = parts(b.withColumn("end", F.explode(F.array_distinct(ends))).select("ent", "t", "rid", "end.*"))
    dense = F.coalesce("dense", F.lit(False))
    plain = b.where(~dense).select("ent", "block", "part", "salts", "t", "rid")
    reduced = b.where(dense).groupBy("ent", "block", "part", "salts", "t").agg(F.min("rid").alias("rid")).select(*plain.columns)
    return a, plain.unionAll(reduced).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    by: list[str],
    time: str | tuple[str, str],
    ids: tuple[str, str],
    tolerance_s: float | Column,
    max_tolerance_s: float,
    target_rows: int = 200_000,
) -> DataFrame:
    """For each left row the right row of the same entity nearest in time: (left id, right id, dt_s = right - left time).

    `by`: columns, in both tables, that make the entity (compared as text, exactly). `tolerance_s`: seconds, or a Column over the left
    table; never above `max_tolerance_s`. Both bounds are inclusive, to the microsecond.

    Nulls: a row with a null id, entity part or time, and a left row with a null tolerance, matches nothing. Ties: the
    earlier of two equally near times, then the smallest right id. Repeated rows: left rows with equal id, entity and time give
    their match once; repeated right rows count as one. Empty tables give an empty result. Other columns are
    ignored, whatever their names. A right row may serve several left rows.
    """
    lt, rt = (time, time) if isinstance(time, str) else time
    spark = left.sparkSession
    parts = [F.col(c).cast("string") for c in by]
    ent = F.concat_ws("\u0001", *parts)
    known = lambda t, i: F.col(t).isNotNull() & F.col(i).isNotNull() & ~F.greatest(*[F.col(c).isNull() for c in by], F.lit(False))
    tol = (tolerance_s if isinstance(tolerance_s, Column) else F.lit(float(tolerance_s))).cast("double")
    a = left.where(known(lt, ids[0])).select(
        ent.alias("ent"), micros(lt).alias("t"), F.round(F.least(tol, F.lit(float(max_tolerance_s))) * 1e6).cast("long").alias("tol"), F.col(ids[0]).alias("lid")
    )
    a = a.where(F.col("tol").isNotNull())
    b = right.where(known(rt, ids[1])).select(ent.alias("ent"), micros(rt).alias("t"), F.col(ids[1]).alias("rid"))

    margin = int(round(max_tolerance_s * 1e6))
    unit = _DAY * max(1, -(-8 * margin // _DAY))
    halves = min(_HALVES, int(np.log2(max(1, unit // max(1, 8 * margin)))))
    block = lambda t: F.floor(t / F.lit(unit))
    # One narrow pass over both sides: rows of each entity and day.
    where = a.select("ent", block(F.col("t")).alias("block")).unionAll(b.select("ent", block(F.col("t")).alias("block")))
    counts = where.groupBy("ent", "block").count()
    size = counts.agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    # As many tasks as the rows need, also where the session's number of partitions is small; four slots a task even them out.
    tasks = max(shuffle_partitions(spark), -(-(size["rows"] or 0) // target_rows))
    slots = 4 * tasks
    if (size["most"] or 0) > target_rows:
        a, b = _cut(a, b, counts, unit, halves, margin, target_rows, Scratch(spark, "nearest"))
    else:
        a = a.withColumn("block", block(F.col("t"))).withColumn("part", F.lit(0)).withColumn("salt", F.lit(0))
        b = b.withColumn("block", F.explode(F.sequence(block(F.col("t") - margin), block(F.col("t") + margin)))).withColumn("part", F.lit(0)).withColumn("salt", F.lit(0))
    slot = F.pmod(F.xxhash64("ent", "block", "part", "salt"), F.lit(slots)).cast("int").alias("slot")
    a, b = a.select(slot, "ent", "t", "tol", "lid"), b.select(slot, "ent", "t", "rid")

    out = f"{ids[0]} {left.schema[ids[0]].dataType.simpleString()}, {ids[1]} {right.schema[ids[1]].dataType.simpleString()}, dt_s double"
    arrow = to_arrow_schema(spark.createDataFrame([], out).schema)

    def search(x: pa.Table, y: pa.Table) -> pa.Table:
        return _search(x, y, arrow)

    return a.repartition(tasks, "slot").groupBy("slot").cogroup(b.repartition(tasks, "slot").groupBy("slot")).applyInArrow(search, out)
