"""Implausible readings of instruments: physical limits, and readings out of keeping with their source.

Every reading is scored by an isolation forest of its source, on level, difference to the reading before, seasonal (part of the day),
spike, run-length and flag features, each relative to the source's normal behaviour. Trees come in views: one of difference and season
together, and one for each other feature; a reading's score is that of the view in which it stands out most. Readings whose score
reaches their source's threshold are candidates, and the rule for what makes them implausible is checked exactly. The threshold is
the least score that the forest can give to any reading to which a rule applies, from the boxes of its leaves, so that none is lost,
also in a source that is stuck most of the time; where such readings stand out, it keeps all others out. Physical limits need no score.

Scale. Readings are range-partitioned by (source, time), so that a source with a third of all rows lies on many tasks; runs that cross an
edge of a batch or partition are joined from their parts. Medians are exact: sketches of bounded size in small sources, and sketches that
bracket the middle followed by an ordering of what lies in between in large ones. Forests are fitted on about `sample_rows` readings a
source chosen by hash, which is how isolation forests are defined, and sources are scored in chunks of bounded size. A forest takes
milliseconds to fit and would be larger than most sources' readings to send, so each chunk fits it anew from the same sample.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quakespark.common import Scratch, finite, shuffle_partitions, spread
from quakespark.operators import stats

FEATURES = ["level", "difference", "seasonal", "spike_level", "run", "flat_set", "clipped_set"]
#: Features that the trees of each view may cut.
VIEWS = [[0], [1, 2], [3], [4], [5], [6]]
#: Rows of a source up to which a sketch's median is exact.
ACCURACY = 10_000


def median_of(c: Column, accuracy: int = ACCURACY) -> Column:
    """The median, of an even number of values the mean of the middle two; rank error at most n / accuracy, none below that many rows."""
    ends = F.percentile_approx(c, [0.5 - 1e-9, 0.5 + 1e-9], accuracy)
    return (ends[0] + ends[1]) / 2


#: The range of each feature that trees cut at least, also where a sample holds no unusual value: 10 spreads, a flag's two values, 5 in a run.
RANGE = np.array([[-2.4, 2.4], [-2.4, 2.4], [-2.4, 2.4], [-2.4, 2.4], [0.0, 1.6], [0.0, 1.0], [0.0, 1.0]])


def _expected(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 3.0)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2.0 * (np.log(m - 1) + 0.5772156649015329) - 2.0 * (m - 1) / m))


@dataclass
class Forest:
    """Isolation trees of several views as flat arrays of nodes; the first nodes are the roots. A leaf is its own child."""

    view: np.ndarray  # of each tree
    tree: np.ndarray  # of each node
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # left and right child of node k at 2k and 2k + 1
    path: np.ndarray  # path length, where a node is a leaf
    leaf: np.ndarray
    low: np.ndarray  # a node's box; open below or above where it is the root's
    high: np.ndarray
    depth: int
    scale: float  # path length that stands for a score of a half

    def paths(self, x: np.ndarray, view: int, rows_at_once: int = 20_000) -> np.ndarray:
        """Mean path length of rows in a view's trees. All trees are walked together, a level at a time."""
        roots = np.flatnonzero(self.view == view).astype(np.int32)
        out, m = np.empty(len(x)), x.shape[1]
        for k in range(0, len(x), rows_at_once):
            part = np.ascontiguousarray(x[k : k + rows_at_once])
            flat, row = part.ravel(), (np.arange(len(part), dtype=np.int32) * m)[:, None]
            node = np.broadcast_to(roots, (len(part), len(roots)))
            for _ in range(self.depth):
                node = self.child[2 * node + (flat[row + self.feature[node]] > self.threshold[node])]
            out[k : k + rows_at_once] = self.path[node].mean(1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Score in 0..1 of each row in the view where it stands out most; higher is more unusual."""
        best = np.full(len(x), np.inf)
        for v, features in enumerate(VIEWS):
            if len(features) == 1:  # few different values
                u, back = np.unique(x[:, features[0]], return_inverse=True)
                rows = np.zeros((len(u), x.shape[1]))
                rows[:, features[0]] = u
                best = np.minimum(best, self.paths(rows, v)[back])
            else:
                best = np.minimum(best, self.paths(x, v))
        return 2.0 ** (-best / self.scale)

    def least_score(self, feature: int, low: float = -np.inf, high: float = np.inf) -> float:
        """A bound: no reading whose feature is from low to high (a half-line) has a lower score, whatever its other features are."""
        v = next(k for k, f in enumerate(VIEWS) if feature in f)
        l, h = self.low[:, feature], self.high[:, feature]
        roots = len(self.view)
        l, h = np.where(l <= l[:roots][self.tree], -np.inf, l), np.where(h >= h[:roots][self.tree], np.inf, h)
        reached = self.leaf & (self.view[self.tree] == v) & (h >= low) & (l < high)
        longest = np.zeros(roots)
        np.maximum.at(longest, self.tree[reached], self.path[reached])
        return float(2.0 ** (-longest[self.view == v].mean() / self.scale))


def fit_forest(x: np.ndarray, rng: np.random.Generator, trees: int, size: int) -> Forest:
    """A forest with `trees` trees a view (half as many where it has one feature), each on `size` rows of x. Trees grow together, level by level.

    A node cuts its box, not only the span of its sample, so that a value of which the sample has none is set apart as well.
    """
    n, m = x.shape
    k = min(n, size)
    limit = int(np.ceil(np.log2(max(2, k)))) + 3
    view = np.repeat(np.arange(len(VIEWS)), [trees if len(f) > 1 else max(1, trees // 2) for f in VIEWS])
    width = np.array([len(f) for f in VIEWS])
    choice = np.zeros((len(VIEWS), max(width)), np.int64)
    for v, f in enumerate(VIEWS):
        choice[v, : len(f)] = f
    t = len(view)
    rows = x[np.argpartition(rng.random((t, n)), k - 1, axis=1)[:, :k]].reshape(-1, m)
    at = np.repeat(np.arange(t), k)
    tree, low, high = np.arange(t), np.tile(np.minimum(x.min(0), RANGE[:, 0]), (t, 1)), np.tile(np.maximum(x.max(0), RANGE[:, 1]), (t, 1))
    levels, first = [], 0
    for depth in range(limit + 1):
        count = np.bincount(at, minlength=len(tree))
        split = np.flatnonzero((count >= 2) & (depth < limit))
        f = choice[view[tree], (rng.random(len(tree)) * width[view[tree]]).astype(np.int64)]
        every = np.arange(len(tree))
        cut = low[every, f] + rng.random(len(tree)) * (high[every, f] - low[every, f])
        child = np.repeat(first + every, 2)
        after = first + len(tree)
        child[2 * split], child[2 * split + 1] = after + 2 * np.arange(len(split)), after + 2 * np.arange(len(split)) + 1
        leaf = np.ones(len(tree), bool)
        leaf[split] = False
        levels.append((tree, f, cut, child, depth + _expected(count), leaf, low, high))
        if not len(split):
            break
        new = np.full(len(tree), -1)
        new[split] = np.arange(len(split))
        stay = new[at] >= 0
        rows, at = rows[stay], at[stay]
        at = 2 * new[at] + (rows[np.arange(len(at)), f[at]] > cut[at])
        first, tree = after, np.repeat(tree[split], 2)
        below, above = np.repeat(low[split], 2, 0), np.repeat(high[split], 2, 0)
        pair = np.arange(len(split))
        above[2 * pair, f[split]], below[2 * pair + 1, f[split]] = cut[split], cut[split]
        low, high = below, above
    parts = [np.concatenate(z) for z in zip(*levels)]
    return Forest(view, parts[0], parts[1].astype(np.int32), parts[2], parts[3].astype(np.int32), parts[4], parts[5], parts[6], parts[7], len(levels) - 1, max(float(_expected(k)), 1e-9))


def least_scores(forest: Forest, limit: float, rare_share: float, stuck: int) -> float:
    """The threshold of a source: no reading with one of the rules of `implausible_readings` has a lower score."""
    less = 1 - 1e-9  # for rounding
    far = float(np.log1p(limit)) * less
    return min(
        forest.least_score(0, low=far), forest.least_score(0, high=-far), forest.least_score(3, low=float(np.log1p(limit - 1)) * less), forest.least_score(4, low=float(np.log(stuck)) * less),
        forest.least_score(5, low=(1 - rare_share) * less), forest.least_score(6, low=(1 - rare_share) * less),
    )


def mark_runs(readings: DataFrame, source: str, order: list[str], value: str, scratch: Scratch) -> DataFrame:
    """Readings with `previous` (the value before, within the source) and `run_length` (successive readings with the same value).

    A null or NaN value is a run of its own. The order must be total, the value a double. Only runs at an edge of a batch are put together from
    rows; two rows a partition reach the driver.
    """
    parts = shuffle_partitions(readings.sparkSession)
    sorted_ = readings.repartitionByRange(parts, source, *order).sortWithinPartitions(source, *order)
    cols = readings.columns
    si, vi = cols.index(source), cols.index(value)

    def mark(batches):
        part, last, run, row = TaskContext.get().partitionId(), None, -1, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            s, v = b.column(si), b.column(vi).to_numpy(zero_copy_only=False).astype(np.float64)
            same_source, before = np.zeros(n, bool), np.full(n, np.nan)
            if n > 1:
                same_source[1:] = pc.fill_null(pc.equal(s.slice(1), s.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
                before[1:] = v[:-1]
            if last is not None and last[0] is not None and last[0] == s[0].as_py():
                same_source[0], before[0] = True, last[1]
            ids = run + np.cumsum(~(same_source & (before == v)))
            length = np.bincount(ids - ids[0])[ids - ids[0]]
            edge = (ids == ids[0]) | (ids == ids[-1])
            new = [np.where(same_source, before, np.nan), (np.int64(part) << 40) + ids, row + np.arange(n), length.astype(np.int32), edge]
            last, run, row = (s[n - 1].as_py(), float(v[-1])), int(ids[-1]), row + n
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x) for x in new]], names=[*cols, "previous", "run", "row", "run_length", "edge"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in readings.schema)
    marked = scratch.keep(sorted_.mapInArrow(mark, fields + ", previous double, run bigint, row bigint, run_length int, edge boolean"))
    at_edge = marked.where("edge")
    runs = at_edge.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.first(source).alias("s"), F.first(value).alias("v"))
    # Runs at the edges of partitions: the first and last of each, at most two a partition.
    ends = at_edge.groupBy(F.shiftright("run", 40).alias("part")).agg(F.min("run").alias("a"), F.max("run").alias("z")).select(F.explode(F.array("a", "z")).alias("run")).distinct()
    rows = runs.join(ends, "run").orderBy("run").collect()
    longer: dict[int, int] = {}
    chain: list = []
    for r in [*rows, None]:
        joined = bool(chain) and r is not None and r["s"] is not None and r["s"] == chain[-1]["s"] and r["v"] is not None and r["v"] == chain[-1]["v"] and (r["run"] >> 40) != (chain[-1]["run"] >> 40)
        if not joined:
            if len(chain) > 1:
                total = sum(c["n"] for c in chain)
                longer |= {c["run"]: total for c in chain}
            chain = []
        if r is not None:
            chain.append(r)
    totals = runs.select("run", "n")
    if longer:
        fix = F.create_map(*[F.lit(x) for kv in longer.items() for x in kv])
        totals = totals.withColumn("n", F.coalesce(fix[F.col("run")], F.col("n")))
    ended = at_edge.join(totals, "run").select(*cols, "previous", F.col("n").cast("int").alias("run_length"))
    return marked.where("not edge").select(*cols, "previous", "run_length").unionByName(ended)


def implausible_readings(
    reports: DataFrame, *, source: str = "nslc", key: str = "report_id", time: str = "start_time", loaded_at: str = "loaded_at", limit: float = 10.0, rare_share: float = 0.2, stuck: int = 5,
    trees: int = 32, tree_rows: int = 64, sample_rows: int = 512, chunk_rows: int = 200_000,
) -> DataFrame:
    """One row a report: (key, score, impossible, off_level, many_spikes, rare_flat, rare_clipped, stuck_run, candidate, flagged).

    `impossible`: max_abs or rms negative or infinite, max_abs below rms, spikes negative or above samples, or a flat report that is clipped or
    has spikes. `off_level`, `many_spikes`: further than `limit` spreads from the source's median of ln max_abs; more spikes than
    `limit` times one plus the source's median (impossible reports left out of both). `rare_flat`, `rare_clipped`: set where the source has it set
    in under `rare_share` of its known values. `stuck_run`: one of `stuck` or more successive reports with the same max_abs. `score`: the forest's; `candidate`:
    at least its source's threshold. `flagged`: impossible, or a candidate to which a rule applies.

    Nulls and NaN are unknown, not unusual: no rule applies to them and they end a run. A report delivered several times counts once, by its
    first delivery; null keys do not count. Reports without source form one source for physical limits only. Ties in time are ordered by
    key. Empty tables give an empty result; other columns are ignored.
    """
    scratch = Scratch(reports.sparkSession, "readings")
    wanted = [key, source, time, "samples", "max_abs", "rms", "flat", "clipped", "spikes"]
    once = Window.partitionBy(key).orderBy(F.col(loaded_at).asc_nulls_last())
    r = reports.where(F.col(key).isNotNull()).select(*wanted, loaded_at).withColumn("once", F.row_number().over(once)).where("once = 1").select(*wanted)
    r = r.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(time).alias("t"), "samples", F.col("max_abs").cast("double").alias("max_abs"), F.col("rms").cast("double").alias("rms"), "flat", "clipped", "spikes")
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    is_ = lambda c: F.coalesce(c, F.lit(False))
    bad = is_(known("max_abs") & ((F.col("max_abs") < 0) | (F.col("max_abs") == float("inf")))) | is_(known("rms") & ((F.col("rms") < 0) | (F.col("rms") == float("inf"))))
    bad = bad | is_(known("max_abs") & known("rms") & (F.col("max_abs") < F.col("rms"))) | is_(F.col("spikes") < 0) | is_(F.col("spikes") > F.col("samples"))
    bad = bad | is_(F.col("flat") & (F.col("clipped") | (F.col("spikes") > 0)))
    # `flat and clipped` is true also where spikes is null, and the other way round.
    bad = bad | is_(F.col("flat") & F.col("clipped")) | is_(F.col("flat") & (F.col("spikes") > 0))
    ln = F.when(finite("max_abs") & (F.col("max_abs") >= 0) & ~F.col("impossible"), F.ln(F.greatest("max_abs", F.lit(1e-300))))
    part_of_day = F.floor(F.hour("t") / 6)
    r = mark_runs(r.withColumn("impossible", bad).withColumn("ln", ln).withColumn("quarter", part_of_day), "s", ["t", "k"], "max_abs", scratch)

    calm = lambda c: F.when(~F.col("impossible"), F.col(c))
    share = lambda c: F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("int")))
    base = r.where(F.col("s").isNotNull()).groupBy("s").agg(
        median_of(F.col("ln")).alias("ln_median"), median_of(calm("spikes")).alias("spike_median"), share("flat").alias("flat_share"), share("clipped").alias("clipped_share"), F.count(F.lit(1)).alias("n")
    )
    base = scratch.keep(base)
    big = base.where(F.col("n") > ACCURACY).select("s")
    large = big.limit(1).count() > 0  # sources whose sketches may be a rank off

    def exact(b: DataFrame, rows: DataFrame, value: Column, name: str) -> DataFrame:
        m = stats.median(rows.join(big, "s", "left_semi").select("s", value.alias("v")), ["s"], "v").select("s", F.col("median").alias("m"))
        return b.join(m, "s", "left").withColumn(name, F.coalesce("m", name)).drop("m")

    if large:
        base = scratch.keep(exact(exact(base, r, F.col("ln"), "ln_median"), r, calm("spikes").cast("double"), "spike_median"))
    levelled = r.join(base.select("s", "ln_median"), "s").withColumn("off", F.abs(F.col("ln") - F.col("ln_median")))
    scatter = levelled.groupBy("s").agg(
        median_of(F.col("off")).alias("ln_spread"),
        median_of(F.abs(F.col("ln") - F.ln(F.when((F.col("previous") > 0) & finite("previous"), F.col("previous"))))).alias("step_spread"),
    )
    if large:
        scatter = exact(scratch.keep(scatter), levelled, F.col("off"), "ln_spread")
    season = r.where(F.col("s").isNotNull()).groupBy("s", "quarter").agg(median_of(F.col("ln")).alias("quarter_median"))
    base = scratch.keep(base.join(scatter, "s"))
    r = r.join(base, "s", "left").join(season, ["s", "quarter"], "left")
    per = lambda c, scale: F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0)) / F.greatest(F.coalesce(F.when(~F.isnan(scale), scale), F.lit(0.0)), F.lit(1e-300))
    squeeze = lambda c: F.signum(c) * F.log1p(F.abs(c))
    step = F.col("ln") - F.ln(F.when((F.col("previous") > 0) & finite("previous"), F.col("previous")))
    r = r.select(
        "k", "s", "impossible", "n",
        is_(F.abs(F.col("ln") - F.col("ln_median")) > limit * F.col("ln_spread")).alias("off_level"),
        is_(~F.col("impossible") & (F.col("spikes") > limit * (1 + F.col("spike_median")))).alias("many_spikes"),
        is_(F.col("flat") & (F.col("flat_share") < rare_share)).alias("rare_flat"),
        is_(F.col("clipped") & (F.col("clipped_share") < rare_share)).alias("rare_clipped"),
        (known("max_abs") & (F.col("run_length") >= stuck) & F.col("s").isNotNull()).alias("stuck_run"),
        squeeze(per(F.col("ln") - F.col("ln_median"), F.col("ln_spread"))).alias("level"),
        squeeze(per(step, F.col("step_spread"))).alias("difference"),
        squeeze(per(F.col("ln") - F.col("quarter_median"), F.col("ln_spread"))).alias("seasonal"),
        F.coalesce(squeeze((F.col("spikes") - F.col("spike_median")) / (1 + F.col("spike_median"))), F.lit(0.0)).alias("spike_level"),
        F.when(known("max_abs"), F.log1p(F.col("run_length") - 1)).otherwise(0.0).alias("run"),
        F.when(F.col("flat"), 1 - F.col("flat_share")).otherwise(0.0).alias("flat_set"),
        F.when(F.col("clipped"), 1 - F.col("clipped_share")).otherwise(0.0).alias("clipped_set"),
    )
    r = scratch.keep(r)
    judged = r.where(F.col("s").isNotNull())
    chunks = F.ceil(F.col("n") / chunk_rows).cast("int")
    mixed = F.xxhash64(F.lit(17), "k")
    sample = judged.where(F.pmod(mixed, F.lit(1_000_000)) < F.lit(1_000_000.0) * sample_rows / F.col("n"))
    # New names: a co-group of two branches of one table must not share its columns.
    sample = sample.select(F.concat("s").alias("sample_s"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("sample_chunk"), *[(F.col(c) + 0.0).alias(f"x_{c}") for c in FEATURES])
    rules = ["impossible", "off_level", "many_spikes", "rare_flat", "rare_clipped", "stuck_run"]
    judged = judged.select("k", "s", F.pmod(F.xxhash64("k"), chunks).cast("int").alias("chunk"), *rules, *FEATURES)
    kind = reports.schema[key].dataType.simpleString()
    fields = f"k {kind}, score double, " + ", ".join(f"{c} boolean" for c in rules) + ", candidate boolean"
    arrow = to_arrow_schema(reports.sparkSession.createDataFrame([], fields).schema)
    plain = lambda t, c: t[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return arrow.empty_table()
        x = np.stack([plain(a, c) for c in FEATURES], 1)
        fitted = np.stack([plain(b, f"x_{c}") for c in FEATURES], 1) if b.num_rows else x
        fitted = fitted[np.lexsort(fitted.T)]  # the forest does not depend on the order of rows
        forest = fit_forest(fitted, np.random.default_rng(zlib.crc32(str(a["s"][0].as_py()).encode())), trees, tree_rows)
        s = forest.scores(x)
        found = s >= least_scores(forest, limit, rare_share, stuck) - 1e-12
        return pa.table([a["k"], pa.array(s), *[a[c] for c in rules], pa.array(found)], schema=arrow)

    scored = spread(judged, "s", "chunk").groupBy("s", "chunk").cogroup(spread(sample, "sample_s", "sample_chunk").groupBy("sample_s", "sample_chunk")).applyInArrow(judge, fields)
    rest = r.where(F.col("s").isNull()).select("k", F.lit(None).cast("double").alias("score"), *rules, F.lit(False).alias("candidate"))
    out = scored.unionByName(rest)
    applies = F.greatest(*[F.col(c) for c in rules[1:]])
    return out.withColumn("flagged", F.col("impossible") | (F.col("candidate") & applies)).withColumnRenamed("k", key)
