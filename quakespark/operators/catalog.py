"""Selection, matching and merging of catalogue tables (stations, events, picks, attenuation readings)."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.common import Scratch, micros, shuffle_partitions

#: Labels read as first arrivals; case matters.
P_LABELS = ["P", "Pg", "Pn", "Pb", "P*", "Pp", "PG", "PN", "p"]
S_LABELS = ["S", "Sg", "Sn", "Sb", "S*", "SG", "SN", "s"]
#: How much origins are trusted, the lowest first.
ORIGIN_RANK = {"manual": 0, "catalog": 1, "automatic": 2}


def phase_of(label: Column | str) -> Column:
    """'P' or 'S' of a phase label, null for a later or unknown one."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c.isin(P_LABELS), "P").when(c.isin(S_LABELS), "S")


def usable(disabled: str = "disabled", quality: str = "quality", sigma: str = "sigma_s") -> Column:
    """Not disabled, quality better than 4, and a positive finite uncertainty."""
    s = F.col(sigma)
    return F.coalesce((F.col(disabled).cast("int") == 0) & (F.col(quality) < 4) & (s > 0) & ~F.isnan(s) & (s < float("inf")), F.lit(False))


def weight(sigma: str = "sigma_s") -> Column:
    return 1 / F.greatest(F.lit(0.01), F.col(sigma))


def origin_rank(origin: str = "origin") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ORIGIN_RANK.items() for x in kv])[F.col(origin)], F.lit(1))


def best_picks(picks: DataFrame, *, time: str = "travel_time_s", tie: str = "seq", automatic: str = "if_few_analyst_picks", few: int = 8, phases: list[str] | None = None) -> DataFrame:
    """One usable pick per (event, station, phase), stations compared ignoring case: by trust in its origin, then uncertainty, time and `tie`.

    `automatic`: 'always', 'never', or 'if_few_analyst_picks', which drops automatic picks of events with `few` analyst picks or more
    (of all phases, counted before `phases` selects). Two windows, of which the second's shuffle key extends the first's.
    """
    p = picks.where(usable())
    if automatic == "never":
        p = p.where(F.col("origin") != "automatic")
    elif automatic == "if_few_analyst_picks":
        analyst = F.count(F.when(F.col("origin") != "automatic", 1)).over(Window.partitionBy("event"))
        p = p.withColumn("_analyst", analyst).where((F.col("origin") != "automatic") | (F.col("_analyst") < few)).drop("_analyst")
    if phases:
        p = p.where(F.col("phase").isin(phases))
    order = Window.partitionBy("event", F.upper(F.col("station").cast("string")), "phase").orderBy(origin_rank(), "sigma_s", time, tie)
    return p.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def count_phases(picks: DataFrame) -> DataFrame:
    """Usable P and S picks in all."""
    return picks.where(usable()).agg(*[F.count(F.when(F.col("phase") == p, 1)).alias(f"picks_{p.lower()}") for p in "PS"])


def match(left: DataFrame, right: DataFrame, on: list[str], *, fold: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(matched rows, left rows without a partner). Columns in `fold` are compared without case."""
    key = lambda d, c: F.upper(d[c]) if c in fold else d[c]
    cond = reduce(Column.__and__, [key(left, c) == key(right, c) for c in on])
    keep = [right[c] for c in right.columns if c not in on]
    return left.join(right, cond).select(left["*"], *keep), left.join(right, cond, "left_anti")


def first_wins(tables: list[DataFrame], key: str, *, fold: bool = False, order: str | None = None) -> DataFrame:
    """Union of tables of one kind; of rows with the same key the first table's stays, and in a table the first by `order`."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("_source", F.lit(i)) for i, t in enumerate(tables)])
    k = F.upper(key) if fold else F.col(key)
    w = Window.partitionBy(k).orderBy("_source", *([order] if order else []))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_source")


def replace_automatic(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing picks but the automatic ones, and the new picks."""
    return existing.where(F.col("origin") != "automatic").unionByName(new, allowMissingColumns=True)


def override_hypocentres(events: DataFrame, relocated: DataFrame, columns: list[str], key: str = "event") -> DataFrame:
    """Events with the coordinates of another table where it has them."""
    r = relocated.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = events.join(r, events[key] == r["_k"], "left")
    return j.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in events.columns])


def relabel_networks(picks: DataFrame, stations: DataFrame, *, station: str = "station", id: str = "id") -> DataFrame:
    """Picks whose station is unknown get the id of the only station with the same code after the network, if there is just one."""
    ids = stations.select(F.col(id).alias("_id"), F.upper(F.element_at(F.split(id, r"\."), -1)).alias("_code"))
    unique = ids.groupBy("_code").agg(F.count_distinct(F.upper("_id")).alias("_n"), F.min("_id").alias("_new")).where("_n = 1").drop("_n")
    known = ids.select(F.upper("_id").alias("_known")).distinct()
    j = picks.join(known, F.upper(station) == F.col("_known"), "left")
    j = j.join(unique, F.col("_known").isNull() & (F.upper(F.element_at(F.split(station, r"\."), -1)) == F.col("_code")), "left")
    return j.select(*[F.coalesce("_new", station).alias(station) if c == station else F.col(c) for c in picks.columns])


def p_and_s(picks: DataFrame, time: str = "travel_time_s", tie: str = "seq") -> DataFrame:
    """(event, station, p_time, s_time): the P and S of smallest uncertainty where there are both. One aggregation, no self-join."""
    best = lambda ph: F.min(F.when(F.col("phase") == ph, F.struct("sigma_s", time, tie)))[time]
    g = picks.where(usable()).groupBy("event", "station").agg(best("P").alias("p_time"), best("S").alias("s_time"))
    return g.where("p_time is not null and s_time is not null")


def _covering(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(breaks, epoch, last) of one channel's epochs (start, end, order, number; null or NaN start: never inside, end: open): the first epoch by
    order at each break and in the gap before it, and after all (-1: none), and the last epoch by order."""
    g = g.sort_values(["order", "number"], kind="stable")
    number, start, end = g["number"].to_numpy(), g["start"].to_numpy(float), g["end"].to_numpy(float)
    breaks = np.unique(np.concatenate([start[~np.isnan(start)], end[~np.isnan(end)]]))
    first = np.where(np.isnan(start), 2 * len(breaks) + 1, 2 * np.searchsorted(breaks, start) + 1)
    upto = np.where(np.isnan(end), 2 * len(breaks), 2 * np.searchsorted(breaks, end) + 1)
    epoch, open_, k = np.full(2 * len(breaks) + 1, -1, np.int64), [], 0
    by = np.argsort(first, kind="stable")
    for at in range(len(epoch)):
        while k < len(by) and first[by[k]] <= at:
            heapq.heappush(open_, int(by[k]))
            k += 1
        while open_ and upto[open_[0]] < at:
            heapq.heappop(open_)
        if open_:
            epoch[at] = number[open_[0]]
    return breaks, epoch, int(number[-1])


def _looked_up(t: np.ndarray, breaks: np.ndarray, epoch: np.ndarray, last: int) -> np.ndarray:
    at = np.searchsorted(breaks, t)
    same = at < len(breaks)
    same[same] = breaks[at[same]] == t[same]
    found = epoch[2 * at + same]
    return np.where(np.isnan(t) | (found < 0), last, found)


def epoch_of(rows: DataFrame, epochs: DataFrame, *, on: str, time: str, start: str = "start", end: str = "end", order: str = "ordinal", key: str = "key", breaks: int = 4_000_000) -> DataFrame:
    """Each row with the first epoch (by `order`) that holds its time, else the last epoch; rows without epochs have nulls. Times are numbers or
    timestamps; a null or NaN time lies in no epoch.

    Each channel's epochs become breaks with the epoch that holds from each on, in which a row's time is searched: the work does not
    grow with the epochs of a channel. Up to `breaks` of them are broadcast; more are sent to the distinct times of their channel, which are spread.
    """
    spark, kind = rows.sparkSession, epochs.schema[on].dataType.simpleString()
    scratch = Scratch(spark, "epochs")
    number = lambda d, c: (micros(c) if "timestamp" in d.schema[c].dataType.simpleString() else F.col(c)).cast("double")
    e = scratch.keep(epochs.withColumn("_epoch", F.monotonically_increasing_id()))
    spans = e.where(F.col(on).isNotNull()).select(F.col(on).alias("_on"), number(epochs, start).alias("start"), number(epochs, end).alias("end"), F.col(order).alias("order"), F.col("_epoch").alias("number"))

    def made(g: pd.DataFrame) -> pd.DataFrame:
        b, n, last = _covering(g)
        return pd.DataFrame({"_on": g["_on"].iloc[:1], "breaks": [b], "epoch": [n], "last": [last]})

    held = scratch.keep(spans.groupBy("_on").applyInPandas(made, f"_on {kind}, breaks array<double>, epoch array<long>, last long"))
    t = number(rows, time)
    if (held.agg(F.sum(F.size("breaks"))).first()[0] or 0) <= breaks:
        shared = spark.sparkContext.broadcast({r["_on"]: (np.array(r["breaks"], float), np.array(r["epoch"], np.int64), r["last"]) for r in held.toLocalIterator()})

        @F.pandas_udf("long")
        def epoch(c: pd.Series, x: pd.Series) -> pd.Series:
            out, x = np.full(len(c), -1, np.int64), x.to_numpy(float)
            code, known = pd.factorize(c)
            for k, v in enumerate(known):
                if v in shared.value:
                    of = code == k
                    out[of] = _looked_up(x[of], *shared.value[v])
            return pd.Series(out)

        j = rows.withColumn("_epoch", epoch(on, t))
    else:
        salts = shuffle_partitions(spark)
        x = rows.select(F.col(on).cast(kind).alias("_on"), t.alias("_t")).where("_on is not null").distinct().withColumn("_salt", F.pmod(F.xxhash64("_t"), F.lit(salts)))

        def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame(columns=["_on", "_t", "_epoch"])
            r = b.iloc[0]
            return a[["_on", "_t"]].assign(_epoch=_looked_up(a["_t"].to_numpy(float), np.asarray(r["breaks"], float), np.asarray(r["epoch"]), int(r["last"])))

        sent = held.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        known = x.groupBy("_on", "_salt").cogroup(sent.groupBy("_on", "_salt")).applyInPandas(search, f"_on {kind}, _t double, _epoch long")
        # Null times come back from pandas as NaN; both lie in no epoch.
        nan = F.lit(float("nan"))
        known = known.select("_on", F.coalesce("_t", nan).alias("_t"), "_epoch").dropDuplicates(["_on", "_t"])
        j = rows.withColumn("_time", F.coalesce(t, nan))
        j = j.join(known, (F.col(on).cast(kind) == F.col("_on")) & (F.col("_time") == F.col("_t")), "left").drop("_on", "_t", "_time")
    j = j.join(e.drop(on), "_epoch", "left").drop("_epoch")
    inside = F.coalesce((F.col(start) <= F.col(time)) & (F.col(end).isNull() | (F.col(time) <= F.col(end))), F.lit(False))
    w = Window.partitionBy(key).orderBy(inside.desc(), F.when(inside, F.col(order)).otherwise(-F.col(order)))
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlapping(a: DataFrame, b: DataFrame, *, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float) -> DataFrame:
    """Rows of a and b whose spans (numbers) overlap, each pair once. Both sides meet in ranges of `width`, and a pair is made in the range
    where the later of the two starts: an equi-join, where a plain condition would be a nested loop."""
    spread = lambda d, s: d.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(s[0]) / width), F.floor(F.col(s[1]) / width))))
    x, y = spread(a, a_span), spread(b, b_span).withColumnsRenamed({c: f"_b_{c}" for c in on})
    cond = reduce(Column.__and__, [F.col(c) == F.col(f"_b_{c}") for c in on], x["_cell"] == y["_cell"])
    cond = cond & (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1]))
    j = x.join(y, cond).where(x["_cell"] == F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / width))
    return j.drop("_cell", *[f"_b_{c}" for c in on])


def azimuthal_gap(rows: DataFrame, by: list[str], azimuth: str = "azimuth", distinct: bool = True) -> DataFrame:
    """(by..., gap_deg): the largest difference between neighbouring azimuths around the circle; 360 for fewer than two."""
    r = rows.select(*by, F.col(azimuth).alias("_a"))
    r = r.distinct() if distinct else r
    w = Window.partitionBy(*by).orderBy("_a")
    r = r.withColumn("_d", F.col("_a") - F.lag("_a").over(w))
    g = r.groupBy(*by).agg(F.max("_d").alias("_m"), (360 - F.max("_a") + F.min("_a")).alias("_wrap"), F.count(F.lit(1)).alias("_n"))
    return g.select(*by, F.when(F.col("_n") < 2, 360.0).otherwise(F.greatest("_m", "_wrap")).alias("gap_deg"))


def takeoff_gap(rows: DataFrame, by: list[str], takeoff: str = "takeoff") -> DataFrame:
    """(by..., gap_deg): the largest gap between takeoff angles folded into 0..90, both ends included."""
    t = F.when(F.col(takeoff) > 90, 180 - F.col(takeoff)).otherwise(F.col(takeoff))
    ends = rows.select(*by).distinct().select(*by, F.explode(F.array(F.lit(0.0), F.lit(90.0))).alias("_t"))
    r = rows.select(*by, t.alias("_t")).unionByName(ends)
    d = r.withColumn("_d", F.col("_t") - F.lag("_t").over(Window.partitionBy(*by).orderBy("_t")))
    return d.groupBy(*by).agg(F.max("_d").alias("gap_deg"))


def residual_statistics(rows: DataFrame, *, residual: str, sigma: str = "sigma_s", rejected: str = "rejected") -> DataFrame:
    """Counts, RMS by phase, weighted RMS of accepted residuals, in one aggregation."""
    ok = ~F.col(rejected) & F.col(residual).isNotNull() & ~F.isnan(residual)
    sq = lambda c: F.sqrt(F.sum(F.when(c, F.pow(residual, 2))) / F.count(F.when(c, 1)))
    w = F.when(ok, 1 / F.pow(F.greatest(F.lit(0.01), F.col(sigma)), 2))
    return rows.agg(
        F.count(F.when(ok, 1)).alias("used"), F.count(F.when(~ok, 1)).alias("rejected"), sq(ok).alias("rms"), sq(ok & (F.col("phase") == "P")).alias("rms_p"), sq(ok & (F.col("phase") == "S")).alias("rms_s"),
        F.sqrt(F.sum(w * F.pow(residual, 2)) / F.sum(w)).alias("weighted_rms"),
    )


def station_statistics(rows: DataFrame, residual: str) -> DataFrame:
    """Mean residual and number by phase, per station."""
    agg = []
    for p in "PS":
        x = F.when((F.col("phase") == p) & ~F.col("rejected"), F.col(residual))
        agg += [F.avg(x).alias(f"mean_{p.lower()}"), F.count(x).alias(f"n_{p.lower()}")]
    return rows.groupBy("station").agg(*agg)


def event_statistics(rows: DataFrame, residual: str) -> DataFrame:
    """RMS and numbers of phases per event."""
    ok = ~F.col("rejected")
    return rows.groupBy("event").agg(
        F.sqrt(F.avg(F.when(ok, F.pow(residual, 2)))).alias("rms"), *[F.count(F.when(ok & (F.col("phase") == p), 1)).alias(f"n_{p.lower()}") for p in "PS"], F.count(F.when(~ok, 1)).alias("n_rejected")
    )
