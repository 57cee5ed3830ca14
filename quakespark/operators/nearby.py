"""Points near other points: pairs within a straight-line distance on and below a sphere.

Latitude is range-partitioned into strips of about equal population, and a strip with many points into longitude sectors; each point is
also sent to the cells its partners may own. A pair is owned by one cell: that of its southern point by strip, or of the smaller id
within a strip. In a cell, points are swept in latitude bands of the radius's height: the active set is the band and the next one in
longitude order, a binary search gives each point's window of it, and distances are verified in blocks.

Scale. One shuffle of (cell, ids, lat, lon, radius), replicated only across edges. Strips and sectors come from counts on a fine grid, so
that a cluster is cut finer down to some tens of metres, and cells are looked up by binary search; points at exactly one place are compared once a
place, and pairs of places expanded to ids in the cell. Pairs leave it block by block and are not shuffled, but those of ids that have
several places. What reaches the driver is one number for each cell of `target_rows` points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakespark.common import Scratch, finite, shuffle_partitions
from quakespark.common import spread as spread_out

EARTH_KM = 6371.0


def _xyz(lat, lon, r):
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([r * np.cos(la) * np.cos(lo), r * np.cos(la) * np.sin(lo), r * np.sin(la)], 1)


def sweep(lat: np.ndarray, lon: np.ndarray, r: np.ndarray, radius: float, block: int = 2_000_000):
    """Pairs (i, j), each once, of points at most `radius` apart; lon in [0, 360). Yields arrays block by block."""
    n = len(lat)
    if n < 2:
        return
    # Near the sphere's centre the radius is a wide angle: points there (in real data none, or slips of a key) are swept on their own, with
    # those above them that they can reach, so that they do not widen the bands of all others.
    cut = 0.5 * float(r.max())
    deep = r < cut
    if deep.any() and not deep.all() and cut > 10 * radius:
        for part, only in ((np.flatnonzero(~deep), False), (np.flatnonzero(r < cut + radius), True)):
            for i, j in sweep(lat[part], lon[part], r[part], radius, block):
                i, j = part[i], part[j]
                keep = (deep[i] | deep[j]) if only else np.ones(len(i), bool)
                if keep.any():
                    yield i[keep], j[keep]
        return
    # The angle between two points at most `radius` apart, for the shallower radii of this cell.
    low = max(float(r.min()), 1e-9)
    ratio = radius / (2 * low)
    angle = math.degrees(2 * math.asin(ratio)) * (1 + 1e-9) + 1e-9 if ratio < 1 else 180.0
    height = max(angle, 1e-9)
    band = np.floor((lat + 90.0) / height).astype(np.int64)
    # Longitude reach at the latitude nearest to a pole that a partner may have.
    edge = np.minimum(np.abs(lat) + angle, 90.0)
    c = np.cos(np.radians(edge))
    s = math.sin(math.radians(min(angle, 90.0)))
    reach = np.where((c > s) & (angle < 90), np.degrees(np.arcsin(np.minimum(1.0, s / np.maximum(c, 1e-300)))) * (1 + 1e-9) + 1e-7, 180.0)
    xyz = _xyz(lat, lon, r)
    # Wrapping: the longitude order is extended by a copy of each point 360 degrees on.
    order = np.lexsort((lon, band))
    b, l = band[order], lon[order]
    bands, first = np.unique(b, return_index=True)
    ends = np.append(first[1:], n)
    span = 1000.0  # larger than any longitude distance, so (band, longitude) is one number
    key = b.astype(np.float64) * span + l
    for up in (0, 1):
        # Windows in the point's own band (only later points) and in the next band.
        for shift in (-360.0, 0.0, 360.0):
            lo_key, hi_key = (band + up) * span + np.maximum(lon + shift - reach, -1.0), (band + up) * span + np.minimum(lon + shift + reach, 361.0)
            a = np.searchsorted(key, lo_key, "left")
            z = np.searchsorted(key, hi_key, "right")
            count = np.maximum(z - a, 0)
            rows = np.flatnonzero(count)
            if not len(rows):
                continue
            upto = np.cumsum(count[rows])
            part = upto // block
            for p in np.unique(part):
                rr = rows[part == p]
                cc = count[rr]
                i = np.repeat(rr, cc)
                j = order[np.arange(cc.sum()) - np.repeat(np.cumsum(cc) - cc, cc) + np.repeat(a[rr], cc)]
                keep = i < j if up == 0 else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                if shift and len(i):  # a window of 180 degrees on each side would meet a point twice
                    inside = np.abs((lon[i] + shift) - lon[j]) < np.abs(lon[i] - lon[j])
                    i, j = i[inside], j[inside]
                elif len(i):
                    inside = np.abs(lon[i] - lon[j]) <= 180.0
                    i, j = i[inside], j[inside]
                d = xyz[i] - xyz[j]
                near = (d * d).sum(1) <= radius * radius
                if near.any():
                    yield i[near], j[near]


#: Steps of the fine grid, of latitude over 180 degrees and of longitude over 360.
STEPS = 1 << 20


def _angle(r: np.ndarray, radius: float) -> np.ndarray:
    """The largest angle (degrees) between a point at geocentric radius r and one at most `radius` away."""
    other = np.maximum(r - radius, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = radius / (2 * np.sqrt(r * other))
        return np.where((other > 0) & (ratio < 1), np.degrees(2 * np.arcsin(np.minimum(ratio, 1.0))) + 1e-9, 180.0)


def _steps(x: np.ndarray, low: float, span: float) -> np.ndarray:
    return np.clip(np.floor((x - low) * (STEPS / span)), 0, STEPS - 1).astype(np.int64)


class Cells:
    """Strips of latitude and their sectors of longitude, each list by its first steps in order: cells are numbered from south-west to north-east."""

    def __init__(self, strips: np.ndarray, sectors: np.ndarray):
        self.strips, self.sectors = strips, sectors  # a sector's number: strip x 2 STEPS + first step

    def strip(self, lat: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.strips, _steps(lat, -90.0, 180.0), "right") - 1, 0)

    def cell(self, strip: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.sectors, strip * (2 * STEPS) + _steps(lon, 0.0, 360.0), "right") - 1

    def reached(self, lat: np.ndarray, lon: np.ndarray, r: np.ndarray, radius: float, both: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of every cell that may own a pair of a point: from the lowest strip in reach to its own (with `both`, to the highest
        in reach), and in each the sectors in reach."""
        angle, own = _angle(r, radius), self.strip(lat)
        low = self.strip(lat - angle)
        point, strip = _ranges(low, self.strip(lat + angle) if both else own)
        edge = np.minimum(np.abs(lat) + angle, 90.0)
        c, sn = np.cos(np.radians(edge)), np.sin(np.radians(np.minimum(angle, 90.0)))
        reach = np.where((c > sn) & (angle < 90), np.degrees(np.arcsin(np.minimum(1.0, sn / np.maximum(c, 1e-300)))) + 1e-7, 180.0)
        a, z = (lon - reach)[point], (lon + reach)[point]
        first, last = self.cell(strip, np.zeros(len(strip))), self.cell(strip, np.full(len(strip), 360.0))
        ca, cz = self.cell(strip, np.mod(a, 360.0)), self.cell(strip, np.mod(z, 360.0))
        wrap = (a < 0) | (z >= 360.0)
        whole = (reach[point] >= 180.0) | (wrap & (cz >= ca))
        begin, end = np.where(whole, first, np.where(wrap, first, ca)), np.where(whole, last, cz)
        n, cell = _ranges(begin, end)
        beyond = np.flatnonzero(wrap & ~whole)
        n2, cell2 = _ranges(ca[beyond], last[beyond])
        return np.concatenate([point[n], point[beyond[n2]]]), np.concatenate([cell, cell2])


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for every number from begin to end (included) of each row."""
    count = end - begin + 1
    row = np.repeat(np.arange(len(begin)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[row]


def cells_of(places: DataFrame, target_rows: int) -> Cells:
    """Strips of about equal numbers of places, and sectors of the strips that are still too full."""
    spark, rows = places.sparkSession, places.count()
    # At least as many cells as the cluster has tasks for, while there is much to do in each.
    strips = max(1, math.ceil(rows / target_rows), min(shuffle_partitions(spark), rows // 2000 + 1))
    step = lambda c, low, span: F.least(F.greatest(F.floor((F.col(c) - low) * (STEPS / span)), F.lit(0)), F.lit(STEPS - 1))
    upto = lambda w: F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    lat = places.groupBy(step("lat", -90.0, 180.0).alias("step")).count()  # at most STEPS rows, so one task can add them up
    lat = lat.withColumn("strip", F.floor(upto(Window.orderBy("step")) * strips / F.lit(max(1, rows))))
    found = lat.groupBy("strip").agg(F.min("step").alias("step"), F.sum("count").alias("n")).orderBy("step").collect()
    edges = np.array([r["step"] for r in found] or [0], np.int64)
    sectors = np.arange(len(edges), dtype=np.int64) * (2 * STEPS)
    full = [k for k, r in enumerate(found) if r["n"] > 2 * target_rows]  # a strip is full where one step of latitude is
    if full:
        shared = spark.sparkContext.broadcast((edges, np.array(full)))

        @F.pandas_udf("int")
        def full_strip(x: pd.Series) -> pd.Series:
            strips_, full_ = shared.value
            k = np.maximum(np.searchsorted(strips_, _steps(x.to_numpy(np.float64), -90.0, 180.0), "right") - 1, 0)
            return pd.Series(np.where(np.isin(k, full_), k, -1).astype("int32"))

        lon = places.select(full_strip("lat").alias("strip"), step("lon", 0.0, 360.0).alias("step")).where("strip >= 0").groupBy("strip", "step").count()
        lon = lon.withColumn("sector", F.floor(upto(Window.partitionBy("strip").orderBy("step")) / target_rows))
        more = lon.groupBy("strip", "sector").agg(F.min("step").alias("step")).where("sector > 0").collect()
        sectors = np.unique(np.concatenate([sectors, np.array([r["strip"] * 2 * STEPS + r["step"] for r in more], np.int64)]))
    return Cells(edges, sectors)


def pairs_within(points: DataFrame, radius_km: float, *, id: str, lat: str, lon: str, depth_km: str, target_rows: int = 50_000) -> DataFrame:
    """(id_a, id_b, distance_km), id_a < id_b: each pair of different ids at most `radius_km` apart, once; the bound is inclusive.

    Rows with a null id, or a null, NaN or infinite coordinate, latitude outside -90..90, or lat = lon = 0, do not count; longitude is
    taken modulo 360. Repeated rows count once. An id at several places counts at each (its nearest distance is given). Two
    ids at one place are a pair of distance 0. Empty tables give an empty result; other columns are ignored.
    """
    spark, r_km = points.sparkSession, float(radius_km)
    places, several, kind = _places(points, id, lat, lon, depth_km)
    shared = spark.sparkContext.broadcast(cells_of(places, target_rows))
    copies = _sent(places, shared, r_km, kind, "ids array<{kind}>, again array<boolean>", both=False)

    def pairs(only: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = pd.concat(list(batches))
            reps, strip, home = g["id"].to_numpy(), g["strip"].to_numpy(), g["home"].to_numpy(bool)
            lat_, lon_, rr = (g[c].to_numpy(np.float64) for c in ("lat", "lon", "r"))
            xyz = _xyz(lat_, lon_, rr)
            size = np.array([len(x) for x in g["ids"]], np.int64)
            begin, ids, again = np.cumsum(size) - size, np.concatenate(list(g["ids"])), np.concatenate(list(g["again"])).astype(bool)

            def rows(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> pd.DataFrame:
                more, a, b = again[x] | again[y], ids[x], ids[y]
                keep = (a != b) & (more if only else ~more)
                x_first = (a < b).astype(bool)
                return pd.DataFrame({"ia": np.where(x_first, a, b)[keep], "ib": np.where(x_first, b, a)[keep], "distance_km": d[keep]})

            at_home = np.flatnonzero(home)
            # Pairs at one place: each id with those after it.
            left = np.repeat(begin[at_home] + size[at_home], size[at_home])
            x = _ranges(begin[at_home], begin[at_home] + size[at_home] - 1)[1]
            for part in _blocks(left - x - 1):
                count = (left - x - 1)[part]
                one = np.repeat(x[part], count)
                yield rows(one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count), np.zeros(len(one)))
            for i, j in sweep(lat_, lon_, rr, r_km):
                # The owner: the cell of the point in the lower strip, or of the smaller id within a strip.
                first = np.where(strip[i] != strip[j], strip[i] < strip[j], reps[i] < reps[j]).astype(bool)
                owner, other = np.where(first, i, j), np.where(first, j, i)
                mine = home[owner]
                owner, other = owner[mine], other[mine]
                d = xyz[owner] - xyz[other]
                d = np.sqrt((d * d).sum(1))
                # From places to ids: every id of one with every id of the other, block by block.
                for some in _blocks(size[owner]):
                    of, x = _ranges(begin[owner[some]], begin[owner[some]] + size[owner[some]] - 1)
                    of = some[of]
                    for part in _blocks(size[other[of]]):
                        to = other[of[part]]
                        yield rows(np.repeat(x[part], size[to]), _ranges(begin[to], begin[to] + size[to] - 1)[1], np.repeat(d[of[part]], size[to]))

        return spread_out(copies, "cell").groupBy("cell").applyInPandas(run, f"ia {kind}, ib {kind}, distance_km double")

    found = pairs(False).select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"), "distance_km")
    if several:
        nearest = pairs(True).groupBy(F.col("ia").alias("id_a"), F.col("ib").alias("id_b")).agg(F.min("distance_km").alias("distance_km"))
        found = found.unionByName(nearest)
    return found


def _located(points: DataFrame, id: str, lat: str, lon: str, depth_km: str) -> DataFrame:
    """(id, lat, lon in [0, 360), r) of the rows that count; repeated rows are left."""
    good = finite(lat) & finite(lon) & finite(depth_km) & F.col(id).isNotNull()
    p = points.where(good).select(F.col(id).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon0"), (EARTH_KM - F.col(depth_km).cast("double")).alias("r"))
    p = p.where((F.abs("lat") <= 90) & ~((F.col("lat") == 0) & (F.col("lon0") == 0)))
    # Below the sphere's centre a point lies on the other side.
    over = F.col("r") < 0
    return p.select("id", F.when(over, -F.col("lat")).otherwise(F.col("lat")).alias("lat"), F.pmod(F.when(over, F.col("lon0") + 180).otherwise(F.col("lon0")), F.lit(360.0)).alias("lon"), F.abs("r").alias("r"))


def _places(points: DataFrame, id: str, lat: str, lon: str, depth_km: str) -> tuple[DataFrame, bool, str]:
    """(places, whether an id has several, the type of ids). A place: its smallest `id`, lat, lon, r, its `ids` in order, and which of them
    have other places (`again`)."""
    scratch = Scratch(points.sparkSession, "nearby")
    by = ["lat", "lon", "r"]
    p = _located(points, id, lat, lon, depth_km)
    places = scratch.keep(p.groupBy(*by).agg(F.array_sort(F.collect_set("id")).alias("ids")))
    repeated = places.select(F.explode("ids").alias("id")).groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("again"))
    several = bool(repeated.limit(1).count())
    if several:
        m = places.select(*by, F.explode("ids").alias("id")).join(repeated, "id", "left")
        m = m.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("again", F.lit(False)).alias("again")))).alias("m"))
        kept = scratch.keep(m.select(*by, F.col("m.id").alias("ids"), F.col("m.again").alias("again")))
        scratch.drop(places)
        places = kept
    else:
        places = places.withColumn("again", F.transform("ids", lambda x: F.lit(False)))
    return places.select(F.col("ids")[0].alias("id"), *by, "ids", "again"), several, points.schema[id].dataType.simpleString()


def _sent(places: DataFrame, cells, radius: float, kind: str, lists: str, both: bool) -> DataFrame:
    """The places, once for every cell that may own a pair of theirs (`both`: that has a place in reach)."""

    def send(batches):
        for b in batches:
            lat_, lon_, rr = (b[c].to_numpy(np.float64) for c in ("lat", "lon", "r"))
            point, to = cells.value.reached(lat_, lon_, rr, radius, both)
            strip = cells.value.strip(lat_)
            yield b.iloc[point].assign(strip=strip[point].astype("int32"), cell=to.astype("int64"), home=cells.value.cell(strip, lon_)[point] == to)

    return places.mapInPandas(send, f"id {kind}, lat double, lon double, r double, {lists.format(kind=kind)}, strip int, cell long, home boolean")


def _blocks(count: np.ndarray, block: int = 1_000_000) -> Iterator[np.ndarray]:
    """Row numbers in order, in parts whose counts add up to about `block`; rows of count 0 are left out."""
    rows = np.flatnonzero(count)
    if len(rows):
        part = np.cumsum(count[rows]) // block
        yield from np.split(rows, np.flatnonzero(np.diff(part)) + 1)


def nearest_within(points: DataFrame, radius_km: float, k: int, *, id: str, lat: str, lon: str, depth_km: str, target_rows: int = 20_000) -> DataFrame:
    """(id, other, rank): the k nearest other ids of each id among those of `pairs_within`, by distance (to 1e-9 km), then id.

    Places are sent to all cells in reach with their first k + 1 ids; a cell finds the k nearest places of its own ones, block by block, so the
    pairs are neither shuffled nor kept. Of ids at several places the pairs are made and ranked.
    """
    places, several, kind = _places(points, id, lat, lon, depth_km)
    if several:
        p = pairs_within(points, radius_km, id=id, lat=lat, lon=lon, depth_km=depth_km)
        s = p.select(F.col("id_a").alias("id"), F.col("id_b").alias("other"), "distance_km").unionAll(p.select("id_b", "id_a", "distance_km"))
        w = Window.partitionBy("id").orderBy(F.round("distance_km", 9), "other")
        return s.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("id", "other", "rank")
    r_km = float(radius_km)
    shared = points.sparkSession.sparkContext.broadcast(cells_of(places, target_rows))
    copies = _sent(places.drop("again"), shared, r_km, kind, "ids array<{kind}>", both=True)
    copies = copies.withColumn("ids", F.when(F.col("home"), F.col("ids")).otherwise(F.slice("ids", 1, k + 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(batches)).sort_values("id", kind="stable")  # places in order of their smallest id
        home = g["home"].to_numpy(bool)
        lat_, lon_, rr = (g[c].to_numpy(np.float64) for c in ("lat", "lon", "r"))
        xyz, lists = _xyz(lat_, lon_, rr), list(g["ids"])
        size = np.array([len(x) for x in lists], np.int64)
        begin, ids = np.cumsum(size) - size, np.concatenate(lists)
        # The k first places of each by distance and smallest id: whatever comes of a later place, k ids lie before it.
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

        def first(at: np.ndarray, of: np.ndarray, d: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
            o = np.lexsort((of, d, at))
            at, of, d = at[o], of[o], d[o]
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
            keep = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at)))) < least
            return at[keep], of[keep], d[keep]

        for i, j in sweep(lat_, lon_, rr, r_km):
            d = xyz[i] - xyz[j]
            d = np.round(np.sqrt((d * d).sum(1)), 9)
            at, of, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
            mine = home[at]
            best = first(*(np.concatenate([x, y[mine]]) for x, y in zip(best, (at, of, d))), k)
        # Their ids, and those at the place itself.
        own = np.flatnonzero(home)
        at, of, d = np.concatenate([best[0], own]), np.concatenate([best[1], own]), np.concatenate([best[2], np.zeros(len(own))])
        row, e = _ranges(begin[of], begin[of] + np.minimum(size[of], k + 1) - 1)
        code = np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((code[e], d[row], at[row]))
        at, e = at[row][order], e[order]
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
        rank = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
        cand = np.full((len(home), k + 1), -1, np.int64)
        keep = rank <= k
        cand[at[keep], rank[keep]] = e[keep]
        for part in _blocks(np.where(home, size, 0) * (k + 1)):
            of, x = _ranges(begin[part], begin[part] + size[part] - 1)
            c = cand[part][of]
            there = (c >= 0) & (c != x[:, None])
            n = np.cumsum(there, 1)
            there &= n <= k
            r, col = np.nonzero(there)
            yield pd.DataFrame({"id": ids[x[r]], "other": ids[c[r, col]], "rank": n[r, col]})

    return spread_out(copies, "cell").groupBy("cell").applyInPandas(run, f"id {kind}, other {kind}, rank long")


def common_readings(readings: DataFrame, points: DataFrame, radius_km: float, values: list[str], *, id: str, lat: str, lon: str, depth_km: str, by: tuple[str, ...] = ("station", "phase"), rows_at_once: int = 200_000) -> DataFrame:
    """(a, b, by..., value_a, value_b..., km), a < b: the pairs of `pairs_within` that both have a reading (`id`, by..., values...), one row for each
    two readings in common. Null keys have none.

    The pairs are not made: readings meet by station and phase, and strips of the Cartesian z axis, of 64 radii and one radius of overlap, in
    which columns of the radius's width are swept upwards. One shuffle of the readings; a task goes through its sorted groups in turn.
    """
    r_km = float(radius_km)
    high = 64 * r_km
    kind = readings.schema[id].dataType.simpleString()
    p = _located(points, id, lat, lon, depth_km).groupBy("id").agg(F.collect_set(F.struct("lat", "lon", "r")).alias("at"))
    several = bool(p.where(F.size("at") > 1).limit(1).count())
    la, lo, r = F.radians("at.lat"), F.radians("at.lon"), F.col("at.r")
    t = readings.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), *by, *values)
    t = t.join(p, "id").withColumn("at", F.explode("at")).select("id", *by, *values, (r * F.cos(la) * F.cos(lo)).alias("x"), (r * F.cos(la) * F.sin(lo)).alias("y"), (r * F.sin(la)).alias("z"))
    for c in by:
        t = t.where(F.col(c).isNotNull())
    own = F.floor(F.col("z") / high).cast("int")
    below = F.when(F.col("z") - own * high <= r_km * (1 + 1e-9) + 1e-6, own - 1)
    t = t.withColumn("own", own).withColumn("strip", F.explode(F.array_compact(F.array(own, below)))).withColumn("home", F.col("strip") == F.col("own")).drop("own")
    t = spread_out(t, *by, "strip").sortWithinPartitions(*by, "strip")
    keys = [*by, "strip"]

    def meet(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        code = np.zeros(len(g), np.int64)
        for c in keys:
            v = g[c].to_numpy()
            code[1:] += v[1:] != v[:-1]
        code = np.cumsum(code > 0)
        ids, home = g["id"].to_numpy(), g["home"].to_numpy(bool)
        xyz = g[["x", "y", "z"]].to_numpy(np.float64)
        cell = np.floor((xyz[:, :2] - xyz[:, :2].min(0)) / (r_km * (1 + 1e-9) + 1e-9)).astype(np.int64) if r_km > 0 else np.zeros((len(g), 2), np.int64)
        ny = int(cell[:, 1].max()) + 3
        nx = int(cell[:, 0].max()) + 3
        column = (code * nx + cell[:, 0] + 1) * ny + cell[:, 1] + 1
        there, which = np.unique(column, return_inverse=True)
        z = xyz[:, 2] - xyz[:, 2].min()
        span = float(z.max()) + 4 * r_km + 1.0  # larger than any distance, so (column, z) is one number
        order = np.lexsort((z, which))
        key = which[order] * span + z[order]
        slack = 1e-6 + 1e-15 * float(key[-1]) * 4
        for step in (0, 1, ny - 1, ny, ny + 1):
            to = np.searchsorted(there, column + step)
            rows = np.flatnonzero(there[np.minimum(to, len(there) - 1)] == column + step)
            at = to[rows] * span + z[rows]
            a = np.searchsorted(key, np.maximum(at - r_km - slack, to[rows] * span - slack), "left")
            b = np.searchsorted(key, at + r_km + slack, "right")
            for part in _blocks(np.maximum(b - a, 0)):
                i, j = _ranges(a[part], b[part] - 1)
                i, j = rows[part[i]], order[j]
                d = xyz[i] - xyz[j]
                d = (d * d).sum(1)
                lower = np.where(xyz[i, 2] <= xyz[j, 2], i, j)
                ok = (d <= r_km * r_km) & (ids[i] != ids[j]) & home[lower] & (code[i] == code[j])
                if not step:
                    ok &= i < j
                i, j, d = i[ok], j[ok], d[ok]
                if len(i):
                    up = (ids[i] < ids[j]).astype(bool)
                    i, j = np.where(up, i, j), np.where(up, j, i)
                    x, y = g.iloc[i], g.iloc[j]
                    out = {"a": ids[i], "b": ids[j]} | {c: x[c].to_numpy() for c in by}
                    yield pd.DataFrame(out | {f"{c}_{s}": q[c].to_numpy() for c in values for s, q in (("a", x), ("b", y))} | {"km": np.sqrt(d)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n < rows_at_once:
                continue
            g = pd.concat(held, ignore_index=True)
            last = g[keys].iloc[-1]
            differs = np.zeros(len(g), bool)
            for c in keys:
                differs |= g[c].to_numpy() != last[c]
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if cut:
                yield from meet(g.iloc[:cut])
            held, n = [g.iloc[cut:]], len(g) - cut
            if not cut:  # one group is larger: read on, twice as far each time
                held, n = [g], rows_at_once - len(g)
        if held and (g := pd.concat(held, ignore_index=True)).shape[0]:
            yield from meet(g)

    of = {f.name: f.dataType.simpleString() for f in readings.schema}
    schema = ", ".join([f"a {kind}", f"b {kind}", *[f"{c} {of[c]}" for c in by], *[f"{c}_{s} {of[c]}" for c in values for s in "ab"], "km double"])
    found = t.mapInPandas(run, schema)
    if several:
        rest = [c for c in found.columns if c != "km"]
        found = found.groupBy(*rest).agg(F.min("km").alias("km"))
    return found
