"""Hypocentres: grid search and damped least squares per event, over travel-time tables of a model; and double differences."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark.common import Scratch, spread
from quakespark.functions.geo import EARTH_KM
from quakespark.functions.grid import Grid
from quakespark.functions.mechanism import tricube
from quakespark.operators.nearby import common_readings
from quakespark.plans.forward import eikonal

#: Bytes of tables that are broadcast at a time.
TABLE_BYTES = 256_000_000
#: Rows that are read before events are located, and events that are located at once.
ROWS_PER_CALL, EVENTS_PER_CALL = 40_000, 1024


def travel_time_tables(stations: DataFrame, grid: Grid, slowness: dict[str, np.ndarray], phases: tuple[str, ...] = ("P", "S")) -> DataFrame:
    """(station, phase, t array<float>) of every station, made in parallel."""
    fields = {p: slowness[p].reshape(grid.nz, grid.ny, grid.nx) for p in phases}

    def make(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                for p, s in fields.items():
                    out.append((r.station, p, eikonal(grid, s, (r.st_lon, r.st_lat, -r.elevation_m / 1000)).ravel().astype(np.float32)))
            yield pd.DataFrame(out, columns=["station", "phase", "t"])

    kind = stations.schema["station"].dataType.simpleString()
    return spread(stations.select("station", "st_lon", "st_lat", "elevation_m"), "station").mapInPandas(make, f"station {kind}, phase string, t array<float>")


def _added(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis but one, row after row, so that an event's sum depends neither on the events beside it nor on filled rows."""
    return x.sum(-2) if x.shape[-1] > 1 else np.cumsum(x, -2)[..., -1, :]


def _middle(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians of columns of which `n` values count; the others are infinite."""
    o, at = np.sort(x, 0), np.arange(x.shape[1])
    return (o[(n - 1) // 2, at] + o[n // 2, at]) / 2


def _lowest(x: np.ndarray, of: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the least value of each event is, the first of equal ones; `of` (ascending) has the values' events, `starts` where they begin."""
    x = np.where(np.isnan(x), np.inf, x)
    at = np.flatnonzero(x == np.minimum.reduceat(x, starts)[of])
    return at[np.searchsorted(of[at], np.arange(len(starts)))]


def _least_misfit(times: np.ndarray, w: np.ndarray, table: np.ndarray, tab: np.ndarray, most: float, nodes: np.ndarray) -> np.ndarray:
    """The node of the least absolute misfit of each event (readings x events), of nodes for all or a row of them an event; the first of equal ones.

    Two readings' misfit is at least the difference of their residuals times the lesser weight. The sum over pairs of readings, of similar weight,
    is a bound from below; nodes where it is above the misfit at its lowest node can't be best. Pairs made otherwise bound what is left, and only
    the rest is computed in full.
    """
    n, b = times.shape
    width, every, half = nodes.shape[-1], nodes.ndim == 1 and nodes.shape[0] == tab.shape[1], _added(w) / 2
    best, order = np.empty(b, np.int64), np.argsort(-w, 0, kind="stable")
    times, w, table = (np.take_along_axis(v, order, 0) for v in (times, w, table))
    flat, rows = tab.ravel(), table * tab.shape[1]
    # What single precision may change in a bound.
    margin = 1e-6 * 2 * half * (2 * most + times.max(0) - times.min(0))
    others = [[(k, (k + 1) % n) for k in range(1, n - n % 2, 2)], [(k, k + n // 2) for k in range(n // 2)]]

    def misfit(r: np.ndarray, e: np.ndarray) -> np.ndarray:
        o, we = np.argsort(r, 0), w[:, e]
        at = (np.cumsum(np.take_along_axis(we, o, 0), 0) < half[e]).sum(0)
        t0 = np.take_along_axis(r, np.take_along_axis(o, at[None], 0), 0)
        return _added(we * np.abs(r - t0))

    def residuals(e: np.ndarray, nd: np.ndarray) -> np.ndarray:
        return times[:, e] - flat.take(rows[:, e] + nd)

    step = max(1, 65536 // width)
    for f in range(0, b, step):
        e = np.arange(f, min(b, f + step))
        low, nd = np.zeros((len(e), width), np.float32), nodes[e] if nodes.ndim > 1 else np.broadcast_to(nodes, (len(e), width))
        for k in range(0, n - 1, 2):
            x, y = table[k, e], table[k + 1, e]
            d = tab[x] - tab[y] if every else tab[x[:, None], nd] - tab[y[:, None], nd]
            d -= (times[k, e] - times[k + 1, e]).astype(np.float32)[:, None]
            np.abs(d, out=d)
            d *= w[k + 1, e].astype(np.float32)[:, None]
            low += d
        at, first = np.arange(len(e)), low.argmin(1)
        may = low <= (misfit(residuals(e, nd[at, first]), e) + margin[e]).astype(np.float32)[:, None] * np.float32(1 + 1e-6)
        may[at, first] = True
        of, c = np.nonzero(may)
        g, starts = e[of], np.searchsorted(of, at)
        r = residuals(g, nd[of, c])
        low = np.zeros(len(of))
        for pairs in others:
            low = np.maximum(low, sum(np.minimum(w[i], w[j])[g] * np.abs(r[i] - r[j]) for i, j in pairs))
        first = _lowest(low, of, starts)
        may = low <= (misfit(r[:, first], e) * (1 + 1e-9))[of]
        may[first] = True
        rest = np.flatnonzero(may)
        of, c = of[rest], c[rest]
        best[e] = nd[at, c[_lowest(misfit(r.take(rest, 1), e[of]), of, np.searchsorted(of, at))]]
    return best


def _solved(h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many small symmetric systems (k, k, events), y (k, events), and their pivots, by elimination without exchanges."""
    k, h, y = len(y), h.copy(), y.copy()
    for i in range(k):
        for j in range(i + 1, k):
            f = h[i, j] / h[i, i]
            h[j, j:] -= f * h[i, j:]
            y[j] -= f * y[i]
    pivots = np.stack([h[i, i] for i in range(k)])
    for i in range(k - 1, -1, -1):
        for j in range(i + 1, k):
            y[i] -= h[i, j] * y[j]
        y[i] /= h[i, i]
    return y, pivots


def _normal(w2: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Normal equations (k + 1, k + 1, events) of the origin time and k coordinates from weights (readings, events) and gradients (k, readings, events)."""
    k = len(g)
    h, wg = np.empty((k + 1, k + 1, w2.shape[1])), w2 * g
    h[0, 0] = _added(w2)
    h[0, 1:] = h[1:, 0] = _added(wg)
    for i in range(k):
        h[1 + i, 1 + i :] = h[1 + i :, 1 + i] = _added(wg[i] * g[i:])
    return h


def locate_events(times: np.ndarray, sigma: np.ndarray, table: np.ndarray, tab: np.ndarray, grid: Grid, *, most: float | None = None, coarse: int = 8000, turns: int = 20, outlier_mads: float = 4.0, outlier_floor: float = 0.5, rounds: int = 3, fixed_depth: float | None = None) -> dict[str, np.ndarray]:
    """Hypocentres and origin times of many events at once, from arrival times (readings, events): least absolute misfit on a grid, then
    Levenberg-Marquardt with outlier rounds, where events drop out as they are done.

    `table` has the rows of `tab` (tables, nodes) of the readings, or -1 where an event has fewer than others; each has four or more. `most` is the
    largest time of `tab`. An event's result doesn't depend on the others, to the last bit.
    """
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return _located(times, sigma, table, tab, grid, float(np.abs(tab).max()) if most is None else most, coarse, turns, outlier_mads, outlier_floor, rounds, fixed_depth)


def _located(times, sigma, table, tab, grid, most, coarse, turns, outlier_mads, outlier_floor, rounds, fixed_depth) -> dict[str, np.ndarray]:
    is_, table = table >= 0, np.maximum(table, 0)
    times = np.where(is_, times, times[:1])
    w = np.where(is_, 1 / np.maximum(0.01, sigma), 0.0)
    stride = max(1, int(np.ceil((grid.nodes / coarse) ** (1 / 3))))
    k, j, i = np.meshgrid(np.arange(0, grid.nz, stride), np.arange(0, grid.ny, stride), np.arange(0, grid.nx, stride), indexing="ij")
    best = _least_misfit(times, w, table, tab, most, ((k * grid.ny + j) * grid.nx + i).ravel())
    if stride > 1:
        box = np.meshgrid(*[np.arange(-2 * stride, 2 * stride + 1)] * 3, indexing="ij")
        k, j, i = (np.clip(c[:, None] + d.ravel(), 0, m - 1) for c, d, m in zip((best // (grid.nx * grid.ny), best // grid.nx % grid.ny, best % grid.nx), box, (grid.nz, grid.ny, grid.nx)))
        best = _least_misfit(times, w, table, tab, most, (k * grid.ny + j) * grid.nx + i)
    x, y, z = grid.axes()
    p = np.stack([x[best % grid.nx], y[best // grid.nx % grid.ny], z[best // (grid.nx * grid.ny)] if fixed_depth is None else np.full(len(best), float(fixed_depth))])
    lo, hi = np.array([[grid.min_lon], [grid.min_lat], [grid.min_depth]]), np.array([[grid.max_lon], [grid.max_lat], [grid.max_depth]])
    steps, flat, free, n = np.array(grid.steps), tab.ravel(), 3 if fixed_depth is None else 2, len(times)

    def at_points(base: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Times (readings, points) at points (3, points) of the grid, by `Grid.weights` an axis a row."""
        cells, parts = [], []
        for a, m in enumerate((grid.nx, grid.ny, grid.nz)):
            c = np.clip((q[a] - lo[a]) / steps[a], 0, m - 1)
            cells.append(np.minimum(np.floor(c), m - 2))
            parts.append((1 - (c - cells[a]), c - cells[a]))
        at = base + ((cells[2] * grid.ny + cells[1]) * grid.nx + cells[0]).astype(np.int64)
        v, t = np.zeros(base.shape), np.empty(base.shape)
        for j in (0, 1):
            for i in (0, 1):
                xy = parts[0][i] * parts[1][j]
                for k in (0, 1):
                    np.multiply(flat[(k * grid.ny + j) * grid.nx + i :].take(at), xy * parts[2][k], out=t)
                    v += t
        return v

    def gradients(base: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Gradients (3, readings, points), s/km, from half a node before to half a node after."""
        ends = np.repeat(q[:, None], 6, 1)
        for a in range(3):
            ends[a, a] = ends[a, a] - steps[a] / 2
            ends[a, 3 + a] = ends[a, 3 + a] + steps[a] / 2
        ends = np.clip(ends, lo[..., None], hi[..., None])
        v = at_points(np.tile(base, 6), ends.reshape(3, -1)).reshape(n, 6, -1)
        r = EARTH_KM - q[2]
        km = np.stack([ends[a, 3 + a] - ends[a, a] for a in range(3)]) * np.stack([np.radians(1) * r * np.cos(np.radians(q[1])), np.radians(1) * r, np.ones_like(r)])
        return np.ascontiguousarray(((v[:, 3:] - v[:, :3]) / np.maximum(km, 1e-12)).transpose(1, 0, 2))

    def moved(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        r = EARTH_KM - q[2]
        out = q + np.stack([np.degrees(d[0] / (r * np.cos(np.radians(q[1])))), np.degrees(d[1] / r), d[2] if free == 3 else np.zeros_like(r)])
        return np.clip(out, lo, hi)

    def fit(s: dict) -> None:
        """Origin times, residuals and cost."""
        left = s["times"] - s["calc"]
        s["t0"] = _added(s["w2"] * left) / _added(s["w2"])
        s["r"] = left - s["t0"]
        s["cost"] = _added(s["w2"] * s["r"] ** 2)

    def equations(s: dict) -> None:
        wr = s["w2"] * s["r"]
        s["h"], s["y"] = _normal(s["w2"], s["g"][:free]), np.concatenate([_added(wr)[None], _added(wr * s["g"][:free])])

    def some(s: dict, which: np.ndarray) -> dict:
        return {k: v.take(which, -1) for k, v in s.items()}

    s = {"of": np.arange(times.shape[1]), "times": times, "base": table * grid.nodes, "w": w, "is": is_, "use": is_, "p": p}
    s |= {"calc": at_points(s["base"], p), "g": gradients(s["base"], p)}
    done = []
    for turn in range(rounds):
        s["w2"] = np.where(s["use"], s["w"] ** 2, 0.0)
        fit(s)
        equations(s)
        u = {k: s[k] for k in ("times", "base", "w2", "p", "calc", "g", "t0", "r", "cost", "h", "y")} | {"at": np.arange(len(s["of"])), "lam": np.full(len(s["of"]), 0.01)}
        ended = []
        for _ in range(turns):
            h = u["h"].copy()
            for a in range(free + 1):
                h[a, a] += u["lam"] * (h[a, a] + 1e-12)
            d = np.zeros((3, len(u["at"])))
            d[:free] = _solved(h, u["y"])[0][1:]
            q = {"times": u["times"], "base": u["base"], "w2": u["w2"], "p": moved(u["p"], d)}
            q["calc"] = at_points(q["base"], q["p"])
            fit(q)
            better = q["cost"] < u["cost"]
            c = np.flatnonzero(better)
            if len(c):
                q = some(q, c)
                q["g"] = gradients(q["base"], q["p"])
                equations(q)
                for key in ("p", "calc", "g", "t0", "r", "cost", "h", "y"):  # those of s are replaced below
                    u[key][..., c] = q[key]
            u["lam"] = np.where(better, u["lam"] / 3, u["lam"] * 4)
            over = np.where(better, np.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2) < 1e-4, u["lam"] > 1e6)
            if over.any():
                ended.append(some(u, np.flatnonzero(over)))
                u = some(u, np.flatnonzero(~over))
                if not len(u["at"]):
                    break
        ended.append(u)
        back = np.argsort(np.concatenate([e["at"] for e in ended]))
        s |= {key: np.concatenate([e[key] for e in ended], -1).take(back, -1) for key in ("p", "calc", "g", "t0", "r")}
        count = s["is"].sum(0)
        mid = _middle(np.where(s["is"], s["r"], np.inf), count)
        off = np.abs(s["r"] - mid)
        limit = np.maximum(outlier_floor, outlier_mads * 1.4826 * _middle(np.where(s["is"], off, np.inf), count))
        new = (off <= limit) & s["is"]
        same = (new.sum(0) < 4) | (new == s["use"]).all(0)
        s["use"] = np.where(same, s["use"], new)
        if turn == rounds - 1:
            same[:] = True
        keys = ("of", "w", "is", "use", "p", "g", "t0", "r")
        done.append(some({key: s[key] for key in keys}, np.flatnonzero(same)))
        if same.all():
            break
        s = some({key: s[key] for key in (*keys, "times", "base", "calc")}, np.flatnonzero(~same))
    back = np.argsort(np.concatenate([e["of"] for e in done]))
    s = {key: np.concatenate([e[key] for e in done], -1).take(back, -1) for key in done[0]}
    w2, used = np.where(s["use"], s["w"] ** 2, 0.0), s["use"].sum(0)
    h = _normal(w2, s["g"])
    cov, poor = np.empty_like(h), np.zeros(len(used), bool)
    for a in range(4):
        cov[:, a], pivots = _solved(h, np.repeat(np.eye(4)[:, a : a + 1], len(used), 1))
        poor |= ~(pivots > 1e-8 * np.stack([h[k, k] for k in range(4)])).all(0)
    for e in np.flatnonzero(poor):
        cov[..., e] = np.linalg.pinv(h[..., e]) if np.isfinite(h[..., e]).all() else np.nan
    cov = cov * np.maximum(1.0, _added(w2 * s["r"] ** 2) / np.maximum(1, used - 4))
    see, snn, sen = cov[1, 1], cov[2, 2], cov[1, 2]
    half, mean = np.hypot((see - snn) / 2, sen), (see + snn) / 2
    return {
        "lon": s["p"][0], "lat": s["p"][1], "depth_km": s["p"][2], "origin_shift_s": s["t0"], "rms_s": np.sqrt(_added(np.where(s["use"], s["r"] ** 2, 0.0)) / used), "phases": used.astype(np.int32), "rejected": (s["is"].sum(0) - used).astype(np.int32),
        "major_km": np.sqrt(np.maximum(0, mean + half)), "minor_km": np.sqrt(np.maximum(0, mean - half)), "azimuth_deg": np.degrees(0.5 * np.arctan2(2 * sen, snn - see)) % 180, "depth_error_km": np.sqrt(np.maximum(0, cov[3, 3])), "time_error_s": np.sqrt(np.maximum(0, cov[0, 0])),
    }


LOCATION = "event long, lon double, lat double, depth_km double, origin_shift_s double, rms_s double, phases int, rejected int, major_km double, minor_km double, azimuth_deg double, depth_error_km double, time_error_s double"


def locate(spark: SparkSession, arrivals: DataFrame, tables: DataFrame, grid: Grid, *, time: str = "time_s", table_bytes: int = TABLE_BYTES, spread_out: bool = True, **settings) -> DataFrame:
    """Hypocentres of all events with four arrivals or more: (event, lon, lat, depth_km, ...).

    A `place` of the arrivals, where there is one, names their table in place of the station, so that stations at one place share it (`place`).
    Tables are broadcast, at most `table_bytes` of them at a time (counted before: stations x phases x nodes x 4 bytes). More are used in passes:
    events are grouped by the station that they reach first, groups that use the same stations share a pass, and a pass sends the tables of its stations
    only; of a group that alone reaches more, all. The driver reads the groups' tables one group after the other and keeps a number a first station.
    Events are hashed onto the session's partitions, unless `spread_out` is false for arrivals that have been spread by event, and thousands are located
    in a call; no event is larger than its number of stations.
    """
    spark_, kind = arrivals.sparkSession, arrivals.schema["event"].dataType.simpleString()
    key = "place" if "place" in arrivals.columns else "station"
    arrivals = arrivals.select("event", "station", F.col(key).alias("place"), "phase", time, "sigma_s")
    n = tables.count()
    if n * grid.nodes * 4 <= table_bytes:
        return _locate_with(arrivals, tables, grid, time, kind, spread_out, settings)[0]
    scratch = Scratch(spark_, "locations")
    arrivals = scratch.keep(arrivals)
    first = arrivals.groupBy("event").agg(F.min_by(F.col("place"), F.struct(time, "place")).alias("first_station"))
    a = scratch.keep(arrivals.join(first, "event"))
    used = scratch.keep(a.groupBy("first_station").agg(F.sort_array(F.collect_set(F.struct("place", "phase"))).alias("tables")))
    numbers, held, most = [], None, max(1, table_bytes // (4 * grid.nodes))
    for r in used.orderBy("tables", "first_station").toLocalIterator():
        own = {tuple(t) for t in r["tables"]}
        if held is None or len(held | own) > most:
            held, part = set(), numbers[-1][1] + 1 if numbers else 0
        held |= own
        numbers.append((r["first_station"], part))
    if not numbers:
        return _locate_with(arrivals, tables.limit(0), grid, time, kind, True, settings)[0]
    number = spark_.createDataFrame(numbers, f"first_station {a.schema['first_station'].dataType.simpleString()}, part int")
    a, need = scratch.keep(a.join(number, "first_station")), scratch.keep(used.join(number, "first_station").select("part", F.explode("tables").alias("t")).select("part", F.col("t.place").alias("station"), "t.phase").distinct())
    found = []
    for k in range(numbers[-1][1] + 1):
        d, shared = _locate_with(a.where(F.col("part") == k), tables.join(need.where(F.col("part") == k), ["station", "phase"], "left_semi"), grid, time, kind, True, settings)
        found.append(scratch.keep(d))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def place() -> Column:
    """A name of the place of a station (st_lon, st_lat, elevation_m): exact, as numbers are written so that they read back the same."""
    return F.concat_ws(" ", "st_lon", "st_lat", "elevation_m")


def _locate_with(arrivals: DataFrame, tables: DataFrame, grid: Grid, time: str, kind: str, spread_out: bool, settings: dict):
    """(hypocentres, the tables' broadcast)."""
    spark = arrivals.sparkSession
    rows = [(r["station"], r["phase"], np.array(r["t"], np.float32)) for r in tables.toLocalIterator()]
    tab = np.stack([r[2] for r in rows]) if rows else np.zeros((0, grid.nodes), np.float32)
    shared = spark.sparkContext.broadcast(([r[:2] for r in rows], tab, float(np.abs(tab).max(initial=0.0))))
    names = [c.split()[0] for c in LOCATION.split(", ")]

    def run(batches):
        keys, tab, most = shared.value
        places, phases = pd.Index(list(dict.fromkeys(k[0] for k in keys))), pd.Index(list(dict.fromkeys(k[1] for k in keys)))
        number = np.full((len(places) + 1, len(phases) + 1), -1)  # the last of each for those without a table
        number[places.get_indexer([k[0] for k in keys]), phases.get_indexer([k[1] for k in keys])] = np.arange(len(keys))

        def located(g: pd.DataFrame) -> pd.DataFrame:
            g = g.assign(table=number[places.get_indexer(g["place"]), phases.get_indexer(g["phase"])])
            g = g[g["table"] >= 0].sort_values(["event", "station", "phase"])
            events, out = g["event"].to_numpy(), []
            cuts = np.concatenate([[0], np.flatnonzero(events[1:] != events[:-1]) + 1])
            n = np.diff(cuts, append=len(g))
            order = np.argsort(n, kind="stable")
            order = order[n[order] >= 4]
            values = [g[c].to_numpy(kind_) for c, kind_ in ((time, float), ("sigma_s", float), ("table", np.int64))]
            while len(order):  # events of similar numbers of readings, filled up to the most
                e = order[: min(EVENTS_PER_CALL, np.searchsorted(n[order], 1.25 * n[order[0]], "right"))]
                at = np.arange(n[e[-1]])[:, None]
                is_, at = at < n[e], np.minimum(cuts[e] + at, len(g) - 1)
                t, s, k = (v[at] for v in values)
                r = locate_events(t, s, np.where(is_, k, -1), tab, grid, most=most, **settings)
                out.append(pd.DataFrame({"event": events[cuts[e]], **r})[names])
                order = order[len(e) :]
            return pd.concat(out) if out else pd.DataFrame(columns=names)

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= ROWS_PER_CALL:
                g = pd.concat(held, ignore_index=True)
                events = g["event"].to_numpy()
                whole = np.flatnonzero(events[1:] != events[:-1])[-1:] + 1  # the last event may go on
                if len(whole):
                    yield located(g[: whole[0]])
                    g = g[whole[0] :]
                held, rows = [g], len(g)
        if rows:
            yield located(pd.concat(held, ignore_index=True))

    a = arrivals.select("event", "station", "place", "phase", time, "sigma_s")
    # The window keeps an event's rows together and in one task, without a shuffle of its own where they are.
    a = (spread(a, "event") if spread_out else a).withColumn("_readings", F.count("*").over(Window.partitionBy("event"))).where("_readings >= 4").drop("_readings")
    return a.mapInPandas(run, LOCATION.replace("event long", f"event {kind}")), shared


def double_differences(pairs: DataFrame, readings: DataFrame, *, residual: str, max_separation_km: float, cutoff_s: float, weight_p: float = 1.0, weight_s: float = 0.5, least: float = 1e-3) -> DataFrame:
    """(a, b, station, phase, dd, weight): differences of residuals of common readings of event pairs (a, b, km).

    Weight: by phase, a tricube of separation and one of the difference, over the joint uncertainty; those below `least` are dropped.
    """
    r = readings.select("event", "station", "phase", F.col(residual).alias("r"), "sigma_s")
    x = r.withColumnsRenamed({"event": "a", "r": "ra", "sigma_s": "sa"})
    y = r.withColumnsRenamed({"event": "b", "r": "rb", "sigma_s": "sb"})
    j = pairs.select("a", "b", "km").join(x, "a").join(y, ["b", "station", "phase"])
    return _weighted(j, max_separation_km, cutoff_s, weight_p, weight_s, least)


def near_differences(readings: DataFrame, events: DataFrame, *, residual: str, max_separation_km: float, cutoff_s: float, weight_p: float = 1.0, weight_s: float = 0.5, least: float = 1e-3, id: str = "event", lat: str = "ev_lat", lon: str = "ev_lon", depth_km: str = "depth_km") -> DataFrame:
    """`double_differences` of all events (id, lat, lon, depth_km) at most `max_separation_km` apart. Readings meet by station, phase and place, so
    that pairs without common readings, nearly all of large catalogues, are not made."""
    r = readings.withColumns({"r": F.col(residual), "s": F.col("sigma_s")})
    j = common_readings(r, events, max_separation_km, ["r", "s"], id=id, lat=lat, lon=lon, depth_km=depth_km)
    return _weighted(j.withColumnsRenamed({"r_a": "ra", "r_b": "rb", "s_a": "sa", "s_b": "sb"}), max_separation_km, cutoff_s, weight_p, weight_s, least)


def _weighted(j: DataFrame, max_separation_km: float, cutoff_s: float, weight_p: float, weight_s: float, least: float) -> DataFrame:
    j = j.withColumn("dd", F.col("ra") - F.col("rb"))
    prior = F.when(F.col("phase") == "P", weight_p).otherwise(weight_s) * tricube(F.col("km"), max_separation_km) * tricube(F.col("dd"), cutoff_s)
    j = j.withColumn("prior", prior).where(F.col("prior") >= least)
    return j.select("a", "b", "station", "phase", "dd", (F.col("prior") / F.sqrt(F.pow("sa", 2) + F.pow("sb", 2))).alias("weight"))


def cc_differences(pairs: DataFrame, cc: DataFrame, readings: DataFrame, *, max_separation_km: float, cutoff_s: float, sigma_s: float = 0.01, weight_p: float = 1.0, weight_s: float = 0.5, least: float = 1e-3) -> DataFrame:
    """(a, b, station, phase, dd, weight) of differences measured by cross-correlation (a, b, station, phase, dt_s, cc): what the model's times and
    origin shifts (`r` and `time_s` of the readings) leave of them."""
    one = cc.where(F.col("cc") > 0).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "station", "phase", F.when(F.col("a") < F.col("b"), F.col("dt_s")).otherwise(-F.col("dt_s")).alias("dt_s"), "cc")
    k = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "km").distinct()
    model = readings.select("event", "station", "phase", (F.col("time_s") - F.col("r")).alias("t"))  # time of the model and origin shift
    j = one.join(k, ["a", "b"]).join(model.withColumnsRenamed({"event": "a", "t": "ta"}), ["a", "station", "phase"]).join(model.withColumnsRenamed({"event": "b", "t": "tb"}), ["b", "station", "phase"])
    j = j.withColumn("dd", F.col("dt_s") - (F.col("ta") - F.col("tb")))
    prior = F.when(F.col("phase") == "P", weight_p).otherwise(weight_s) * F.col("cc") * tricube(F.col("km"), max_separation_km) * tricube(F.col("dd"), cutoff_s)
    return j.withColumn("prior", prior).where(F.col("prior") >= least).select("a", "b", "station", "phase", "dd", (F.col("prior") / sigma_s).alias("weight"))


def relocate_pairs(spark: SparkSession, arrivals: DataFrame, pairs: DataFrame, grid: Grid, slowness: dict[str, np.ndarray], *, iterations: int = 3, max_separation_km: float = 10.0, cutoff_s: float = 1.0, damping: float = 1.0, straight: bool = False, cc: DataFrame | None = None, cc_sigma_s: float = 0.01) -> pd.DataFrame:
    """Relative hypocentres by double differences: (event, ev_lon, ev_lat, depth_km, t0) after some iterations.

    Arrivals (event, station, phase, time_s, sigma_s and coordinates), pairs (a, b, km). `cc`: differences of travel times by cross-correlation
    (a, b, station, phase, dt_s, cc) of pairs in either order, weighted by coefficient over `cc_sigma_s`, beside those of the readings. Differences of residuals of common readings are fitted by
    changes of both hypocentres, with the kernels' gradients; the centre of all moves stays. Rows are distributed; the driver holds one row an
    event and the solution.
    """
    from quakespark.plans.forward import kernel_rows
    from quakespark.plans.linalg import solve_rows

    scratch = Scratch(spark, "differences")
    a = scratch.keep(arrivals.withColumn("arrival", F.monotonically_increasing_id()))
    ev = a.groupBy("event").agg(F.first("ev_lon").alias("ev_lon"), F.first("ev_lat").alias("ev_lat"), F.first("depth_km").alias("depth_km")).toPandas().sort_values("event").reset_index(drop=True)
    ev["t0"], ev["column"] = 0.0, np.arange(len(ev))
    fixed = a.drop("ev_lon", "ev_lat", "depth_km")
    for _ in range(iterations):
        e = spark.createDataFrame(ev)
        k = kernel_rows(fixed.join(e, "event"), grid, slowness, straight=straight).drop("nodes", "km")
        r = scratch.keep(k.join(fixed.select("arrival", "time_s", "sigma_s"), "arrival").join(e.select("event", "t0", "column"), "event").withColumn("r", F.col("time_s") - F.col("t0") - F.col("t_calc")))
        d = double_differences(pairs, r, residual="r", max_separation_km=max_separation_km, cutoff_s=cutoff_s)
        if cc is not None:
            d = d.unionByName(cc_differences(pairs, cc, r, max_separation_km=max_separation_km, cutoff_s=cutoff_s, sigma_s=cc_sigma_s))
        g = r.select("event", "station", "phase", "ge", "gn", "gd", "column")
        x = g.withColumnsRenamed({"event": "a", **{c: f"{c}_a" for c in ("ge", "gn", "gd", "column")}})
        y = g.withColumnsRenamed({"event": "b", **{c: f"{c}_b" for c in ("ge", "gn", "gd", "column")}})
        j = d.join(x, ["a", "station", "phase"]).join(y, ["b", "station", "phase"])
        w = F.col("weight")
        cols = F.array(*[(4 * F.col(f"column_{s}") + i).cast("int") for s in "ab" for i in range(4)])
        vals = F.array(*[(1 if s == "a" else -1) * w * v for s in "ab" for v in (F.lit(1.0), F.col(f"ge_{s}"), F.col(f"gn_{s}"), F.col(f"gd_{s}"))])
        rows = j.select(cols.alias("columns"), vals.alias("values"), (w * F.col("dd")).alias("rhs"))
        damp = spark.range(4 * len(ev)).select(F.array(F.col("id").cast("int")).alias("columns"), F.array(F.lit(float(damping))).alias("values"), F.lit(0.0).alias("rhs"))
        h = solve_rows(scratch.keep(rows.unionByName(damp)), 4 * len(ev))[0].reshape(-1, 4)
        h -= h.mean(0)
        rad = EARTH_KM - ev["depth_km"].to_numpy()
        lat = ev["ev_lat"].to_numpy()
        ev["t0"] += h[:, 0]
        ev["ev_lon"] = np.clip(ev["ev_lon"] + np.degrees(h[:, 1] / (rad * np.cos(np.radians(lat)))), grid.min_lon, grid.max_lon)
        ev["ev_lat"] = np.clip(lat + np.degrees(h[:, 2] / rad), grid.min_lat, grid.max_lat)
        ev["depth_km"] = np.clip(ev["depth_km"] + h[:, 3], grid.min_depth, grid.max_depth)
    return ev.drop(columns="column")


def cached_tables(spark: SparkSession, folder: str, stations: DataFrame, grid: Grid, slowness: dict[str, np.ndarray]) -> DataFrame:
    """Travel-time tables from a folder, made where they are missing: a table belongs to a model, a station and a phase, and the model's
    key is a hash of its grid and slowness."""
    import hashlib

    h = hashlib.sha256(grid.to_json().encode())
    for p in sorted(slowness):
        h.update(p.encode() + np.ascontiguousarray(slowness[p], "<f8").tobytes())
    path = f"{folder.rstrip('/')}/model={h.hexdigest()[:24]}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(conf).exists(there):
        known = spark.read.parquet(path)
        missing = stations.join(known.select("station").distinct(), "station", "left_anti")
        if not missing.limit(1).count():
            return known
        travel_time_tables(missing, grid, slowness, tuple(slowness)).write.mode("append").parquet(path)
    else:
        travel_time_tables(stations, grid, slowness, tuple(slowness)).write.parquet(path)
    return spark.read.parquet(path)
