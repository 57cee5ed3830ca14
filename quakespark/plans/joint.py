"""Steps of inversions with straight rays over a table of one row an event with its readings: every pass is narrow, kernels are made where they are
used and stored nowhere, hypocentres are eliminated where their readings are, and the driver gets sums of the model's size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quakespark.functions.geo import EARTH_KM
from quakespark.functions.grid import Grid
from quakespark.plans.forward import straight_geometry

READING = ["station", "phase", "time_s", "sigma_s", "st_lon", "st_lat", "elevation_m"]
PLACE = ["ev_lon", "ev_lat", "depth_km"]
#: Bytes of partial sums that all tasks together write for a step, beyond one a core.
SUM_BYTES = 512_000_000
#: Widest model whose equations are made dense for many events at once; wider ones are added up in the columns that an event's rays reach.
NARROW = 64


def gather(arrivals: DataFrame) -> DataFrame:
    """(event, its place, origin shift `t0`, the place at the start, and an array a column of its readings): one row an event."""
    a = arrivals.where(F.col("event").isNotNull() & F.col("station").isNotNull())
    r = a.groupBy("event").agg(*[F.first(c).cast("double").alias(c) for c in PLACE], F.sort_array(F.collect_list(F.struct(*READING))).alias("r"))
    return r.select("event", *PLACE, F.lit(0.0).alias("t0"), *[F.col(c).alias(f"{c}_0") for c in PLACE], *[F.col(f"r.{c}").alias(c) for c in READING])


def single(events: DataFrame) -> DataFrame:
    """The readings again, one a row, with their event's place."""
    return events.select("event", *PLACE, F.explode(F.arrays_zip(*READING)).alias("r")).select("event", *PLACE, "r.*")


class Pass:
    """What tasks need of the present model: slowness, station terms and settings; kernels of some events' readings at a time."""

    def __init__(self, grid: Grid, v: dict[str, np.ndarray], st: pd.DataFrame, s, unknown: int, cell: np.ndarray | None):
        self.grid, self.s, self.unknown, self.cell, self.phases = grid, s, unknown, cell, list(v)
        self.full = {p: 1 / v[p] for p in v}
        self.short = {p: x[:: grid.nx * grid.ny if s.layered else 1] for p, x in self.full.items()}
        self.width = unknown * len(v)
        self.stations = None
        if s.station_terms:
            self.stations = {p: (pd.Index(g["station"]), g["column"].to_numpy(), g["term"].to_numpy(float)) for p, g in st.groupby("phase")}
            self.width += len(st)
        self.at_once = 20_000 if s.layered else max(50, min(2000, 4_000_000 // grid.nodes))

    def parts(self, batches) -> Iterator[tuple[pa.RecordBatch, dict]]:
        """Some events at a time, with arrays of their readings: `of` (row of the event), kernel (ray, node, km), `h` (derivatives by origin
        time and place) and residual."""
        for whole in batches:
            ends = np.cumsum(pa.compute.list_value_length(whole.column(whole.schema.get_field_index("phase"))).to_numpy(zero_copy_only=False))
            a = 0
            while a < whole.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + self.at_once, "right")))
                part = whole.slice(a, b - a)
                yield part, self.readings(part)
                a = b

    def readings(self, b: pa.RecordBatch, start: str = "") -> dict:
        col = lambda c: b.column(b.schema.get_field_index(c))
        flat = lambda c: col(c).flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(col("phase")).to_numpy(zero_copy_only=False))
        lon, lat, dep = (col(c + start).to_numpy(zero_copy_only=False).astype(float)[of] for c in PLACE)
        phase = flat("phase")
        ray, node, km, t, v = straight_geometry(self.grid, self.full, self.short, self.s.layered, phase, lon, lat, dep, *[flat(c).astype(float) for c in ("st_lon", "st_lat", "elevation_m")])
        shift = 0.0 if start else col("t0").to_numpy(zero_copy_only=False)[of]
        term, st = np.zeros(len(of)), None
        if self.stations is not None:
            st, name = np.zeros(len(of), np.int64), flat("station")
            for p, (index, column, value) in self.stations.items():
                k = np.flatnonzero(phase == p)
                at = index.get_indexer(name[k])
                st[k], term[k] = column[at], value[at]
        residual = flat("time_s").astype(float) - shift - t - (0.0 if start else term)
        return {"of": of, "phase": phase, "ray": ray, "node": node, "km": km, "v": v, "st": st, "residual": residual, "sigma": flat("sigma_s").astype(float)}

    def far(self, d: dict, events: int) -> np.ndarray:
        """Distances of residuals from their event's averaging median."""
        r, of = d["residual"], d["of"]
        n = np.bincount(of[~np.isnan(r)], minlength=events)
        first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=events))[:-1]])
        o = r[np.lexsort((r, of))]  # NaN comes last
        mid = np.full(events, np.nan)
        k = np.flatnonzero(n)
        mid[k] = (o[first[k] + (n[k] - 1) // 2] + o[first[k] + n[k] // 2]) / 2
        return np.abs(r - mid[of])

    def rejected(self, d: dict, events: int, limit: float) -> np.ndarray:
        return ~((self.far(d, events) <= limit) & (np.abs(d["residual"]) <= self.s.max_residual_s))

    def equations(self, d: dict, used: np.ndarray):
        """(row, column, value) of the model's part of the rows, each row's hypocentre part and right side, all by weight; rows of `used` readings."""
        number = np.cumsum(used) - 1
        k = used[d["ray"]]
        ray, node, km = d["ray"][k], d["node"][k], d["km"][k]
        w = 1 / np.maximum(0.01, d["sigma"][used])
        row, col, val = number[ray], node if self.cell is None else self.cell[node], np.zeros(len(ray))
        shift = np.zeros(len(ray), np.int64)
        for q, p in enumerate(self.phases):
            of = (d["phase"] == p)[ray]
            val[of], shift[of] = km[of] * self.short[p][node[of]], q * self.unknown
        col, val = col + shift, val * w[row]
        if self.s.ratio and len(self.phases) == 2:
            of = (d["phase"] == "S")[ray]
            row, col, val = np.concatenate([row, row[of]]), np.concatenate([col, col[of] - self.unknown]), np.concatenate([val, val[of]])
        if self.stations is not None:
            row, col, val = np.concatenate([row, np.arange(len(w))]), np.concatenate([col, self.unknown * len(self.phases) + d["st"][used]]), np.concatenate([val, w])
        h = np.column_stack([np.ones(len(w)), d["v"][used]]) * w[:, None] * (1.0 if self.s.joint_hypocentres else 0.0)
        return row, col, val, h, d["residual"][used] * w

    def own(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The damped 4 x 4 matrix of each event whose rows begin `at`."""
        return np.add.reduceat(h[:, :, None] * h[:, None, :], at, 0) + (self.s.damping_hypocentre**2 if self.s.joint_hypocentres else 1.0) * np.eye(4)


def measure(events: DataFrame, p: Pass) -> DataFrame:
    """(residual, far, sigma) of all readings."""

    def run(batches):
        for b, d in p.parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(d["residual"]), pa.array(p.far(d, b.num_rows)), pa.array(d["sigma"])], names=["residual", "far", "sigma"])

    return events.mapInArrow(run, "residual double, far double, sigma double")


def solved(events: DataFrame, p: Pass, limit: float, extra: list, formal=None) -> tuple[np.ndarray, tuple | None]:
    """(the model's part of a step, what `formal` makes of the matrix with and without `extra`): the normal equations of the model, after the elimination of each
    event's hypocentre, and of the rows `extra` (columns, values, right side). They are added up and solved in tasks; the driver gets vectors of the model's length."""
    width = p.width

    def run(batches):
        big, right = np.zeros((width, width)), np.zeros(width)
        for b, d in p.parts(batches):
            used = ~p.rejected(d, b.num_rows, limit)
            if not used.any():
                continue
            row, col, val, h, y = p.equations(d, used)
            at = np.flatnonzero(np.diff(d["of"][used], prepend=-1))
            hh, g = p.own(h, at), np.add.reduceat(h * y[:, None], at, 0)
            if width <= NARROW:
                a = np.bincount(row * width + col, val, len(y) * width).reshape(len(y), width)
                c = np.add.reduceat(h[:, :, None] * a[:, None, :], at, 0)
                z = np.linalg.solve(hh, c)
                big += a.T @ a - c.reshape(-1, width).T @ z.reshape(-1, width)
                right += a.T @ y - z.reshape(-1, width).T @ g.ravel()
                continue
            # The rows' projection I - h H^-1 h', an event at a time, in the columns that its rays reach.
            turn = np.linalg.solve(hh, np.stack([np.eye(4)] * len(at)))
            o = np.argsort(row, kind="stable")
            row, col, val = row[o], col[o], val[o]
            ends = np.append(at, len(y))
            cuts = np.searchsorted(row, ends)
            seen, flat = np.zeros(width, np.int64), big.reshape(-1)
            for e in range(len(at)):
                i, j = ends[e], ends[e + 1]
                r, c, x, m = row[cuts[e] : cuts[e + 1]] - i, col[cuts[e] : cuts[e + 1]], val[cuts[e] : cuts[e + 1]], j - i
                mark = np.zeros(width, bool)
                mark[c] = True
                cols = np.flatnonzero(mark)
                seen[cols] = np.arange(len(cols))
                a = np.bincount(r * len(cols) + seen[c], x, m * len(cols)).reshape(m, len(cols))
                he = h[i:j]
                qa = a - he @ (turn[e] @ (he.T @ a))
                # What lies below the diagonal isn't read, so the second half of the rows needs no first half of the columns.
                own, half = a.T @ qa, -(-len(cols) // 2)
                for k, to in ((0, half), (half, len(cols))):
                    np.add.at(flat, ((cols[k:to] * width)[:, None] + cols[k:]).ravel(), own[k:to, k:].ravel())
                right[cols] += qa.T @ y[i:j]
        for k in range(0, width, 64):
            i = range(k, min(width, k + 64))
            yield pa.RecordBatch.from_arrays([pa.array(list(i), pa.int32()), pa.array([big[j, j:] for j in i], pa.list_(pa.float64()))], names=["i", "v"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([right], pa.list_(pa.float64()))], names=["i", "v"])

    def add(batches):
        total = {}
        for b in batches:
            for i, v in zip(b.column(0).to_numpy(), b.column(1)):
                v = v.values.to_numpy()
                total[i] = total[i] + v if i in total else v.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "v"])

    def solve(batches):
        big, right = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            for i, v in zip(b.column(0).to_numpy(), b.column(1)):
                v = v.values.to_numpy()
                if i < 0:
                    right += v
                else:
                    big[i, i:] += v
        for i in range(width):
            big[i + 1 :, i] = big[i, i + 1 :]
        data = None if formal is None else big.copy()
        for c, x, y in extra:
            c, x = np.asarray(c), np.asarray(x, float)
            big[np.ix_(c, c)] += np.outer(x, x)
            right[c] += x * y
        try:
            out = [np.linalg.solve(big, right)]
        except np.linalg.LinAlgError:  # without damping, parts that no ray reaches: the shortest solution
            out = [np.linalg.lstsq(big, right)[0]]
        if formal is not None:
            out += formal(big, data)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out, pa.list_(pa.float64()))], names=["i", "v"])

    cores = events.sparkSession.sparkContext.defaultParallelism
    kind = "i int, v array<double>"
    parts = events.coalesce(max(cores, SUM_BYTES // (4 * width * width))).mapInArrow(run, kind)
    got = parts.repartition(cores, "i").mapInArrow(add, kind).repartition(1).mapInArrow(solve, kind).toArrow()
    out = {i: np.array(v) for i, v in zip(got["i"].to_pylist(), got["v"].to_pylist())}
    return out[0], None if formal is None else (out[1], out[2])


def moved(events: DataFrame, p: Pass, limit: float, x: np.ndarray, share: float) -> DataFrame:
    """The events after a share of their part of the step, solved from the model's part `x`; hypocentres stay in the grid."""
    g = p.grid
    out = to_arrow_schema(events.schema)

    def run(batches):
        for b, d in p.parts(batches):
            used = ~p.rejected(d, b.num_rows, limit)
            step = np.zeros((b.num_rows, 4))
            if used.any():
                row, col, val, h, y = p.equations(d, used)
                at = np.flatnonzero(np.diff(d["of"][used], prepend=-1))
                left = y - np.bincount(row, val * x[col], len(y))
                step[d["of"][used][at]] = np.linalg.solve(p.own(h, at), np.add.reduceat(h * left[:, None], at, 0)[..., None])[..., 0] * share
            lon, lat, dep, t0 = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*PLACE, "t0"))
            r = EARTH_KM - dep
            now = {
                "ev_lon": np.clip(lon + np.degrees(step[:, 1] / (r * np.cos(np.radians(lat)))), g.min_lon, g.max_lon),
                "ev_lat": np.clip(lat + np.degrees(step[:, 2] / r), g.min_lat, g.max_lat),
                "depth_km": np.clip(dep + step[:, 3], g.min_depth, g.max_depth),
                "t0": t0 + step[:, 0],
            }
            yield pa.RecordBatch.from_arrays([pa.array(now[f.name]) if f.name in now else b.column(b.schema.get_field_index(f.name)).cast(f.type) for f in out], schema=out)

    return events.mapInArrow(run, events.schema) if p.s.joint_hypocentres else events


def residuals(events: DataFrame, p: Pass, limit: float, start: Pass) -> DataFrame:
    """(event, station, phase, time_s, sigma_s, initial_residual_s, residual, rejected) of all readings."""
    kind = lambda c: events.schema[c].dataType
    out = f"event {kind('event').simpleString()}, station {kind('station').elementType.simpleString()}, phase string, time_s double, sigma_s double, initial_residual_s double, residual double, rejected boolean"
    arrow = to_arrow_schema(events.sparkSession.createDataFrame([], out).schema)

    def run(batches):
        for b, d in p.parts(batches):
            col = lambda c, b=b: b.column(b.schema.get_field_index(c))
            made = {"event": col("event").take(pa.array(d["of"])), **{c: col(c).flatten() for c in READING}}
            made |= {"initial_residual_s": pa.array(start.readings(b, "_0")["residual"]), "residual": pa.array(d["residual"]), "rejected": pa.array(p.rejected(d, b.num_rows, limit))}
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in arrow], schema=arrow)

    return events.mapInArrow(run, out)
