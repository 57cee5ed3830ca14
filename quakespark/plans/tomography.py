"""Travel-time tomography: velocity, hypocentres and station terms by repeated regularised least squares over distributed arrivals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark.common import Scratch, shuffle_partitions
from quakespark.functions.geo import EARTH_KM, to_cartesian
from quakespark.functions.grid import Grid
from quakespark.operators import regular, stats
from quakespark.operators.fields import chord_crosses
from quakespark.plans import joint
from quakespark.plans.forward import coverage, kernel_rows
from quakespark.plans.linalg import solve_rows
from quakespark.plans.locate import double_differences
from quakespark.plans.mesh import Mesh, octree, to_nodes


@dataclass
class Settings:
    iterations: int = 5
    damping: float = 20.0
    smoothing: float = 20.0
    vertical_smoothing: float = 0.1
    damping_hypocentre: float = 1.0
    damping_station: float = 5.0
    joint_hypocentres: bool = True
    station_terms: bool = False
    layered: bool = False
    straight: bool = False
    max_step: float = 0.1
    outlier_mads: float = 4.0
    outlier_floor_s: float = 0.3
    max_residual_s: float = 5.0
    vp: tuple[float, float] = (1.5, 14.5)
    vs: tuple[float, float] = (0.7, 8.5)
    solver_turns: int = 400
    halvings: int = 3
    adaptive: bool = False
    cell_nodes: int = 8
    cell_depth_nodes: int = 4
    cell_hits: float = 10.0
    ratio: bool = False  # Vp/Vs instead of Vs
    regularisation: str = "laplacian"  # or 'gradient', 'variation' (total variation), 'edges'
    edge_scale: float = 1.0
    double_difference_weight: float = 1.0
    max_separation_km: float = 10.0
    cutoff_s: float = 1.0


@dataclass
class Result:
    velocity: dict[str, np.ndarray]
    #: (event, ev_lon, ev_lat, depth_km, t0), one row an event.
    hypocentres: DataFrame
    stations: pd.DataFrame
    history: list[dict] = field(default_factory=list)
    start: dict[str, np.ndarray] = field(default_factory=dict)
    #: Gives sums of ray lengths and numbers of rays at the nodes, by phase.
    cover: Callable[[], tuple[dict, dict]] = lambda: ({}, {})
    #: (event, station, phase, time_s, sigma_s, initial_residual_s, residual, rejected) of every arrival.
    residuals: DataFrame | None = None
    mesh: Mesh | None = None
    #: (resolution, standard error) of each unknown of the model, hypocentres eliminated: of layered models.
    formal: tuple[np.ndarray, np.ndarray] | None = None

    @cached_property
    def events(self) -> pd.DataFrame:
        """The hypocentres on the driver."""
        return self.hypocentres.toPandas().sort_values("event").reset_index(drop=True)

    @cached_property
    def _covered(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        return self.cover()

    @property
    def dws(self) -> dict[str, np.ndarray]:
        return self._covered[0]

    @property
    def hits(self) -> dict[str, np.ndarray]:
        return self._covered[1]


def invert(spark: SparkSession, arrivals: DataFrame, grid: Grid, velocity: dict[str, np.ndarray], settings: Settings | None = None, *, pairs: DataFrame | None = None) -> Result:
    """Model from arrivals (event, station, phase, time_s, sigma_s, ev_lon, ev_lat, depth_km, st_lon, st_lat, elevation_m).

    Arrivals, kernels and equations stay distributed; the driver holds the model and one row a station. With straight rays, no `pairs` and a model
    whose normal equations fit a task (`SMALL` unknowns of layers, `DENSE` of nodes or cells), events stay distributed too, hypocentres are eliminated
    where their readings are, and the model is solved exactly; else the driver also holds one row an event, and the solution.
    Columns of the system: fractional slowness of P and S nodes (or layers, or with `adaptive` octree cells that follow the starting rays), four of
    each hypocentre, one a station and phase. With `ratio` the second set of nodes is the fractional Vp/Vs, on which, like on P, S times depend: it is
    smoothed and damped in place of S. With `pairs` of events (a, b, km) there is also a row for each difference of two events' residuals at one
    station, in which what their rays share cancels.
    """
    s = settings or Settings()
    scratch = Scratch(spark, "tomography")
    phases = [p for p in ("P", "S") if p in velocity]
    if s.straight and pairs is None and (found := _by_event(spark, arrivals.where(F.col("phase").isin(phases)), grid, velocity, phases, s)):
        return found
    v = {p: np.asarray(velocity[p], float).ravel().copy() for p in phases}
    start = {p: 1 / v[p] for p in phases}
    unknown, mesh = grid.nz if s.layered else grid.nodes, None
    a = arrivals.select("event", "station", "phase", "time_s", "sigma_s", "ev_lon", "ev_lat", "depth_km", "st_lon", "st_lat", "elevation_m").where(F.col("phase").isin(phases))
    a = scratch.keep(a.withColumn("arrival", F.monotonically_increasing_id()))
    ev = a.groupBy("event").agg(F.first("ev_lon").alias("ev_lon"), F.first("ev_lat").alias("ev_lat"), F.first("depth_km").alias("depth_km")).toPandas().sort_values("event").reset_index(drop=True)
    ev["t0"], ev["column"] = 0.0, np.arange(len(ev))
    st = a.select("station", "phase").distinct().toPandas().sort_values(["station", "phase"]).reset_index(drop=True)
    st["term"], st["column"] = 0.0, np.arange(len(st))
    fixed = a.drop("ev_lon", "ev_lat", "depth_km")
    history, old, before, first, formal = [], None, None, None, {}
    step, tries = None, 0
    it = 0
    while True:
        e = spark.createDataFrame(ev)
        now = fixed.join(e, "event")
        k = scratch.keep(kernel_rows(now, grid, {p: 1 / v[p] for p in phases}, straight=s.straight, layered=s.layered, carry=["time_s", "sigma_s", "t0", "column"]))
        if s.adaptive and not s.layered and mesh is None:
            mesh = octree(grid, sum(_coverage(k, grid)[1].values()), largest=s.cell_nodes, largest_depth=s.cell_depth_nodes, threshold=s.cell_hits)
            unknown = mesh.n
        t = spark.createDataFrame(st.rename(columns={"column": "st_column"}))
        r = k.join(t, ["station", "phase"])
        r = r.withColumn("residual", F.col("time_s") - F.col("t0") - F.col("t_calc") - F.col("term"))
        r = scratch.keep(stats.reject_outliers(r, residual="residual", floor_s=s.outlier_floor_s, mads=s.outlier_mads, centre_by=["event"], absolute_s=s.max_residual_s, scratch=scratch))
        first = first if first is not None else r.select("arrival", F.col("residual").alias("initial_residual_s"))
        ok = r.where(~F.col("rejected"))
        m = ok.agg(F.count(F.lit(1)).alias("used"), F.sqrt(F.avg(F.pow("residual", 2))).alias("rms"), F.sum(F.pow(F.col("residual") / F.greatest(F.lit(0.01), F.col("sigma_s")), 2)).alias("misfit")).first()
        if before is not None and tries < s.halvings and m["misfit"] / max(1, m["used"]) > 1.001 * before and step is not None:
            tries += 1  # the step made it worse: half of it from the state before
            v, ev, st = _moved(old, step, 0.5**tries, grid, phases, s, unknown, mesh)
            continue
        history.append({"iteration": it, "used": m["used"], "rms_s": m["rms"], "halvings": tries})
        tries = 0
        if it == s.iterations:
            break
        before = m["misfit"] / max(1, m["used"])
        old = ({p: v[p].copy() for p in phases}, ev.copy(), st.copy())
        step = _step(spark, scratch, ok, m["used"], grid, v, start, ev, st, phases, s, unknown, mesh, pairs, formal)
        v, ev, st = _moved(old, step, 1.0, grid, phases, s, unknown, mesh)
        it += 1
    shape = lambda x: x.reshape(grid.nz, grid.ny, grid.nx)
    cover = lambda: ({}, {}) if s.layered else tuple({p: shape(x) for p, x in c.items()} for c in _coverage(k, grid))
    left = r.join(first, "arrival").select("event", "station", "phase", "time_s", "sigma_s", "initial_residual_s", "residual", "rejected")
    hypocentres = spark.createDataFrame(ev.drop(columns="column"))
    return Result({p: shape(v[p]) for p in phases}, hypocentres, st.drop(columns="column"), history, {p: shape(1 / start[p]) for p in phases}, cover, left, mesh, formal.get("model"))


#: Unknowns of a model of nodes or cells whose normal equations are made in tasks and solved in one of them (134 MB, and a copy).
DENSE = 4096


def _by_event(spark: SparkSession, arrivals: DataFrame, grid: Grid, velocity: dict[str, np.ndarray], phases: list[str], s: Settings) -> Result | None:
    """`invert` over one row an event with its readings: straight rays, no pairs. None where the model is too wide."""
    least, most = (grid.nz, SMALL) if s.layered else (1 if s.adaptive else grid.nodes, DENSE)
    if least * len(phases) > most:
        return None
    scratch = Scratch(spark, "events")
    v = {p: np.asarray(velocity[p], float).ravel().copy() for p in phases}
    start, first = {p: 1 / v[p] for p in phases}, {p: v[p].copy() for p in phases}
    shape = lambda x: x.reshape(grid.nz, grid.ny, grid.nx)
    e = scratch.keep(joint.gather(arrivals))
    unknown, mesh = grid.nz if s.layered else grid.nodes, None
    if s.adaptive and not s.layered:
        mesh = octree(grid, sum(_covered(e, grid)[1].values()), largest=s.cell_nodes, largest_depth=s.cell_depth_nodes, threshold=s.cell_hits)
        unknown = mesh.n
    st = e.select(F.explode(F.arrays_zip("station", "phase")).alias("r")).select("r.station", "r.phase").distinct().toPandas().sort_values(["station", "phase"]).reset_index(drop=True)
    st["term"], st["column"] = 0.0, np.arange(len(st))
    if unknown * len(phases) + (len(st) if s.station_terms else 0) > most:
        scratch.drop(e)
        return None
    none = pd.DataFrame({c: np.zeros(0) for c in (*joint.PLACE, "t0")})
    make = lambda v, st: joint.Pass(grid, v, st, s, unknown, None if mesh is None else mesh.of_node)
    begin = make(first, st)
    history, old, before, formal = [], None, None, None
    it = tries = 0
    while True:
        now = make(v, st)
        far = scratch.keep(joint.measure(e, now))
        mad = stats.median(far, [], "far").first()
        limit = max(s.outlier_floor_s, s.outlier_mads * 1.4826 * mad["median"]) if mad else s.outlier_floor_s
        ok = far.where(~F.isnan("far") & (F.col("far") <= limit) & (F.abs("residual") <= s.max_residual_s))
        m = ok.agg(F.count(F.lit(1)).alias("used"), F.sqrt(F.avg(F.pow("residual", 2))).alias("rms"), F.sum(F.pow(F.col("residual") / F.greatest(F.lit(0.01), F.col("sigma")), 2)).alias("misfit")).first()
        scratch.drop(far)
        if before is not None and tries < s.halvings and m["misfit"] / max(1, m["used"]) > 1.001 * before:
            tries += 1  # the step made it worse: half of it from the state before
            scratch.drop(e)
            e = scratch.keep(joint.moved(old[0], make(*old[1:3]), old[3], step, 0.5**tries))
            v, _, st = _moved((old[1], none, old[2]), step, 0.5**tries, grid, phases, s, unknown, mesh)
            continue
        history.append({"iteration": it, "used": m["used"], "rms_s": m["rms"], "halvings": tries})
        tries = 0
        scratch.drop(old and old[0])
        if it == s.iterations:
            break
        before = m["misfit"] / max(1, m["used"])
        old = (e, v, st, limit)
        step, formal = _reduced(spark, e, now, limit, grid, v, start, st, phases, s, unknown, mesh)
        e = scratch.keep(joint.moved(e, now, limit, step, 1.0))
        v, _, st = _moved((v, none, st), step, 1.0, grid, phases, s, unknown, mesh)
        it += 1
    cover = lambda: ({}, {}) if s.layered else tuple({p: shape(x) for p, x in c.items()} for c in _covered(e, grid))
    hypocentres = e.select("event", *joint.PLACE, "t0")
    return Result({p: shape(v[p]) for p in phases}, hypocentres, st.drop(columns="column"), history, {p: shape(first[p]) for p in phases}, cover, joint.residuals(e, now, limit, begin), mesh, formal)


def _covered(events: DataFrame, grid: Grid) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """`_coverage` of the straight rays of all readings, which tasks add up without storing kernels."""
    rows = coverage(joint.single(events), grid, piece_km=0.5 * grid.min_spacing_km).toPandas()
    out = {}, {}
    for p, g in rows.groupby("phase"):
        for x, c in zip(out, ("dws", "hits")):
            x[p] = np.bincount(g["node"], g[c], grid.nodes)
    return out


def _reduced(spark, events, now, limit, grid, v, start, st, phases, s, unknown, mesh) -> tuple[np.ndarray, tuple | None]:
    """(the model's and stations' part of a step, and of layered models with hypocentres the formal resolution and errors)."""
    extra, tables = _regularisation(spark, grid, v, start, st, phases, s, unknown, mesh, unknown * len(phases))
    for t in tables:
        extra += [(r["columns"], r["values"], r["rhs"]) for r in t.collect()]  # three rows a node at most
    return joint.solved(events, now, limit, extra, _formal if s.layered and s.joint_hypocentres else None)


def _formal(big: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the factor of the whole normal matrix: R = (A'A + D)^-1 A'A, and the covariance of unit-weight data R (A'A + D)^-1."""
    r = np.linalg.solve(big, data)
    return np.diag(r).copy(), np.sqrt(np.maximum(0.0, np.diag(np.linalg.solve(big, r.T))))


def _coverage(k: DataFrame, grid: Grid) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(ray lengths, numbers of rays) at the nodes by phase, of kernel rows; of the model's size."""
    rows = k.select("phase", F.explode(F.arrays_zip("nodes", "km")).alias("e")).groupBy("phase", F.col("e.nodes").alias("node")).agg(F.sum("e.km").alias("km"), F.count(F.lit(1)).alias("n")).toPandas()
    out = {}, {}
    for p, g in rows.groupby("phase"):
        for x, c in zip(out, ("km", "n")):
            x[p] = np.bincount(g["node"], g[c], grid.nodes)
    return out


def _step(spark, scratch, ok, used, grid, v, start, ev, st, phases, s, unknown, mesh=None, pairs=None, formal=None) -> np.ndarray:
    """Solution of one linear step: kernels, hypocentres, station terms, damping and smoothing, in one table of rows."""
    m = unknown * len(phases)
    base_ev = m
    base_st = base_ev + (4 * len(ev) if s.joint_hypocentres else 0)
    n = base_st + (len(st) if s.station_terms else 0)
    slow = {p: 1 / v[p] for p in phases}
    plane = grid.nx * grid.ny
    short = {p: slow[p][:: plane if s.layered else 1] for p in phases}
    w = lambda sigma: 1 / np.maximum(0.01, sigma)
    cell = mesh.of_node if mesh is not None else None
    ratio = s.ratio and len(phases) == 2

    def rows(batches):
        for b in batches:
            cols, vals, rhs = [], [], []
            for r in b.itertuples():
                nodes, km = np.asarray(r.nodes, np.int64), np.asarray(r.km, float)
                c, x = (nodes if cell is None else cell[nodes]) + phases.index(r.phase) * unknown, km * short[r.phase][nodes]
                if ratio and r.phase == "S":
                    c, x = np.concatenate([c - unknown, c]), np.concatenate([x, x])
                if s.joint_hypocentres:
                    c, x = np.concatenate([c, base_ev + 4 * r.column + np.arange(4)]), np.concatenate([x, [1.0, r.ge, r.gn, r.gd]])
                if s.station_terms:
                    c, x = np.append(c, base_st + r.st_column), np.append(x, 1.0)
                k = w(r.sigma_s)
                cols.append(c.astype(np.int32)), vals.append(x * k), rhs.append(r.residual * k)
            yield pd.DataFrame({"columns": cols, "values": vals, "rhs": rhs})

    data = ok.select("phase", "nodes", "km", "ge", "gn", "gd", "column", "st_column", "sigma_s", "residual").mapInPandas(rows, "columns array<int>, values array<double>, rhs double")
    schema = data.schema
    if pairs is not None and s.joint_hypocentres:
        data = data.unionByName(_difference_rows(ok, pairs, {p: (unknown * phases.index(p), short[p]) for p in phases}, cell, ratio, unknown, base_ev, s))
    # A small model is solved after each event's hypocentre is eliminated where its readings are, so no system of all events is made.
    small = s.layered and s.joint_hypocentres and pairs is None and m + (len(st) if s.station_terms else 0) <= SMALL
    extra, tables = _regularisation(spark, grid, v, start, st, phases, s, unknown, mesh, base_st)
    for t in tables:
        data = data.unionByName(t)
    if s.joint_hypocentres and not small:
        data = data.unionByName(spark.range(4 * len(ev)).select(F.array((F.col("id") + base_ev).cast("int")).alias("columns"), F.array(F.lit(float(s.damping_hypocentre))).alias("values"), F.lit(0.0).alias("rhs")))
    if small:
        return _eliminated(ok, used, n, base_ev, base_st, phases, short, len(ev), extra, s, scratch, formal)
    if extra:
        data = data.unionByName(spark.createDataFrame(extra, schema))
    return solve_rows(scratch.keep(data), n, tolerance=1e-6, max_turns=s.solver_turns)[0]


def _regularisation(spark, grid, v, start, st, phases, s: Settings, unknown: int, mesh, base_st: int) -> tuple[list, list[DataFrame]]:
    """Rows (columns, values, rhs) of damping, smoothing and the sums of station terms: on the driver, and in tables where the model is of nodes."""
    extra, tables = [], []
    slow = {p: 1 / v[p] for p in phases}
    plane = grid.nx * grid.ny
    cell = mesh.of_node if mesh is not None else None
    ratio = s.ratio and len(phases) == 2
    scale = plane**0.5 if s.layered else 1.0
    for q, p in enumerate(phases):
        m_now = (slow[p] - start[p]) / slow[p]
        if ratio and p == "S":
            now, then = slow["S"] / slow["P"], start["S"] / start["P"]
            m_now = (now - then) / now
        if s.layered:
            m_now = m_now.reshape(grid.nz, plane).mean(1)
            wz = scale * s.smoothing * s.vertical_smoothing
            for i in range(unknown):
                near = [j for j in (i - 1, i + 1) if 0 <= j < unknown]
                extra.append(([q * unknown + i] + [q * unknown + j for j in near], [wz * len(near)] + [-wz] * len(near), float(-wz * sum(m_now[i] - m_now[j] for j in near))))
            extra += [([q * unknown + i], [scale * s.damping], 0.0) for i in range(unknown)]
        else:
            # Smoothing acts on the whole deviation, damping on the step.
            make = regular.laplacian_rows if s.regularisation == "laplacian" else regular.gradient_rows
            lap = make(spark, grid, s.smoothing, s.vertical_smoothing)
            place = np.arange(grid.nodes) if cell is None else cell
            model = spark.createDataFrame(pd.DataFrame({"node": np.arange(grid.nodes, dtype=np.int32), "cell": place.astype(np.int32), "x": m_now}))
            if s.regularisation in ("variation", "edges"):
                # Rows with large differences in the present model weigh less, so that edges stay.
                y = lap.join(model, "node").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("y")).toPandas()  # three rows a node at most
                y["w"] = regular.reweight(y["y"].to_numpy(), s.edge_scale, s.regularisation == "edges")
                lap = lap.join(spark.createDataFrame(y[["row", "w"]]), "row").select("row", "node", (F.col("value") * F.col("w")).alias("value"))
            # On cells the rows of nodes are added up by cell, and those inside one cell vanish.
            lap = lap.join(model, "node").groupBy("row", "cell").agg(F.sum("value").alias("value"), F.sum(-F.col("value") * F.col("x")).alias("y"))
            lap = lap.groupBy("row").agg(F.collect_list((F.col("cell") + q * unknown).cast("int")).alias("columns"), F.collect_list("value").alias("values"), F.sum("y").alias("rhs"))
            tables.append(lap.select("columns", "values", "rhs"))
            damp = spark.createDataFrame(pd.DataFrame({"c": (np.arange(unknown) + q * unknown).astype(np.int32), "v": s.damping * np.sqrt(np.bincount(place, minlength=unknown))}))
            tables.append(damp.select(F.array("c").alias("columns"), F.array("v").alias("values"), F.lit(0.0).alias("rhs")))
    if s.station_terms:
        extra += [([base_st + i], [float(s.damping_station)], 0.0) for i in range(len(st))]
        for p in phases:
            i = np.flatnonzero(st["phase"].to_numpy() == p)
            extra.append(((base_st + i).tolist(), [10.0] * len(i), float(-10.0 * st["term"].to_numpy()[i].sum())))
    return extra, tables


def _difference_rows(ok: DataFrame, pairs: DataFrame, columns: dict, cell, ratio: bool, unknown: int, base_ev: int, s: Settings) -> DataFrame:
    """A row for each difference of two events' residuals at a station and phase: the one's kernel and hypocentre less the other's."""
    d = double_differences(pairs, ok, residual="residual", max_separation_km=s.max_separation_km, cutoff_s=s.cutoff_s)
    k = ok.select("event", "station", "phase", "nodes", "km", "ge", "gn", "gd", "column")
    side = lambda x: k.withColumnsRenamed({"event": x, **{c: f"{c}_{x}" for c in ("nodes", "km", "ge", "gn", "gd", "column")}})
    j = d.join(side("a"), ["a", "station", "phase"]).join(side("b"), ["b", "station", "phase"])

    def rows(batches):
        for b in batches:
            cols, vals = [], []
            for r in b.to_dict("records"):
                first, slow = columns[r["phase"]]
                c, x = [], []
                for e, sign in (("a", 1.0), ("b", -1.0)):
                    nodes = np.asarray(r[f"nodes_{e}"], np.int64)
                    at, v = (nodes if cell is None else cell[nodes]) + first, sign * np.asarray(r[f"km_{e}"], float) * slow[nodes]
                    c += [at - unknown, at] if ratio and r["phase"] == "S" else [at]
                    x += [v, v] if ratio and r["phase"] == "S" else [v]
                    c.append(base_ev + 4 * r[f"column_{e}"] + np.arange(4))
                    x.append(sign * np.array([1.0, r[f"ge_{e}"], r[f"gn_{e}"], r[f"gd_{e}"]]))
                w = s.double_difference_weight * r["weight"]
                cols.append(np.concatenate(c).astype(np.int32)), vals.append(w * np.concatenate(x))
            yield pd.DataFrame({"columns": cols, "values": vals, "rhs": s.double_difference_weight * b["weight"] * b["dd"]})

    return j.mapInPandas(rows, "columns array<int>, values array<double>, rhs double")


#: Unknowns of a model whose normal equations are made in tasks.
SMALL = 400


def _add(parts: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Sums of array columns over rows: within tasks first, then within a root of their number, so the driver gets few rows however many there are."""
    fields = ", ".join(f"{c} array<double>" for c in columns)

    def run(batches):
        total = None
        for b in batches:
            for row in zip(*[b[c] for c in columns]):
                total = [np.array(x, float) for x in row] if total is None else [t + x for t, x in zip(total, row)]
        if total is not None:
            yield pd.DataFrame({c: [t] for c, t in zip(columns, total)})

    few = max(1, int(shuffle_partitions(parts.sparkSession) ** 0.5))
    rows = parts.select(*columns).mapInPandas(run, fields).repartition(few).mapInPandas(run, fields).collect()
    return [sum(np.array(r[c]) for r in rows) for c in columns]


def _eliminated(ok: DataFrame, used: int, n: int, base_ev: int, base_st: int, phases, short, events: int, extra, s: Settings, scratch: Scratch, formal: dict | None = None, *, slot_rows: int = 20_000) -> np.ndarray:
    """The same solution as that of all rows: tasks eliminate each event's four unknowns and add up the normal equations of the model; the
    driver solves those, and tasks solve the hypocentres for it. One pass over the rows, in slots of events of about `slot_rows` rows."""
    width = base_ev + n - base_st
    unknown = len(short[phases[0]])

    def eliminate(d: pd.DataFrame) -> pd.DataFrame:
        """A row an event (column, z = H^-1 C, y = H^-1 g), and one row with the slot's part of the model's normal equations."""
        d = d.sort_values(["column", "station", "phase"])
        big, right, out = np.zeros((width, width)), np.zeros(width), []
        cuts = np.flatnonzero(np.diff(d["column"].to_numpy(), prepend=-1))
        for part in np.array_split(cuts, max(1, len(d) // 4000)):
            if not len(part):
                continue
            after = np.searchsorted(cuts, part[-1], "right")
            e = d.iloc[part[0] : cuts[after] if after < len(cuts) else len(d)]
            w = 1 / np.maximum(0.01, e["sigma_s"].to_numpy(float))
            a = np.zeros((len(e), width))
            row = np.repeat(np.arange(len(e)), e["nodes"].map(len).to_numpy())
            node, km = np.concatenate(e["nodes"].to_list()).astype(np.int64), np.concatenate(e["km"].to_list())
            for q, ph in enumerate(phases):
                k = (e["phase"] == ph).to_numpy()[row]
                a[row[k], node[k] + q * unknown] = km[k] * short[ph][node[k]]
                if s.ratio and len(phases) == 2 and ph == "S":
                    a[row[k], node[k]] = km[k] * short[ph][node[k]]
            if s.station_terms:
                a[np.arange(len(e)), base_ev + e["st_column"].to_numpy()] = 1.0
            a *= w[:, None]
            h = np.column_stack([np.ones(len(e)), e[["ge", "gn", "gd"]].to_numpy(float)]) * w[:, None]
            y = e["residual"].to_numpy(float) * w
            at = part - part[0]
            hh = np.add.reduceat(h[:, :, None] * h[:, None, :], at, 0) + s.damping_hypocentre**2 * np.eye(4)
            c, g = np.add.reduceat(h[:, :, None] * a[:, None, :], at, 0), np.add.reduceat(h * y[:, None], at, 0)
            z, own = np.linalg.solve(hh, c), np.linalg.solve(hh, g[..., None])[..., 0]
            big += a.T @ a - np.einsum("eik,eil->kl", c, z)
            right += a.T @ y - np.einsum("eik,ei->k", z, g)
            out.append(pd.DataFrame({"column": e["column"].to_numpy()[at], "z": list(z.reshape(len(at), -1)), "y": list(own), "big": None, "right": None}))
        return pd.concat([*out, pd.DataFrame({"column": [-1], "z": [None], "y": [None], "big": [big.ravel()], "right": [right]})])

    slots = max(shuffle_partitions(ok.sparkSession), -(-used // slot_rows))
    rows = ok.select("phase", "nodes", "km", "ge", "gn", "gd", "column", "st_column", "station", "sigma_s", "residual").withColumn("slot", F.pmod(F.xxhash64("column"), F.lit(slots)))
    done = scratch.keep(rows.repartition(slots, "slot").groupBy("slot").applyInPandas(eliminate, "column long, z array<double>, y array<double>, big array<double>, right array<double>"))
    big, right = _add(done.where("column < 0"), ["big", "right"])
    big = big.reshape(width, width)
    data = big.copy()
    place = lambda c: np.array([k if k < base_ev else base_ev + k - base_st for k in c])
    for c, v, y in extra:
        c, v = place(c), np.array(v)
        big[np.ix_(c, c)] += np.outer(v, v)
        right[c] += v * y
    x = np.linalg.solve(big, right)
    if formal is not None:
        formal["model"] = _formal(big, data)

    def back(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"column": b["column"], "h": [y - z.reshape(4, width) @ x for z, y in zip(b["z"], b["y"])]})

    got = done.where("column >= 0").select("column", "z", "y").mapInPandas(back, "column long, h array<double>").toPandas()  # one row an event
    scratch.drop(done)
    full = np.zeros(n)
    full[:base_ev] = x[:base_ev]
    h = np.zeros((events, 4))
    if len(got):
        h[got["column"].to_numpy()] = np.stack(got["h"].to_numpy())
    full[base_ev:base_st] = h.ravel()
    full[base_st:] = x[base_ev:]
    return full


def _moved(old, x: np.ndarray, share: float, grid: Grid, phases, s: Settings, unknown: int, mesh: Mesh | None = None):
    """The state after a share of a step: slowness changes are capped, velocities stay in their bounds, hypocentres in the grid."""
    v, ev, st = {p: old[0][p].copy() for p in phases}, old[1].copy(), old[2].copy()
    for q, p in enumerate(phases):
        d = x[q * unknown : (q + 1) * unknown] * share
        if s.ratio and p == "S" and len(phases) == 2:
            d = d + x[:unknown] * share
        d = np.repeat(d, grid.nx * grid.ny) if s.layered else d if mesh is None else to_nodes(mesh, d)
        v[p] = np.clip(v[p] / (1 + np.clip(d, -s.max_step, s.max_step)), *(s.vp if p == "P" else s.vs))
    at = unknown * len(phases)
    if s.joint_hypocentres:
        h = x[at : at + 4 * len(ev)].reshape(-1, 4) * share
        at += 4 * len(ev)
        r = EARTH_KM - ev["depth_km"].to_numpy()
        lat = ev["ev_lat"].to_numpy()
        ev["t0"] += h[:, 0]
        ev["ev_lon"] = np.clip(ev["ev_lon"] + np.degrees(h[:, 1] / (r * np.cos(np.radians(lat)))), grid.min_lon, grid.max_lon)
        ev["ev_lat"] = np.clip(lat + np.degrees(h[:, 2] / r), grid.min_lat, grid.max_lat)
        ev["depth_km"] = np.clip(ev["depth_km"] + h[:, 3], grid.min_depth, grid.max_depth)
    if s.station_terms:
        st["term"] += x[at : at + len(st)] * share
    return v, ev, st


def select_observations(picks: DataFrame, grid: Grid, *, min_phases: int = 4, outside: str = "exclude") -> DataFrame:
    """Best usable picks of stations and events inside the grid (with outside='include' also those whose straight ray comes inside it), of
    events with enough phases; renumbered."""
    inside = grid.contains(F.col("ev_lon"), F.col("ev_lat"), F.col("depth_km")) & grid.contains(F.col("st_lon"), F.col("st_lat"), -F.col("elevation_m") / 1000)
    ends = to_cartesian("ev_lon", "ev_lat", "depth_km"), to_cartesian("st_lon", "st_lat", F.greatest(-F.col("elevation_m") / 1000, F.lit(grid.min_depth)))
    p = picks.where(inside if outside == "exclude" else chord_crosses(grid, *ends))
    return p.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("event"))).where(F.col("_n") >= min_phases).drop("_n")


def curve_corner(residual, model) -> int:
    """The most regularised of the points farthest from the chord of the normalised log-log curve."""
    x, y = (np.log(np.maximum(1e-300, np.asarray(v, float))) for v in (residual, model))
    if len(x) < 3:
        return len(x) - 1
    x, y = ((v - v.min()) / (np.ptp(v) or 1.0) for v in (x, y))
    a, b = np.array([x[0], y[0]]), np.array([x[-1], y[-1]])
    chord = np.linalg.norm(b - a)
    if chord == 0:
        return len(x) - 1
    d = np.abs((b[0] - a[0]) * (a[1] - y) - (a[0] - x) * (b[1] - a[1])) / chord
    return int(np.flatnonzero(d >= d.max() - 1e-12)[-1])


def checkerboard(grid: Grid, cell_km: float, cell_depth_km: float, percent: float) -> np.ndarray:
    """Relative perturbation of each node: products of sines of the distances from the western and southern edges, and of depth from half
    a cell above the top."""
    x, y, z = grid.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    half = np.radians(xx - grid.min_lon) / 2
    ex = 2 * EARTH_KM * np.arcsin(np.cos(np.radians(yy)) * np.sin(half))
    ny = np.radians(yy - grid.min_lat) * EARTH_KM
    return percent / 100 * np.sin(np.pi * ex / cell_km) * np.sin(np.pi * ny / cell_km) * np.sin(np.pi * (zz - grid.min_depth + 0.5 * cell_depth_km) / cell_depth_km)


def bodies(grid: Grid, plates: list[dict]) -> np.ndarray:
    """Tabular bodies: dicts with lon, lat, depth_km, strike, dip, length_km, width_km, thickness_km and percent."""
    x, y, z = grid.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    total = np.zeros(zz.shape)
    for b in plates:
        s, d, km = np.radians(b["strike"]), np.radians(b["dip"]), np.radians(1) * EARTH_KM
        east, north, down = (xx - b["lon"]) * km * np.cos(np.radians(b["lat"])), (yy - b["lat"]) * km, zz - b["depth_km"]
        across = east * np.cos(s) - north * np.sin(s)
        sides = ((east * np.sin(s) + north * np.cos(s), b["length_km"]), (across * np.cos(d) + down * np.sin(d), b["width_km"]), (down * np.cos(d) - across * np.sin(d), b["thickness_km"]))
        total += b["percent"] / 100 * np.exp(-np.log(2) * sum((np.abs(u) / (0.5 * size)) ** 6 for u, size in sides))
    return total


def spikes(grid: Grid, centres: list[tuple[float, float, float]], radius_km: float, percent: float) -> np.ndarray:
    """Gaussian bodies around points."""
    from quakespark.plans.forward import cartesian

    x, y, z = grid.axes()
    zz, yy, xx = np.meshgrid(z, y, x, indexing="ij")
    p = cartesian(xx, yy, zz)
    return percent / 100 * sum(np.exp(-((p - cartesian(*c)) ** 2).sum(-1) / (2 * radius_km**2)) for c in centres)


def resolution_test(spark: SparkSession, arrivals: DataFrame, grid: Grid, velocity: dict[str, np.ndarray], pattern: np.ndarray, settings: Settings, *, phase: str = "P", ratio: bool = False, noise: dict[str, float] | None = None, seed: int = 1) -> dict:
    """Recovery of a pattern: times of the perturbed model with noise are inverted from the unperturbed one; correlation over sampled nodes.

    The pattern perturbs the velocity of `phase`, or with `ratio` Vp/Vs (Vs falls where it rises), which is then what is compared.
    """
    if ratio:
        phase, pattern = "S", 1 / (1 + pattern) - 1
    truth = {p: np.asarray(v, float).ravel() * (1 + pattern.ravel() if p == phase else 1.0) for p, v in velocity.items()}
    a = arrivals.withColumn("arrival", F.monotonically_increasing_id())
    k = Scratch(spark, "pattern").keep(kernel_rows(a, grid, {p: 1 / v for p, v in truth.items()}, straight=settings.straight))
    sigma = noise or {"P": 0.03, "S": 0.06}
    size = F.when(F.col("phase") == "P", sigma["P"]).otherwise(sigma["S"])
    # Noise by hash, so that it does not depend on partitions: Box-Muller of two hashes.
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed * 7919 + salt), "event", "station", "phase"), F.lit(1_000_003)) + 0.5) / 1_000_003
    t = k.select("event", "station", "phase", (F.col("t_calc") + size * F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * np.pi * u(2))).alias("time_s"))
    out = invert(spark, arrivals.drop("time_s").join(t, ["event", "station", "phase"]), grid, velocity, settings)
    hit = k.where(F.col("phase") == phase).select(F.explode("nodes").alias("node")).groupBy("node").count().toPandas()
    seen = hit["node"].to_numpy()[hit["count"] >= max(1, np.median(hit["count"]))]
    got = (out.velocity[phase].ravel() / np.asarray(velocity[phase], float).ravel() - 1)[seen]
    return {"recovered": out.velocity[phase], "correlation": float(np.corrcoef(got, pattern.ravel()[seen])[0, 1]), "nodes": len(seen), "history": out.history}
