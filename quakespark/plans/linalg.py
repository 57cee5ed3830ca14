"""Sparse least squares: LSQR for systems that fit the driver (their size is checked), and a distributed solver beyond that."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that the driver takes; 16 bytes each.
DRIVER_ENTRIES = 20_000_000


@dataclass
class Csr:
    """Rows of a sparse matrix. Equal columns in a row are added when built."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int

    @classmethod
    def build(cls, rows, columns, values, m: int, n: int) -> Csr:
        rows, columns, values = np.asarray(rows, np.int64), np.asarray(columns, np.int64), np.asarray(values, float)
        code, inverse = np.unique(rows * n + columns, return_inverse=True)
        v = np.bincount(inverse, values, len(code))
        keep = v != 0
        code, v = code[keep], v[keep]
        start = np.searchsorted(code, np.arange(m + 1) * n)
        return cls(start, code % n, v, n)

    @property
    def m(self) -> int:
        return len(self.start) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.m), np.diff(self.start))

    def dot(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows(), self.value * x[self.column], self.m)

    def t_dot(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * y[self.rows()], self.n)

    def transposed(self) -> Csr:
        return Csr.build(self.column, self.rows(), self.value, self.n, self.m)

    def column_sums(self) -> np.ndarray:
        return np.bincount(self.column, np.abs(self.value), self.n)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.m, self.n))
        out[self.rows(), self.column] = self.value
        return out


def lsqr(a: Csr, b: np.ndarray, damp: float = 0.0, *, atol: float = 1e-6, btol: float = 1e-6, conlim: float = 1e8, max_turns: int = 400) -> tuple[np.ndarray, dict]:
    """Damped least squares by Golub-Kahan bidiagonalisation (Paige and Saunders 1982). Returns (x, report with the reason to stop)."""
    rows = a.rows()
    dot = lambda x: np.bincount(rows, a.value * x[a.column], a.m)
    t_dot = lambda y: np.bincount(a.column, a.value * y[rows], a.n)
    x = np.zeros(a.n)
    u = np.asarray(b, float).copy()
    beta = float(np.linalg.norm(u))
    if beta == 0:
        return x, {"reason": "zero right side", "turns": 0}
    u /= beta
    v = t_dot(u)
    alpha = float(np.linalg.norm(v))
    if alpha == 0:
        return x, {"reason": "right side is orthogonal", "turns": 0}
    v /= alpha
    w = v.copy()
    phi, rho, norm_b = beta, alpha, beta
    norm_a = cond_sum = x_norm = z = res2 = 0.0
    cs2, sn2 = -1.0, 0.0
    reason, k = "turns", 0
    for k in range(1, max_turns + 1):
        u = dot(v) - alpha * u
        beta = float(np.linalg.norm(u))
        if beta > 0:
            u /= beta
            norm_a = float(np.sqrt(norm_a**2 + alpha**2 + beta**2 + damp**2))
            v = t_dot(u) - beta * v
            alpha = float(np.linalg.norm(v))
            if alpha > 0:
                v /= alpha
        r1 = float(np.hypot(rho, damp))
        psi = damp / r1 * phi
        phi = rho / r1 * phi
        r = float(np.hypot(r1, beta))
        c, s = r1 / r, beta / r
        theta = s * alpha
        rho, phi_k, phi = -c * alpha, c * phi, s * phi
        x += phi_k / r * w
        cond_sum += float(w @ w) / r**2
        w = v - theta / r * w
        delta, gbar = sn2 * r, -cs2 * r
        rhs = phi_k - delta * z
        zbar = rhs / gbar if gbar else 0.0
        x_norm2 = x_norm + zbar**2
        gamma = float(np.hypot(gbar, theta))
        cs2, sn2 = (gbar / gamma, theta / gamma) if gamma else (1.0, 0.0)
        z = rhs / gamma if gamma else 0.0
        x_norm += z * z
        res2 += psi * psi
        r_norm = float(np.sqrt(phi**2 + res2))
        ar_norm = alpha * abs(s * phi_k)
        cond = norm_a * float(np.sqrt(cond_sum))
        if r_norm / norm_b <= btol + atol * norm_a * float(np.sqrt(x_norm2)) / norm_b:
            reason = "residual"
            break
        if rho == 0 or alpha == 0 or (norm_a * r_norm > 0 and ar_norm / (norm_a * r_norm) <= atol):
            reason = "least squares"
            break
        if cond >= conlim:
            reason = "condition"
            break
    return x, {"reason": reason, "turns": k}


def solve_rows(rows: DataFrame, n: int, damp: float = 0.0, *, tolerance: float = 1e-6, max_turns: int = 400, driver_entries: int = DRIVER_ENTRIES) -> tuple[np.ndarray, dict]:
    """Damped least squares of (columns array<int>, values array<double>, rhs double), one row an equation.

    The entries are counted first. Up to `driver_entries` they are solved by LSQR on the driver; beyond it by conjugate gradients on
    the normal equations, where a turn is one narrow pass that returns the product with A'A, of the model's size. `rows` should be a
    stored table, as it is read once a turn.
    """
    size = rows.agg(F.sum(F.size("columns")).alias("e"), F.count(F.lit(1)).alias("m")).first()
    if (size["e"] or 0) <= driver_entries:
        t = rows.toArrow()
        count = np.array(pa.compute.list_value_length(t["columns"]).to_pylist())
        col = np.array(t["columns"].combine_chunks().flatten())
        val = np.array(t["values"].combine_chunks().flatten())
        a = Csr.build(np.repeat(np.arange(t.num_rows), count), col, val, t.num_rows, n)
        return lsqr(a, np.array(t["rhs"]), damp, atol=tolerance, btol=tolerance, max_turns=max_turns)

    def product(p: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """A'A p, or of None A'b and the sums of squares of the columns."""

        def run(batches):
            total, squares = np.zeros(n), np.zeros(n)
            for b in batches:
                count = np.diff(b.column(0).offsets.to_numpy())
                c, v = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
                r = np.repeat(np.arange(b.num_rows), count)
                if p is None:
                    squares += np.bincount(c, v * v, n)
                y = b.column(2).to_numpy() if p is None else np.bincount(r, v * p[c], b.num_rows)
                total += np.bincount(c, v * y[r], n)
            at = np.flatnonzero((total != 0) | (squares != 0))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(squares[at])], names=["c", "v", "q"])

        got = rows.select("columns", "values", "rhs").mapInArrow(run, "c int, v double, q double").groupBy("c").agg(F.sum("v").alias("v"), F.sum("q").alias("q")).toArrow()
        at, out, squares = np.array(got["c"], dtype=np.int64), np.zeros(n), np.zeros(n)
        out[at], squares[at] = np.array(got["v"]), np.array(got["q"])
        return out, squares

    # Scaled to columns of one length, which takes the spread of their sizes out of the condition.
    s, squares = product(None)
    scale = 1 / np.sqrt(np.maximum(squares + damp * damp, 1e-300))
    x, s = np.zeros(n), s * scale
    p, first = s.copy(), float(np.linalg.norm(s))
    k, reason = 0, "zero right side"
    while first > 0 and k < max_turns:
        k += 1
        q = scale * (product(scale * p)[0] + damp * damp * scale * p)
        g = float(s @ s)
        a = g / float(p @ q)
        x += a * p
        s = s - a * q
        reason = "normal equations" if float(np.linalg.norm(s)) <= tolerance * first else "turns"
        if reason != "turns":
            break
        p = s + float(s @ s) / g * p
    return scale * x, {"reason": reason, "turns": k}


def resolution_diagonal(solve, dot, n: int, probes: int = 20, seed: int = 1) -> np.ndarray:
    """Estimate of the diagonal of the resolution matrix from random signs: `solve` inverts data, `dot` makes data of a model."""
    rng = np.random.default_rng(seed)
    total = np.zeros(n)
    for _ in range(probes):
        z = rng.choice([-1.0, 1.0], n)
        total += z * solve(dot(z))
    return total / probes


def formal_resolution(a: Csr, damp_rows: Csr, *, max_unknowns: int = 20_000) -> dict[str, np.ndarray]:
    """Exact diagonal of the resolution matrix and standard errors of a regularised system, by a dense factor (its size is checked)."""
    if a.n > max_unknowns:
        raise ValueError(f"{a.n} unknowns; formal resolution takes {max_unknowns}")
    g = a.dense()
    ata = g.T @ g
    l = damp_rows.dense()  # noqa: E741
    inv = np.linalg.inv(ata + l.T @ l)
    r = inv @ ata
    return {"resolution": np.diag(r).copy(), "sigma": np.sqrt(np.maximum(0.0, np.diag(inv @ ata @ inv))), "spread": np.sqrt((r**2).sum(1) - np.diag(r) ** 2)}
