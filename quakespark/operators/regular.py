"""Regularisation rows on a grid, as tables of (row, node, value): generated, never joined with data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.functions.grid import Grid


def laplacian_weights(grid: Grid, vertical: float = 0.1) -> tuple[float, float, float]:
    """Weights of differences along longitude, latitude and depth, relative to the mean horizontal spacing."""
    hx, hy, hz = grid.spacing_km
    h = (hx * hy) ** 0.5
    return (h / hx) ** 2, (h / hy) ** 2, vertical * (h / hz) ** 2


def laplacian_rows(spark: SparkSession, grid: Grid, strength: float, vertical: float = 0.1) -> DataFrame:
    """(row, node, value): for each node, strength x sum of w (x_node - x_neighbour) over its neighbours along the axes."""
    w = laplacian_weights(grid, vertical)
    n = grid.node_table(spark).select("node", "i", "j", "k")
    steps = []
    for a, (c, size, stride) in enumerate((("i", grid.nx, 1), ("j", grid.ny, grid.nx), ("k", grid.nz, grid.nx * grid.ny))):
        for s in (-1, 1):
            inside = F.col(c) > 0 if s < 0 else F.col(c) < size - 1
            steps.append(F.when(inside, F.struct((F.col("node") + s * stride).alias("to"), F.lit(strength * w[a]).alias("w"))))
    e = n.select("node", F.explode(F.array_compact(F.array(*steps))).alias("e")).select(F.col("node").alias("row"), F.col("e.to").alias("to"), F.col("e.w").alias("w"))
    both = e.select("row", F.col("row").alias("node"), F.col("w").alias("value")).unionAll(e.select("row", F.col("to").alias("node"), (-F.col("w")).alias("value")))
    return both.groupBy("row", "node").agg(F.sum("value").alias("value"))


def damping_rows(spark: SparkSession, grid: Grid, strength: float) -> DataFrame:
    return spark.range(grid.nodes).select(F.col("id").cast("int").alias("row"), F.col("id").cast("int").alias("node"), F.lit(float(strength)).alias("value"))


def gradient_rows(spark: SparkSession, grid: Grid, strength: float, vertical: float = 0.1) -> DataFrame:
    """(row, node, value): one row a pair of neighbours."""
    w = [v**0.5 for v in laplacian_weights(grid, vertical)]
    n = grid.node_table(spark)
    parts = []
    for a, (c, size, stride) in enumerate((("i", grid.nx, 1), ("j", grid.ny, grid.nx), ("k", grid.nz, grid.nx * grid.ny))):
        p = n.where(F.col(c) < size - 1).select((F.col("node") * 3 + a).alias("row"), F.explode(F.array(F.struct(F.col("node").alias("node"), F.lit(-strength * w[a]).alias("value")), F.struct((F.col("node") + stride).alias("node"), F.lit(strength * w[a]).alias("value")))).alias("e"))
        parts.append(p.select("row", "e.node", "e.value"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def reweight(residuals: np.ndarray, scale: float = 1.0, edge: bool = False) -> np.ndarray:
    """Weights of a next pass that keep edges: total variation, or a redescending form. None (all 1) for fewer than 8 values."""
    r = np.abs(np.asarray(residuals, float))
    live = np.sort(r[r > 0])
    if len(live) < 8:
        return np.ones(len(r))
    eps = max(1e-12, max(0.01, scale) * 1.4826 * live[len(live) // 2])
    return 1 / np.sqrt(1 + (r / eps) ** 2) if edge else np.sqrt(eps / np.sqrt(r * r + eps * eps))


def row_norms(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One row: the norm of the rows' product with a model (node, x): its roughness or size."""
    p = rows.join(model, "node").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("y"))
    return p.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
