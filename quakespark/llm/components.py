"""Consolidating pairwise matches into groups: connected components by deterministic Borůvka hooking.

Edges are distinct pairs of component labels. In a round every component selects its smallest outgoing edge (by the smaller, then
the larger label), which is the edge to its smallest neighbour; that gives trees whose only cycle is one mutual choice, whose smaller
end becomes the root. Trees collapse by pointer doubling, edges are relabelled, loops dropped and copies removed, until no edge is
left. Each component at least doubles in a round, so there are at most log2(n) rounds. The root is always the smallest label of its
tree: edges along a path to the root only get smaller, so the last label of a component is its smallest record.

Scale. All state is DataFrames of two columns, written to the shared folder between rounds; only counts reach the driver. A hub with
very many pairs meets map-side aggregation when choosing; relabelling joins a table with unique keys, where AQE splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakespark.common import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("v"), F.col("w").alias("n")).unionAll(edges.select(F.col("w").alias("v"), F.col("u").alias("n")))


def _relabel(edges: DataFrame, parent: DataFrame) -> DataFrame:
    """Edges between parents, without loops and copies. Labels without a parent keep themselves."""
    p = parent.select(F.col("v").alias("u"), F.col("p").alias("pu"))
    q = parent.select(F.col("v").alias("w"), F.col("p").alias("pw"))
    e = edges.join(p, "u", "left").join(q, "w", "left")
    a, b = F.coalesce("pu", "u"), F.coalesce("pw", "w")
    return e.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")).distinct()


def connected_groups(pairs: DataFrame, a: str, b: str, *, id_column: str = "record_id", group_column: str = "group_id", max_rounds: int = 64) -> DataFrame:
    """One row for every record in a pair: the record and the smallest record (byte order) linked to it directly or indirectly.

    Pairs with a null end or equal ends link nothing and, alone, give no row. Repeated and reversed pairs count once. Values are
    compared as they are (trim or fold case before). An empty table gives an empty result; other columns are ignored. Both
    columns must have one type, of any type with an order.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    x, y = F.col(a), F.col(b)
    edges = scratch.keep(pairs.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("w")).distinct())
    labels = None
    for _ in range(max_rounds):
        chosen = scratch.keep(_both_ways(edges).groupBy("v").agg(F.min("n").alias("n")))
        # Hook: to the smallest neighbour, but the smaller end of a mutual choice stays as the root.
        back = chosen.select(F.col("v").alias("n"), F.col("n").alias("nn"))
        parent = scratch.keep(
            chosen.join(back, "n").select("v", F.when((F.col("nn") == F.col("v")) & (F.col("v") < F.col("n")), F.col("v")).otherwise(F.col("n")).alias("p"))
        )
        while True:  # pointer doubling; a tree of depth d takes log2(d) turns
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            doubled = scratch.keep(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            moved = doubled.where("moved").limit(1).count()
            scratch.drop(parent)
            parent = doubled.select("v", "p")
            parent._scratch_path = doubled._scratch_path
            if not moved:
                break
        if labels is None:
            new_labels = scratch.keep(parent.select(F.col("v").alias("record"), F.col("p").alias("label")))
        else:
            new_labels = scratch.keep(
                labels.join(parent.select(F.col("v").alias("label"), "p"), "label", "left").select("record", F.coalesce("p", "label").alias("label"))
            )
            scratch.drop(labels)
        labels = new_labels
        fewer = scratch.keep(_relabel(edges, parent))
        scratch.drop(edges)
        scratch.drop(parent)
        edges = fewer
        scratch.drop(chosen)
        if not edges.limit(1).count():
            break
    else:
        raise RuntimeError("components did not close; raise max_rounds")
    return labels.select(F.col("record").alias(id_column), F.col("label").alias(group_column))
