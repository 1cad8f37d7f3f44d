"""Connected components of an edge list, by alternating large-star and small-star steps.

The published two-step algorithm (Kiveris et al., "Connected Components in MapReduce and Beyond"):
every step keeps the components, and the graph becomes a set of stars around each component's
smallest node after a logarithmic number of steps. All steps are joins and aggregations; each round
is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge that is not a loop; root: the smallest node of its component.

    edges: two long columns (a, b) without nulls, in any direction, with repeats and loops as they come.
    No edges give no rows.
    """
    e = materialize(edges.select(F.col(edges.columns[0]).cast("long").alias("a"), F.col(edges.columns[1]).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(e)
    if mark[0]:
        for _ in range(max_rounds):
            e = materialize(_small_star(_large_star(e)), "stars")
            if (now := _mark(e)) == mark:
                break
            mark = now
        else:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
