"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm._shared import staged


def _star(both: DataFrame, large: bool) -> DataFrame:
    """both: (u, v) edges to link from u's side. Links the neighbours to the smallest of u and them."""
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")), "star").select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        linked = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) edges to (node, component): the least node reachable. Nodes without an edge are left out.

    Each round's edges are written to the shared folder; the rounds grow with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = staged(edges, "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first())

    before = mark(edges)
    for _ in range(most_rounds if before[0] else 0):
        large = _star(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), large=True)
        large = staged(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large-star")
        edges = staged(_star(large, large=False), "small-star")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
