"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Each round is two groupings and joins of the edge table; the edges are staged in the shared folder after each round,
so plans stay short and a lost executor costs a re-read. Nothing but two sums reaches the driver. A hub's edges are
never gathered in one task: minima are pre-aggregated and joined back, and Spark splits a skewed side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v. Each node's links move to the least node among itself and its neighbours."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node long, root long) for each node of edges (u long, v long); root: the component's least node.

    Null ends and loops are ignored, repeated edges and either direction allowed. Nodes without an edge don't appear.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v and u is not null and v is not null").distinct()
    edges = stage(edges, "edges")
    before = None
    for _ in range(rounds):
        old, edges = edges, stage(_star(_star(edges, True), False), "edges")
        unstage(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    # Settled edges lead from each node straight to its root.
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
