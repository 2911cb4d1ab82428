"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (pre-aggregated on the map side) and an
equi-join back on the node, which adaptive execution splits when one node has
very many edges.  Every round is written to the shared folder, so the lineage
stays short and a lost executor is re-read, never re-run from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (a, b) names; root is the smallest node reachable.

    Null ends are dropped, a == b names an isolated node, repeated edges count once,
    an empty table gives an empty result.
    """
    edges = edges.where("a is not null and b is not null")
    state = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    alone = state.where("a = b").select("a", "b")
    state = state.where("a > b")
    mark = None
    while True:
        found = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not found["n"] or mark == tuple(found):
            break
        mark = tuple(found)
        state = materialise(_small_star(_large_star(state)), "star")
    stars = state.unionByName(alone)
    return (stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")))
            .groupBy("node").agg(F.min("root").alias("root")))
