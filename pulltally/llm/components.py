"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulltally.llm.scratch import Scratch


def _minima(arcs: DataFrame) -> DataFrame:
    """Each node's smallest neighbour; counts combine before the shuffle, so hubs do no harm."""
    return arcs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    arcs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(arcs).select("node", F.least("node", "least").alias("m"))
    return (
        arcs.where("v > u").join(least, F.col("u") == F.col("node"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Edges come as (larger u, smaller v)."""
    least = _minima(edges).select("node", F.col("least").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (u, v): component is the smallest node reachable.

    Edges with a null end and loops are left out; repeated edges count once. Rounds go on until
    the edges are stars around their smallest nodes; each round is written to the shared folder.
    No neighbourhood is ever gathered: a round is two aggregations and two joins.
    """
    edges = edges.where("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    edges, step = scratch.save(edges, f"{name}-0"), 0
    while True:
        step += 1
        edges = scratch.save(_small_star(_large_star(edges)), f"{name}-{step}")
        # Stars: no node is both the larger end of one edge and the smaller end of another, nor the larger end twice.
        state = edges.groupBy("u").agg(F.count("*").alias("n")).agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("twice")).first()
        if not state["twice"] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
