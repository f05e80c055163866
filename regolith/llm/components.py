"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; each node's smallest neighbour is aggregated first, so hubs are pre-combined."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = written(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = around.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return written(out.where(F.col("a") != F.col("b")).distinct(), "star")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) as longs -> (node, root) for every node with an edge to another; root: the smallest node.

    Self-loops are ignored; an empty edge table gives an empty result. The number of rounds grows with
    the logarithm of the largest component, and each round is written out, so lost executors cost a round.
    """
    edges = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    state = _state(edges)
    while state[0] and state != before:
        before = state
        edges = _star(_star(edges, True), False)
        state = _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
