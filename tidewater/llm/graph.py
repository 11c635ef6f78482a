"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b: links each node's neighbours to the least of them."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        pairs = pairs.union(pairs.select("v", "u"))
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = pairs.join(least, "u")
    moved = joined.where("v > u" if large else "v != low").select(F.col("v").alias("a"), F.col("low").alias("b"))
    if not large:
        moved = moved.union(least.select("u", "low"))
    return moved.where("a != b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node and component (the least node that edges lead to) of every node of edges (a, b).

    No node's neighbours are gathered; after each round the edges are written to the shared folder.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, label)
    before = None
    while True:
        print_of = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == print_of:
            break
        before = print_of
        edges = stored(_step(_step(edges, large=True), large=False), label)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b").distinct())
