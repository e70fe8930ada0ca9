"""Connected components of a large graph, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm._tables import materialize


def _linked_to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs: (node, component), component the least node that can
    be reached, for every node of an edge to another node.

    Each half-round sends a node's neighbours to its least neighbour: a minimum with
    partial sums and one join on the node, so a node with many edges is no group of one
    task.  The rounds end when the edges are stars: no node has two smaller neighbours,
    or a smaller and a larger one."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        ends = now.select("u", F.lit(1).alias("n")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
        if ends.groupBy("u").agg(F.count("n").alias("all"), F.sum("n").alias("low")).filter("low > 1 OR (low = 1 AND all > 1)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        # large star: a node's larger neighbours go to the least of it and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _linked_to_least(both.filter("v > u"), least).distinct()
        # small star: a node and its smaller neighbours go to the least of those
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = materialize(down.distinct(), "edges")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _linked_to_least(down, least).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
