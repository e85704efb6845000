"""Connected components by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is a node of the component.

    In each round every node hooks to the least of itself and its neighbours, and edges are
    renamed after the hooks and made distinct.  Nodes that still have an edge at least halve
    each round, so rounds grow with the logarithm of the largest component.  Rounds are
    written to the shared folder; only a count of edges reaches the driver.
    """
    edges = scratch.write(edges.select("a", "b").filter("a <> b").distinct())
    labels = scratch.write(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node")))
    while edges.head(1):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        hook = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        named = edges.join(hook, "a").select(F.col("m").alias("x"), "b").join(hook.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        old = (edges, labels)
        edges = scratch.write(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())
        labels = scratch.write(labels.join(hook.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("m", "comp").alias("comp")))
        scratch.drop(hook, *old)
    return labels
