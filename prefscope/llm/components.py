"""Connected components by label passing with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscope.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node
    that can be reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014)
    until each node hangs on its component's smallest. In a round a node's
    larger neighbours are linked to its smallest one, so a node with very many
    neighbours only passes rows on; a round's edges are written to the shared
    folder. The number of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        summary = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s")).first()
        if summary["n"] == 0 or summary == before:
            break
        before = summary
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(nearest, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            nearest.select("a", F.col("m").alias("b")))
        now = written(small.where("a != b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tree = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return tree.unionByName(roots.join(tree.select("node"), "node", "left_anti"))

