"""Connected components by repeated contraction towards the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liame.plans.lineage import cut, release


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every row of ``nodes`` (node); component is the smallest node of it.

    ``edges`` has (a, b), in either direction, repeated or not; edges to
    strangers of ``nodes`` and edges with a null join nothing. Each round every
    vertex goes to its smallest neighbour if that is smaller, that one's choice
    is followed twice, and the edges between what is left are the next round's
    graph; it shrinks by a constant factor in expectation, so the rounds grow
    with the logarithm of the graph. Edges and labels lie in checkpoint files,
    so an executor's loss costs one round; a round removes those of the one before.
    """
    labels = nodes.where("node is not null").select("node").distinct().withColumn("component", F.col("node"))
    known = labels.select("node")
    edges = edges.where("a <> b").join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")
    edges = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(labels)
    while not edges.isEmpty():
        to = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        for _ in range(2):
            ahead = to.select(F.col("v").alias("p"), F.col("p").alias("q"))
            to = to.join(ahead, "p").select("v", F.col("q").alias("p"))
        to = cut(to)
        followed = cut(labels.join(to, labels["component"] == to["v"], "left").select("node", F.coalesce("p", "component").alias("component")))
        a, b = to.select(F.col("v").alias("a"), F.col("p").alias("x")), to.select(F.col("v").alias("b"), F.col("p").alias("y"))
        left = cut(edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        for done in (to, labels, edges):
            release(done)
        labels, edges = followed, left
    release(edges)
    return labels
