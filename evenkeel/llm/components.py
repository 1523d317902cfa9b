"""Connected components of an edge table, by the smallest label in reach with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of equal type, in any order, repeats and loops allowed. Gives (node, component), component the smallest node in reach.

    Each pass takes the smallest label among neighbours (a sum that is made before the shuffle, so a
    node with very many edges is no burden) and then the label of that label. Passes grow with the
    logarithm of the longest shortest path. An empty table gives no rows.
    """
    u, v = edges.columns
    edges = edges.select(F.col(u).alias("x"), F.col(v).alias("y"))
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        least = labels.select("node", F.col("component").alias("old")).join(near, "node").select("node", "old", F.least("old", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        out = least.join(jump, "c", "left").select("node", F.least("c", F.coalesce("up", "c")).alias("component"), F.expr("least(c, coalesce(up, c)) <> old").alias("moved"))
        before, labels = labels, materialise(out, "labels")
        discard(before)
    return labels.select("node", "component")
