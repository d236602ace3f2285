"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the component's smallest node.

    Each round points every node at the smallest node among itself and its neighbours, follows that
    pointer once more, and merges nodes that point alike; links shrink until none is left. All steps
    are aggregations with a map-side part and joins that Spark can split, so a node with very many
    links is no single group, and every round is a written table.
    """
    links = stage(links.where("a <> b").distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "nearest")
        step = nearest.alias("x").join(nearest.alias("y"), F.col("x.p") == F.col("y.a"))
        step = stage(step.select(F.col("x.a").alias("node"), F.col("y.p").alias("to")), "step")
        if found is None:
            found = step.select("node", F.col("to").alias("root"))
        else:
            moved = found.join(step.withColumnRenamed("node", "root"), "root", "left")
            found = stage(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
        left = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        right = left.join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        links = stage(right.select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
