"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thermogrid.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of edges a, b.

    A round gives each node the least label among its neighbours, then the label of that label, so long chains shrink by
    powers of two. Each round is written to the shared folder; only a count of changes comes to the driver.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        target = step.select(F.col("node").alias("at"), F.col("new").alias("further"))
        step = written(step.join(target, step.new == target.at).select("node", "old", F.least("new", "further").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels
