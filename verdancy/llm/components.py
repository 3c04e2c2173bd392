"""Connected components of an edge table by minimum labels with pointer jumping, each round cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdancy.llm.storage import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """For undirected edges (a, b), every node that occurs, with the smallest node it reaches: (node, component).

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label; rounds
    end when nothing changes. Partial sums run before each shuffle, so a hub is no single task.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("root"))
        after = stored(hooked.join(jump, "label", "left").select("node", F.least("label", F.coalesce("root", "label")).alias("component"), "was"))
        changed = after.where("component <> was").limit(1).count()
        dropped(labels)
        labels = after
        if not changed:
            dropped(both)
            return after.select("node", "component")
