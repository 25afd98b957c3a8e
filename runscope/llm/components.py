"""Connected components of a large graph: smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges (a, b)``; the label is the smallest node.

    Each round takes the smallest label among neighbours and then the label of
    that label, so long chains halve. Rounds are tables in the shared folder;
    only the number of changed labels is read by the driver. Messages to a hub
    are reduced before they are shuffled, and joins with a hub's label have one
    row on that side, so the engine can split them.
    """
    both = written(
        edges.filter("a <> b").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .select(F.col("a").alias("node"), "label")
            .unionByName(labels).groupBy("node").agg(F.min("label").alias("near"))
        )
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = written(
            near.join(jump, "near").join(labels, "node")
            .select("node", F.least("near", "far").alias("label"),
                    (F.least("near", "far") < F.col("label")).alias("changed")), "labels")
        labels = after.select("node", "label")
        if after.filter("changed").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
