"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrel.operators.skew import salted_join
from textrel.session import checkpointed


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the smallest node of its component.

    Each round, nodes take the smallest label of their neighbours and then the label of their label, so long chains
    halve. The labels are written to the checkpoint folder each round; a lost executor costs no earlier round. A node with many
    neighbours, or a label of many nodes, is spread over tasks. Links are
    read both ways and may repeat; self-links give a component of one node. No links give no rows.
    """
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
    for _ in range(rounds):
        near = salted_join(both.select("a", F.col("b").alias("node")), labels, ["node"], ["a"]).groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("taken"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        jumped = checkpointed(salted_join(taken.withColumn("_at", F.col("taken")), jump, ["_at"], ["node"], "left").select("node", F.least("taken", F.coalesce("_to", "taken")).alias("new"), "label"))
        moved = jumped.where(F.col("new") != F.col("label")).limit(1).count()
        labels = jumped.select("node", F.col("new").alias("label"))
        if not moved:
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")
