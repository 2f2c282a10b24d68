"""Connected components by minimum labels and pointer jumping, all in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import stage


def components(links: DataFrame, nodes: int) -> DataFrame:
    """``(rid, label)`` for each end of the links (a, b) among at most ``nodes`` nodes: label is the smallest rid reachable.

    A round takes the smallest label among neighbours, then the label of that label; rounds needed grow with the
    logarithm of a component's diameter. Every round is written, so a lost executor costs its own tasks only.
    """
    both = links.select(F.col("a").alias("rid"), F.col("b").alias("to")).union(links.select("b", "a"))
    both = stage(both.distinct(), "ends", 16 * nodes)
    labels = stage(both.groupBy("rid").agg(F.least(F.min("to"), F.col("rid")).alias("label")), "labels", nodes)
    while True:
        near = both.join(labels.select(F.col("rid").alias("to"), F.col("label").alias("other")), "to")
        near = near.groupBy("rid").agg(F.min("other").alias("other"))
        step = labels.join(near, "rid").select("rid", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("rid").alias("label"), F.col("label").alias("next"))
        step = step.join(jump, "label", "left").select("rid", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        step = stage(step, "labels", nodes)
        labels = step.select("rid", "label")
        if step.filter("old <> label").isEmpty():
            return labels
