"""Connected components of a graph given as links, by labels that travel to neighbours and jump along themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeframe.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches), for nodes that have links. links: a, b (numbers); direction and repeats don't matter.

    Each round gives a node the smallest label among its neighbours' and its own, then that label's own label. Labels
    only fall, and the rounds end when none does: after about log2 of the longest path. A node of many links meets them as partial minima.
    """
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        lower = labels.join(heard, labels.node == heard.a, "left").select("node", "component", F.least("component", "heard").alias("label"))
        own = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        new = settled(lower.join(own, "label", "left").select("node", F.least("label", "further").alias("label"), "component"))
        moved = new.where("label < component").limit(1).count()
        labels = new.select("node", F.col("label").alias("component"))
        if not moved:
            return labels
