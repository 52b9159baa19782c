"""Connected components of a table of links, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuetrace.llm.jobs import store


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the smallest node reachable. Nodes without links are not listed.

    Each round every node takes the smallest label among its own and its neighbours' labels, and then the label of that
    label, so that chains halve. The state of each round is stored; the loop ends when nothing changes.
    """
    both = store(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = store(both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(
            F.min("component").alias("near")).withColumnRenamed("a", "node"))
        # Whoever pointed to a label that finds a smaller one hears of it through the label.
        moved = labels.join(near, "node").select("node", F.least("component", "near").alias("component"),
                                                 F.col("component").alias("before"))
        told = moved.filter("component < before").groupBy(F.col("before").alias("node")).agg(
            F.min("component").alias("hint"))
        hinted = store(moved.join(told, "node", "left").select(
            "node", F.least("component", "hint").alias("component"), "before"), "labels")
        up = hinted.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = store(hinted.join(up, "component", "left").select(
            "node", F.least("component", "top").alias("component"), "before"), "labels")
        changed = jumped.filter("component <> before").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
