"""Connected components of a graph of links, by repeated small DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriclake.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component) for every node in a link; component is the smallest node reachable.

    Every round each node takes the smallest label among its own and its neighbours', then its label's
    label, so that labels travel twice as far each round; rounds end when no label changes. Labels are
    written each round. Repeated links, links to itself and hubs are fine: a hub's neighbours are only
    ever reduced to their minimum.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        nearer = written(nearer, "labels")
        step = nearer.join(nearer.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        new = written(step.select("node", F.least("label", F.coalesce("further", "label")).alias("component"), "old"), "labels")
        if new.filter("component != old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def with_components(nodes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """nodes with `component`: that of their key, or the key itself where it has no link."""
    found = components(links).withColumnRenamed("node", key)
    return nodes.join(found, key, "left").withColumn("component", F.coalesce("component", key))
