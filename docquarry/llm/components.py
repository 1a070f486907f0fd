"""Connected components of a table of links, by DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for all nodes of ``links``; component is the smallest node of its component.

    Each step gives a node the smallest label among itself and its neighbours (partial minimum per
    task before the shuffle), then takes the label of its label, which halves paths.  Each step's
    table is written to the shared folder.  No links give an empty table.
    """
    spark, work = links.sparkSession, shared_dir(links.sparkSession, "components")
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    edges = stored(both.union(both.select("other", "node")).distinct(), "edges", f"{work}/edges")
    labels = stored(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels", f"{work}/labels-0")
    step = 0
    while True:
        step += 1
        theirs = edges.join(labels.withColumnsRenamed({"node": "other", "label": "other_label"}), "other").groupBy("node").agg(F.min("other_label").alias("least"))
        lower = labels.join(theirs, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels", f"{work}/labels-{step}")
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
