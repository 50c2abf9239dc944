"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of each node of ``links (a, b)``; the label is the least node of its component.

    Rounds of minima over neighbours, each followed by a jump to the label's label, until none changes;
    each round's labels are a written table, so lineage stays short and nothing comes to the driver
    but a count. No link gives no row.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "node").select("node", F.least("label", "m").alias("to"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = written(hooked.join(jump, "to").select("node", F.least("to", "further").alias("label"), (F.least("to", "further") < F.col("old")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        dropped(labels.sparkSession, labels)
        labels = new.select("node", "label")
        if not moved:
            dropped(labels.sparkSession, edges)
            return labels
