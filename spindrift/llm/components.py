"""Connected components of an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import staged, unstaged


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns node, label (and old); label is the smallest node of the component.

    Each round every node takes the smallest label around it (a min per node, summed up before
    the shuffle), then its label's label; rounds grow with the logarithm of a path's length.
    Edges and labels stay in written tables; the driver sees one count a round."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = nearer.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        step = staged(jumped.select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old"), "labels")
        unstaged(labels)
        labels = step
        if not step.where("label != old").limit(1).count():
            unstaged(both)
            return labels
