"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotgrid.llm.common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """``node, comp``: the smallest node reachable from every node of ``links(a, b)``.

    Each round a node takes the smallest label among its neighbours and then the label of
    that label, so chains shorten geometrically; every round is one stored table.  The
    smallest label is found before the shuffle, so a node with very many links is no hot key.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = stored(both, "cc_edges")
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "cc_labels")
    while True:
        around = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(around.withColumnRenamed("a", "node"), "node", "left").select("node", "comp", F.least("comp", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        step = lower.join(jump, "near", "left").select("node", F.coalesce(F.least("near", "far"), "near").alias("comp"), F.col("comp").alias("was"))
        step = stored(step, "cc_labels")
        moved = not step.where("comp <> was").isEmpty()
        dropped(labels)
        labels = step.select("node", "comp")
        if not moved:
            return labels
