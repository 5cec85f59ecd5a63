"""Connected components by label propagation with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of undirected edges (a, b): comp is the smallest node reachable.

    Each round every node takes the least label among its neighbours and then
    its label's label, so paths shorten by half. Hubs are pre-aggregated before
    the shuffle. No edges: no rows.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("comp").alias("jumped"))
        moved = written(step.join(jump, "least", "left").select("node", F.col("comp").alias("was"), F.least("least", F.coalesce("jumped", "least")).alias("comp")), "labels")
        labels = moved.select("node", "comp")
        if moved.filter("comp <> was").isEmpty():
            return labels
