"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node it is linked with.
    Each round takes the least label among neighbours, then the label of that label, so
    chains shorten by halves; every round is a table in the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                    .select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("upper"))
        step = step.join(up, F.col("root") == F.col("up"), "left") \
            .select("node", "old", F.least("root", F.coalesce("upper", "root")).alias("root"))
        step = stored(step, "labels")
        labels = step.select("node", "root")
        if step.where(F.col("root") != F.col("old")).limit(1).count() == 0:
            return labels
