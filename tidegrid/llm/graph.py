"""Connected components of an edge table, by least labels and pointer jumps on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of `edges` (a, b: long). Edges with nulls count for nothing; repeated ones and loops do no harm."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = stage(edges.filter("a is not null and b is not null and a <> b").select(F.inline(F.array(way("a", "b"), way("b", "a")))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stage(least.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            return labels
