"""Labelled rows for fitting: all of them, or a bounded sample of their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, teaches: Column, per_class: int) -> tuple[list[tuple[str, int]], float]:
    """At most about `per_class` (text, label) of each label 0 and 1 among rows that `teaches` marks, chosen by a hash of doc_id, and the share of label 1 among all of them.

    Rows without a label teach nothing; null texts count as empty. The chosen ids are bounded by 2.2 * `per_class`, so they are broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(teaches & F.col("y").isin(0, 1))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = F.lit(False)
    for y, n in counts.items():
        chosen = chosen | (F.col("y") == y) & (place < per_class / n)
    ids = known.filter(chosen).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(int(2.2 * per_class))  # the same whatever the order of rows
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y").collect()
    return sorted((r["text"] or "", r["y"]) for r in rows), counts.get(1, 0) / max(1, sum(counts.values()))


def taught(rows: DataFrame, labels: DataFrame, label: str, teaches: Column) -> DataFrame:
    """All of `rows` that `teaches` marks, once for each of their labels 0 and 1, with it as y. Rows without a label teach nothing."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(teaches & F.col("y").isin(0, 1))
    return rows.join(known, "doc_id")
