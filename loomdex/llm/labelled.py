"""Labelled rows for classifiers, without those held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text is divisible by 5; false where doc_id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``(text, y)`` of at most ``max_rows`` labelled documents, none held out, in a fixed order.

    The sample is the documents of least xxhash64(doc_id): a bounded sample that doesn't
    depend on partitions. Repeated labels of a document count as their maximum.
    """
    y = labels.where(labels[label].isNotNull() & ~held_out(labels["doc_id"]))
    y = y.groupBy(F.col("doc_id").alias("d")).agg(F.max(label).cast("int").alias("y"))
    # Labels of documents that are there are sampled before the texts are joined; a sample of max_rows pairs of numbers is small at any size.
    y = y.where(y["d"].isNotNull()).join(docs.select(docs["doc_id"].alias("d")).distinct(), "d", "left_semi")
    y = y.orderBy(F.xxhash64("d"), "d").limit(max_rows)
    rows = docs.select(docs["doc_id"].alias("d"), F.coalesce(docs["text"], F.lit("")).alias("text")).join(F.broadcast(y), "d")
    return rows.select("d", "text", "y")
