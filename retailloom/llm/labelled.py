"""Labelled rows for the two classifiers: which may be learned from, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailloom.llm.common import id_and_text


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text and y of at most ``limit`` labelled documents that are not held out.

    The sample is the same on every run: the smallest hashes of doc_id. A document labelled twice
    counts as 1 if any label says so. Rows without id or label, and labels other than 0 and 1,
    are left out.
    """
    doc_id = F.col("doc_id").cast("long")
    chosen = (
        labels.select(doc_id.alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # At most ``limit`` rows of two numbers.
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
