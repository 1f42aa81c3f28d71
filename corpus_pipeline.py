"""A cleaning pipeline over ``documents``: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` stores it as Parquet in the
shared folder and reads it again for the next. All stages but the last return the columns of
``documents``. Rows without doc_id cannot be told apart and go in the first stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailloom.llm import decontaminate, ngram_join, packing, suffix_dedup, toxicity
from retailloom.llm.common import table
from retailloom.session import materialise, remove, scratch_made, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_stored: list[str] = []


def _alone(stage: Stage) -> Stage:
    """When a stage begins, the result of the one before is stored, and its intermediates go."""

    @functools.wraps(stage)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _stored)
        _stored.clear()
        with scratch_made() as paths:
            out = stage(spark, docs, sf_dir)
        _stored.extend(paths)
        return out

    return work



@_alone
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, scored within the scan."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = toxicity.scorer(model)(F.col("text").cast("string"))
    return docs.where(F.col("doc_id").isNotNull() & (score < toxicity.THRESHOLD))


@_alone
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, once."""
    joined = ngram_join.ngram_join(docs)
    own = F.col("doc_id").cast("long")
    gone = materialise(
        joined.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")), "gone"
    )
    # Most tables repeat no row; then no text is shuffled for it.
    twice = materialise(
        docs.select(own.alias("twice_id")).groupBy("twice_id").count().where("count > 1"), "twice"
    )
    docs = docs.where(F.col("doc_id").isNotNull()).join(gone, own == F.col("gone_id"), "left_anti")
    if twice.isEmpty():
        return docs
    same = own == F.col("twice_id")
    once = docs.join(twice, same, "left_semi").dropDuplicates(["doc_id"])
    return docs.join(twice, same, "left_anti").unionByName(once)


@_alone
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the byte strings that an earlier one holds. Bytes of a character
    that is cut in two go as well."""
    kept = suffix_dedup.suffix_dedup(docs, as_text=True).select(
        F.col("doc_id").alias("kept_id"), F.col("kept").alias("kept_text")
    )
    own = F.col("doc_id").cast("long") == F.col("kept_id")
    text = F.when(F.col("text"), F.col("kept_text"))
    return (
        docs.withColumn("text", F.col("text").isNotNull())
        .join(kept, own)
        .withColumn("text", text)
        .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        .select(docs.columns)
    )


@_alone
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    bad = materialise(found.select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("bad_id"), "left_anti")


@_alone
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

# The classifier, the alignment and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    remove(spark, _stored)
    _stored.clear()
    return docs
