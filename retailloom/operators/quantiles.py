"""Exact quantiles that never hold a whole group in one task.

A quantile sketch gives a narrow bracket around each wanted rank. Counting the rows below
and inside the bracket places the rank exactly; only the distinct values inside it are then
put in order. If a sketch should miss its rank, the bracket is opened on that side, so
the result is exact whatever the sketch says; its accuracy only decides how much is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailloom.session import materialise

ACCURACY = 100_000


def unpivot(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per value: the grouping columns, the column's name and its value."""
    cells = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns
    ]
    return (
        df.select(*by, F.explode(F.array(*cells)).alias("cell"))
        .select(*by, "cell.*")
        .where(F.col("value").isNotNull())
    )


def _key(by: Sequence[str]) -> Column:
    # A struct is never null itself, so rows with a null group still find their target.
    return F.struct(*by, "metric").alias("key")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linearly interpolated quantiles: ``by``, ``metric``, ``probability``, ``quantile``.

    The targets are stored before they are joined, so the optimizer broadcasts them by
    their real size: one row per group, column and probability.
    """
    values = unpivot(df, columns, by).select(_key(by), "value")
    value = F.col("value")

    slack = 2.0 / accuracy
    edges = [e for p in probabilities for e in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = values.groupBy("key").agg(
        F.count("value").alias("n"), F.percentile_approx("value", edges, accuracy).alias("edges")
    )
    wanted = [
        F.struct(
            F.lit(float(p)).alias("probability"),
            F.col("edges")[2 * i].alias("low"),
            F.col("edges")[2 * i + 1].alias("high"),
        )
        for i, p in enumerate(probabilities)
    ]
    rank = F.col("probability") * (F.col("n") - 1)
    targets = materialise(
        sketch.select("key", "n", F.explode(F.array(*wanted)).alias("want"))
        .select("key", "n", "want.*")
        .withColumn("first", F.floor(rank))
        .withColumn("fraction", rank - F.col("first"))
        .withColumn("second", F.ceil(rank)),
        "quantile-targets",
    )

    below, upto = F.col("below"), F.col("upto")
    missed_low, missed_high = F.col("first") < below, F.col("second") >= upto
    brackets = materialise(
        values.join(targets, "key")
        .groupBy("key", "probability", "first", "second", "fraction", "low", "high")
        .agg(
            F.count_if(value < F.col("low")).alias("below"),
            F.count_if(value <= F.col("high")).alias("upto"),
        )
        .withColumn("low", F.when(missed_low, F.lit(float("-inf"))).otherwise(F.col("low")))
        .withColumn("high", F.when(missed_high, F.lit(float("inf"))).otherwise(F.col("high")))
        .withColumn("below", F.when(missed_low, F.lit(0)).otherwise(below))
        .drop("upto"),
        "quantile-brackets",
    )

    group = ["key", "probability", "first", "second", "fraction", "below"]
    in_order = Window.partitionBy(*group).orderBy("value")
    near = (
        values.join(brackets, "key")
        .where(value.between(F.col("low"), F.col("high")))
        .groupBy(*group, "value")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("upto", F.col("below") + F.sum("copies").over(in_order))
    )
    return (
        near.groupBy(*group)
        .agg(
            F.min(F.when(F.col("upto") > F.col("first"), value)).alias("a"),
            F.min(F.when(F.col("upto") > F.col("second"), value)).alias("b"),
        )
        .select(
            "key.*",
            "probability",
            (F.col("a") + (F.col("b") - F.col("a")) * F.col("fraction")).alias("quantile"),
        )
    )


def exact_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with the median of each column under the column's name."""
    medians = exact_quantiles(df, columns, [0.5], by)
    return medians.groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == c, F.col("quantile"))).alias(c) for c in columns]
    )


def distribution_summary(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.5, 0.9, 0.99)
) -> DataFrame:
    """Count, mean, sample deviation, extremes and percentiles, one row per column."""
    plain = (
        unpivot(df, columns)
        .groupBy("metric")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    names = [f"p{100 * p:g}" for p in probabilities]
    percentiles = (
        exact_quantiles(df, columns, probabilities)
        .groupBy("metric")
        .agg(
            *[
                F.max(F.when(F.col("probability") == float(p), F.col("quantile"))).alias(name)
                for p, name in zip(probabilities, names)
            ]
        )
    )
    return plain.join(percentiles, "metric").select(
        "metric", "count", "mean", "std", "min", *names, "max"
    )
