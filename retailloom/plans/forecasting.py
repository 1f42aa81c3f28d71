"""Weekly revenue forecasts on a held-out quarter, and how far each model missed.

``by`` names the columns that tell series apart; without it there is one series, the
total. Every window runs inside a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailloom.operators import series
from retailloom.operators.forecast import additive_forecast
from retailloom.sources import warehouse

NAIVE = "Seasonal naive (52w)"
ADDITIVE = "Trend + yearly seasonality"


def naive_predictions(
    weekly: DataFrame,
    test_rows: int = series.TEST_WEEKS,
    lag: int = series.SEASONAL_LAG,
    by: Sequence[str] = (),
    strict: bool = True,
    model: str = NAIVE,
) -> DataFrame:
    """Seasonal-naive predictions for the test weeks.

    The lag looks back over the whole series, so it reaches into the training weeks.
    ``strict`` fails the job when a test week has no week ``lag`` rows earlier.
    """
    split = series.holdout_split(series.seasonal_naive(weekly, lag, by), "week", test_rows, by)
    prediction = F.col("prediction").cast("double")
    if strict:
        prediction = F.when(prediction.isNotNull(), prediction).otherwise(
            F.raise_error(F.lit(f"the baseline needs {lag} rows of history before the test weeks"))
        )
    return split.where(F.col("split") == "test").select(
        *by,
        "week",
        F.col("revenue").cast("double").alias("revenue"),
        F.lit(model).alias("model"),
        prediction.alias("prediction"),
    )


def additive_predictions(
    weekly: DataFrame, test_rows: int = series.TEST_WEEKS, by: Sequence[str] = (), **terms: int
) -> DataFrame:
    """Predictions of the additive model for the test weeks, fitted on the others only.

    The model is evaluated at the date of each test week, so a week missing anywhere cannot
    shift predictions against actuals.
    """
    split = series.holdout_split(weekly, "week", test_rows, by)
    revenue, is_test = F.col("revenue").cast("double"), F.col("split") == "test"
    frame = split.select(
        *by, "week", revenue.alias("revenue"), is_test.alias("is_test"),
        F.when(~is_test, revenue).alias("known"),
    )
    return (
        additive_forecast(frame, by, "known", **terms)
        .where("is_test")
        .select(*by, "week", "revenue", F.lit(ADDITIVE).alias("model"), "prediction")
    )


def accuracy(predictions: DataFrame, by: Sequence[str] = (), baseline: str = NAIVE) -> DataFrame:
    """MAE and MAPE per model, and the MAE saved against the baseline.

    Models are scored on the weeks for which all of them have a prediction. A week with no revenue
    has no percentage error and is left out of MAPE. Without a common week all scores are null and
    ``weeks_scored`` is 0.
    """
    week = Window.partitionBy(*by, "week")
    predictions = predictions.withColumn(
        "without", F.sum(F.col("prediction").isNull().cast("int")).over(week)
    ).withColumn("prediction", F.when(F.col("without") == 0, F.col("prediction")))
    miss = F.col("revenue") - F.col("prediction")
    scored = predictions.groupBy(*by, "model").agg(
        F.count("prediction").alias("weeks_scored"),
        F.avg(F.abs(miss)).alias("MAE"),
        (F.avg(F.abs(F.try_divide(miss, F.col("revenue")))) * 100).alias("MAPE_%"),
    )
    base = F.max(F.when(F.col("model") == baseline, F.col("MAE"))).over(Window.partitionBy(*by))
    return scored.withColumn("MAE_vs_baseline_%", F.try_divide(base - F.col("MAE"), base) * 100)


def peak_week(predictions: DataFrame, models: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """The test week with the most revenue and what each model said about it.

    ``models`` maps output columns to model names. The earliest of equal weeks wins.
    """

    def of(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("prediction")))

    weeks = predictions.groupBy(*by, "week", "revenue").agg(
        *[of(model).alias(column) for column, model in models.items()]
    )
    earliest = -F.unix_date(F.to_date("week"))
    return (
        weeks.groupBy(*by)
        .agg(
            F.max_by(
                F.struct("week", F.col("revenue").alias("actual"), *models),
                F.struct("revenue", earliest.alias("earliest")),
            ).alias("peak")
        )
        .select(*by, "peak.*")
    )


def compare(weekly: DataFrame, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Predictions of both models, one row per test week and model."""
    return naive_predictions(weekly, by=by, strict=strict).unionByName(
        additive_predictions(weekly, by=by)
    )


def rolling_origins(
    weekly: DataFrame, origins: int, step: int = series.TEST_WEEKS, by: Sequence[str] = ()
) -> DataFrame:
    """The series as they stood at earlier times, told apart by ``origin``: 0 is the whole series, and
    each further one ends ``step`` rows earlier. A series too short for an origin is absent there.

    What takes ``by`` treats every origin as a series of its own, so a model never sees a
    week beyond its origin: ``accuracy(compare(..., by), by)`` with ``by`` and ``origin``.
    """
    place = Window.partitionBy(*by).orderBy("week")
    length = F.count(F.lit(1)).over(Window.partitionBy(*by))
    numbered = weekly.withColumn("row", F.row_number().over(place)).withColumn("rows", length)
    every = F.explode(F.sequence(F.lit(0), F.lit(origins - 1))).alias("origin")
    return (
        numbered.select("*", every)
        .where(F.col("row") <= F.col("rows") - F.col("origin") * step)
        .select(*weekly.columns, "origin")
    )


def write_results(metrics: DataFrame, folder: str) -> None:
    # The columns and their order are those of the published file.
    metrics = metrics.select("model", "MAE", "MAPE_%", "MAE_vs_baseline_%")
    warehouse.write_csv(metrics.orderBy("model"), f"{folder}/forecast_metrics")
