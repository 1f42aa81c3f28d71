"""Revenue by period, and the ordered-row operators over such series.

Windows here run over period totals: a few hundred rows per series however many sales
there are. They are never put on the sales themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailloom.functions.expressions import month_start, week_start

TEST_WEEKS = 13
SEASONAL_LAG = 52

ROWS, CALENDAR = "rows", "calendar"


def monthly_revenue(sales: DataFrame, with_orders: bool = False) -> DataFrame:
    aggregates = [F.sum("Revenue").alias("monthly_revenue")]
    if with_orders:
        aggregates.append(F.count_distinct("Invoice").alias("orders"))
    return sales.groupBy(month_start(F.col("InvoiceDate")).alias("month")).agg(*aggregates)


def running_total(value: Column, order: str, by: Sequence[str] = ()) -> Column:
    return F.sum(value).over(
        Window.partitionBy(*by)
        .orderBy(F.col(order).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def month_number(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month)


def week_number(week: Column) -> Column:
    return (F.unix_date(F.to_date(week)) / 7).cast("int")


def lagged(
    series: DataFrame,
    value: str,
    order: str,
    steps: Sequence[tuple[str, int]],
    by: Sequence[str] = (),
    mode: str = ROWS,
    numbered=None,
) -> DataFrame:
    """Add the value ``n`` periods earlier for each ``(name, n)`` in ``steps``.

    ``rows`` counts rows of the series, so a missing period stretches the lag.
    ``calendar`` takes the period whose number, given by ``numbered(column)``, is ``n``
    lower, and gives null where that period is missing.
    """
    if mode == ROWS:
        window = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())
        earlier = [F.lag(value, n).over(window) for _, n in steps]
    elif mode == CALENDAR:
        window = Window.partitionBy(*by).orderBy(numbered(F.col(order)))
        earlier = [F.max(value).over(window.rangeBetween(-n, -n)) for _, n in steps]
    else:
        raise ValueError(f"mode is {ROWS!r} or {CALENDAR!r}, not {mode!r}")
    return series.select("*", *[e.alias(name) for e, (name, _) in zip(earlier, steps)])


def weekly_revenue(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sales.groupBy(*by, week_start(F.col("InvoiceDate")).alias("week")).agg(
        F.sum("Revenue").alias("revenue")
    )


def trim_edges(series: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Drop the first and the last period of each series; both are partial."""
    ordered = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())
    whole = Window.partitionBy(*by)
    return (
        series.select(
            "*",
            F.row_number().over(ordered).alias("_at"),
            F.count(F.lit(1)).over(whole).alias("_of"),
        )
        .where((F.col("_at") > 1) & (F.col("_at") < F.col("_of")))
        .drop("_at", "_of")
    )


def complete_weeks(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return trim_edges(weekly_revenue(sales, by), "week", by)


def holdout_split(
    series: DataFrame, order: str = "week", test_rows: int = TEST_WEEKS, by: Sequence[str] = ()
) -> DataFrame:
    """Mark the last rows of each series as ``test``, the rest as ``train``."""
    newest = Window.partitionBy(*by).orderBy(F.col(order).desc_nulls_last())
    return series.withColumn(
        "split",
        F.when(F.row_number().over(newest) <= test_rows, F.lit("test")).otherwise(F.lit("train")),
    )


def seasonal_naive(
    series: DataFrame,
    lag: int = SEASONAL_LAG,
    by: Sequence[str] = (),
    mode: str = ROWS,
) -> DataFrame:
    """Predict each week from the value ``lag`` weeks earlier."""
    return lagged(
        series, "revenue", "week", [("prediction", lag)], by=by, mode=mode, numbered=week_number
    )


def future_weeks(
    train: DataFrame,
    periods: int = TEST_WEEKS,
    by: Sequence[str] = (),
    with_history: bool = True,
) -> DataFrame:
    """The weeks of ``train`` followed by the next ``periods`` Mondays."""
    last = train.groupBy(*by).agg(F.max("week").alias("_last"))
    mondays = F.sequence(
        F.date_add(F.to_date("_last"), 7),
        F.date_add(F.to_date("_last"), 7 * periods),
        F.expr("interval 7 days"),
    )
    ahead = (
        last.where(F.col("_last").isNotNull())
        .select(*by, F.explode(mondays).alias("week"))
        .withColumn("week", F.col("week").cast("timestamp_ntz"))
    )
    return train.select(*by, "week").unionByName(ahead) if with_history else ahead


