"""The load rules: cancellations, non-positive values, duplicates, netted returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from retailloom.functions.expressions import is_cancellation, not_positive, pct
from retailloom.operators import returns
from retailloom.schema import MONEY, PACKED, RAW_COLUMNS, SALES_COLUMNS
from retailloom.session import materialise


def invoice_text() -> Column:
    """A missing invoice becomes the text ``nan``, so it never counts as cancelled."""
    return F.coalesce(F.col("Invoice").cast("string"), F.lit("nan"))


def cancellations(raw: DataFrame) -> DataFrame:
    """Cancelled rows as they came: not filtered by value and not deduplicated."""
    return raw.where(F.col("Invoice").startswith("C"))


def valid_lines(raw: DataFrame) -> DataFrame:
    """Rows that are not cancelled and have no quantity or price <= 0.

    A missing value is not rejected. Written as plain comparisons, which reach the
    Parquet scan.
    """

    def missing_or(column: str, kept: Column) -> Column:
        return F.col(column).isNull() | kept

    return raw.where(
        missing_or("Invoice", ~F.col("Invoice").startswith("C"))
        & missing_or("Quantity", F.col("Quantity") > 0)
        & missing_or("Price", F.col("Price") > 0)
    ).withColumn("Invoice", invoice_text())


def whole_line() -> Column:
    """All eight columns as one value that is never null, so that missing fields
    compare equal and the value can serve as grouping and join key alike."""
    return F.struct(invoice_text().alias("Invoice"), *RAW_COLUMNS[1:]).alias("line")


def distinct_lines(valid: DataFrame) -> DataFrame:
    """Exact duplicates removed. Copies collapse on the map side, before the shuffle."""
    return valid.select(whole_line()).distinct()


def clean(
    raw: DataFrame, matches: DataFrame | None = None, seen: Observation | None = None
) -> DataFrame:
    """The cleaned ``sales`` rows. ``matches`` is what :func:`match_returns` gave, if at hand.
    ``seen`` takes the counts of the rules from the rows as they pass.
    """
    return priced(clean_lines(raw, matches, seen))


def priced(lines: DataFrame, *others: str) -> DataFrame:
    revenue = (F.col("Quantity") * F.col("Price")).cast(MONEY)
    return lines.withColumn("Revenue", revenue).select(*SALES_COLUMNS, *others)


def clean_lines(
    raw: DataFrame, matches: DataFrame | None = None, seen: Observation | None = None
) -> DataFrame:
    """The cleaned rows without their revenue, which need not travel to the writers.

    The shuffle that removes duplicates also places the rows for the anti-join
    against the netted sales: both are keyed by the whole line, so the big side moves once.
    """
    matches = match_returns(raw) if matches is None else matches
    netted = returns.netted_sales(matches).select(whole_line())
    lines = raw if seen is None else raw.observe(seen, *line_counts(is_valid(), F.lit(1)))
    return (
        distinct_lines(valid_lines(lines))
        .join(netted, "line", "left_anti")
        .select("line.*")
    )


def match_returns(raw: DataFrame) -> DataFrame:
    """The sales and cancellations that can match, in order, ready for the queue.

    Only sales whose key occurs among the cancellations are deduplicated here.
    """
    cancels = materialise(returns.cancel_batches(cancellations(raw)), "returns-cancels", **PACKED)
    candidates = returns.candidate_sales(valid_lines(raw), cancels)
    candidates = distinct_lines(candidates).select("line.*")
    return returns.timeline(candidates, cancels)


def line_counts(valid_rows: Column, copies: Column, line: str = "") -> list[Column]:
    """Counts per rule over rows that stand for ``copies`` equal raw lines each.

    The two value rules overlap and are counted apart.
    """
    cancelled = is_cancellation(F.col(f"{line}Invoice"))
    bad_quantity = ~cancelled & not_positive(F.col(f"{line}Quantity"))
    bad_price = ~cancelled & not_positive(F.col(f"{line}Price"))
    return [
        _total(copies, F.lit(True)).alias("rows_in"),
        _total(copies, cancelled).alias("cancelled"),
        _total(copies, bad_quantity).alias("non_positive_qty"),
        _total(copies, bad_price).alias("non_positive_price"),
        _total(copies, valid_rows).alias("valid"),
    ]


def _total(value: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("bigint")


def is_valid(line: str = "") -> Column:
    return (
        ~is_cancellation(F.col(f"{line}Invoice"))
        & ~not_positive(F.col(f"{line}Quantity"))
        & ~not_positive(F.col(f"{line}Price"))
    )


def cleaning_report(
    raw: DataFrame, matches: DataFrame | None = None, sales: DataFrame | None = None
) -> DataFrame:
    """What each rule dropped, as one row.

    With the stored ``sales`` at hand this is one narrow scan of ``raw`` and one of
    ``sales``: what is neither stored nor netted was a duplicate. Without it, equal lines
    are grouped with their number of copies, which shuffles all of ``raw``.
    """
    matches = match_returns(raw) if matches is None else matches
    matched = returns.matched_count(matches).scalar()
    if sales is not None:
        stored = sales.agg(
            F.struct(
                F.count(F.lit(1)).alias("rows"),
                F.count_if(F.col("CustomerID").isNull()).alias("nulls"),
            ).alias("stored")
        ).scalar()
        counts = (
            raw.agg(*line_counts(is_valid(), F.lit(1)))
            .withColumn("matched_returns_netted", matched)
            .withColumn("stored", stored)
            .withColumn("rows_out", F.col("stored.rows"))
            .withColumn("null_customer_id", F.col("stored.nulls"))
        )
    else:
        valid = is_valid("line.")
        nameless = valid & F.col("line.CustomerID").isNull()
        counts = (
            raw.groupBy(whole_line())
            .agg(F.count(F.lit(1)).alias("copies"))
            .agg(
                *line_counts(valid, F.col("copies"), "line."),
                _total(F.lit(1), valid).alias("distinct_valid"),
                _total(F.lit(1), nameless).alias("null_customer_id"),
            )
            .withColumn("matched_returns_netted", matched)
            .withColumn("rows_out", F.col("distinct_valid") - F.col("matched_returns_netted"))
        )
    return _report(counts)


def observed_report(seen: dict, matched: int, stored: dict, spark: SparkSession) -> DataFrame:
    """The same row from what a load has counted on its way: the rules on the raw lines (``seen``), and
    the lines and missing customers of the table (``stored``)."""
    names = ["rows_in", "cancelled", "non_positive_qty", "non_positive_price", "valid"]
    values = [seen[n] for n in names] + [matched, stored["rows"], stored["nulls"]]
    names += ["matched_returns_netted", "rows_out", "null_customer_id"]
    return _report(spark.createDataFrame([values], ", ".join(f"{n} bigint" for n in names)))


def _report(counts: DataFrame) -> DataFrame:
    return counts.select(
        "rows_in",
        "cancelled",
        "non_positive_qty",
        "non_positive_price",
        (F.col("valid") - F.col("rows_out") - F.col("matched_returns_netted")).alias("duplicates"),
        "matched_returns_netted",
        "null_customer_id",
        "rows_out",
        pct(F.col("rows_out"), F.col("rows_in"), 1).alias("kept_pct"),
    )
