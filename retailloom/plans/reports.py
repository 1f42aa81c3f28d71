"""The commercial reports. Each takes ``sales`` and returns a lazy DataFrame.

Money stays decimal, so totals are exact; callers who want floating point cast at the
end. Every sort carries a total order, so equal amounts come out the same every time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailloom.functions.expressions import growth_pct, is_service_line, month_label, pct, ratio
from retailloom.operators import filters, series
from retailloom.schema import SALE_MONTH, SERVICE_LINES


def monthly_trend(sales: DataFrame, with_orders: bool = True) -> DataFrame:
    """Revenue (and orders) by month with the running total."""
    total = "running_total_revenue" if with_orders else "running_total"
    return (
        series.monthly_revenue(sales, with_orders)
        .withColumn(total, series.running_total(F.col("monthly_revenue"), "month"))
        .orderBy(F.col("month").asc_nulls_last())
    )


def growth(sales: DataFrame, mode: str = series.ROWS) -> DataFrame:
    """Month over month beside year over year."""
    now = F.col("monthly_revenue")
    return (
        series.lagged(
            series.monthly_revenue(sales),
            "monthly_revenue",
            "month",
            [("prev_month_revenue", 1), ("same_month_last_year", 12)],
            mode=mode,
            numbered=series.month_number,
        )
        .select(
            "month",
            "monthly_revenue",
            "prev_month_revenue",
            growth_pct(now, F.col("prev_month_revenue")).alias("mom_growth_pct"),
            "same_month_last_year",
            growth_pct(now, F.col("same_month_last_year")).alias("yoy_growth_pct"),
        )
        .orderBy(F.col("month").asc_nulls_last())
    )


def growth_tile(sales: DataFrame, mode: str = series.ROWS) -> DataFrame:
    """Growth as the dashboard shows it: newest first, with headings for people."""
    return (
        growth(sales, mode)
        .orderBy(F.col("month").desc_nulls_last())
        .select(
            month_label(F.col("month")).alias("Month"),
            F.col("monthly_revenue").alias("Revenue (£)"),
            F.col("mom_growth_pct").alias("MoM %"),
            F.col("yoy_growth_pct").alias("YoY %"),
        )
    )


def revenue_by_country(sales: DataFrame) -> DataFrame:
    return sales.groupBy("Country").agg(F.sum("Revenue").alias("revenue"))


def _largest(label: str, amount: str = "revenue") -> list:
    return [F.col(amount).desc_nulls_last(), F.col(label).asc_nulls_last()]


def filter_countries(sales: DataFrame) -> DataFrame:
    """Countries for the filter, largest market first."""
    totals = revenue_by_country(sales)
    return totals.orderBy(*_largest("Country")).select("Country")


def date_bounds(sales: DataFrame) -> DataFrame:
    return sales.agg(F.min("InvoiceDate").alias("lo"), F.max("InvoiceDate").alias("hi"))


def kpis(sales: DataFrame) -> DataFrame:
    """Revenue, orders, average order value and customers.

    Lines are summed per invoice first. Two distinct counts make Spark copy every row it
    counts; this way it copies invoices, not lines.
    """
    invoices = sales.groupBy("Invoice", "CustomerID").agg(F.sum("Revenue").alias("Revenue"))
    return invoices.agg(
        F.sum("Revenue").alias("revenue"),
        F.count_distinct("Invoice").alias("orders"),
        F.count_distinct("CustomerID").alias("customers"),
    ).select(
        "revenue",
        "orders",
        ratio(F.col("revenue"), F.col("orders")).alias("avg_order_value"),
        "customers",
    )


def top_markets(sales: DataFrame, n: int = 10) -> DataFrame:
    totals = revenue_by_country(sales)
    return totals.orderBy(*_largest("Country")).limit(n)


def top_market(sales: DataFrame) -> DataFrame:
    return top_markets(sales, 1)


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    """Largest products by description, not by stock code."""
    totals = (
        sales.where(F.col("Description").isNotNull())
        .groupBy(F.col("Description").alias("product"))
        .agg(F.sum("Revenue").alias("revenue"))
    )
    return totals.orderBy(*_largest("product")).limit(n)


def chart_order(top: DataFrame, label: str) -> DataFrame:
    """Smallest first, as a horizontal bar chart wants it."""
    return top.orderBy(F.col("revenue").asc_nulls_last(), F.col(label).desc_nulls_last())


def transaction_search(sales: DataFrame, term: str = "", n: int = 500) -> DataFrame:
    """The latest matching rows."""
    return (
        filters.search_description(sales, term)
        .select(
            "InvoiceDate", "Invoice", "Description", "Country", "Quantity", "Price", "Revenue"
        )
        .orderBy(
            F.col("InvoiceDate").desc_nulls_last(),
            *[
                F.col(c).asc_nulls_last()
                for c in ("Invoice", "Description", "Quantity", "Price", "Country")
            ],
        )
        .limit(n)
    )


def top_products_by_country(sales: DataFrame, markets: int = 8, ranks: int = 5) -> DataFrame:
    """The leading products of each of the biggest markets.

    One scan feeds everything: the sales are summed per (country, product) once, and the
    country totals, the share denominators and the ranking all read that shuffle. Both
    readers use every column of it, or pruning would make them two different shuffles; that
    is why units break ties between markets. The totals keep one row per chosen market,
    so joining them moves no products.
    Equal revenue shares a rank, so a market can show more than ``ranks`` rows.
    """
    by_product = sales.groupBy("Country", "Description").agg(
        F.sum("Revenue").alias("product_revenue"),
        F.sum("Quantity").alias("units_sold"),
        # Counted, not tested as null: a test would be pushed under the aggregation of
        # one reader only, and the two readers could no longer share its shuffle.
        F.count("Description").alias("named"),
    )
    named = F.col("named") > 0
    chosen = (
        by_product.groupBy("Country")
        .agg(
            F.sum("product_revenue").alias("country_revenue"),
            F.sum(F.when(named, F.col("product_revenue"))).alias("named_revenue"),
            F.sum("units_sold").alias("country_units"),
        )
        .orderBy(
            F.col("country_revenue").desc_nulls_last(),
            F.col("Country").asc_nulls_last(),
            # Never decides; it keeps the column, so that both readers share one shuffle.
            F.col("country_units").desc_nulls_last(),
        )
        .limit(markets)
        .select(F.col("Country").alias("market"), "named_revenue")
        .where(F.col("market").isNotNull())
    )
    best_first = Window.partitionBy("Country").orderBy(F.col("product_revenue").desc_nulls_last())
    return (
        by_product.where(named)
        # ``chosen`` has at most ``markets`` rows.
        .join(F.broadcast(chosen), F.col("Country").eqNullSafe(F.col("market")))
        .withColumn("place", F.rank().over(best_first))
        .where(F.col("place") <= ranks)
        .select(
            "Country",
            F.col("Description").alias("product"),
            "product_revenue",
            "units_sold",
            F.col("place").cast("bigint").alias("rank_in_country"),
            pct(F.col("product_revenue"), F.col("named_revenue"), 2).alias(
                "pct_of_country_revenue"
            ),
        )
        .orderBy("Country", "rank_in_country", "product")
    )


def like_for_like(sales: DataFrame, year: int, through_month: int = 11) -> DataFrame:
    """January to ``through_month`` of a year against the same span a year earlier."""
    sold = F.year("InvoiceDate")
    spans = sales.where(
        (F.col("InvoiceDate") >= F.lit(f"{year - 1}-01-01 00:00:00").cast("timestamp_ntz"))
        & (F.col("InvoiceDate") < F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz"))
        & (F.month("InvoiceDate") <= through_month)
    )
    if SALE_MONTH in sales.columns:
        # The same months on the partition column, so that others are never opened.
        of_year = [
            F.col(SALE_MONTH).between(
                F.lit(f"{y}-01-01").cast("date"), F.lit(f"{y}-{through_month:02d}-01").cast("date")
            )
            for y in (year - 1, year)
        ]
        spans = spans.where(of_year[0] | of_year[1])
    return spans.agg(
        F.sum(F.when(sold == year, F.col("Revenue"))).alias("revenue"),
        F.sum(F.when(sold == year - 1, F.col("Revenue"))).alias("revenue_before"),
    ).withColumn("growth_pct", growth_pct(F.col("revenue"), F.col("revenue_before")))


def market_share(sales: DataFrame) -> DataFrame:
    """Share of total revenue per country."""
    totals = revenue_by_country(sales)
    whole = F.sum("revenue").over(Window.partitionBy())
    return totals.select(
        "Country", "revenue", pct(F.col("revenue"), whole, 1).alias("share_pct")
    ).orderBy(*_largest("Country"))


def with_service_flag(
    df: DataFrame, description: str = "Description", service_lines: Sequence[str] = SERVICE_LINES
) -> DataFrame:
    return df.withColumn("is_service_line", is_service_line(F.col(description), service_lines))


def service_line_leaders(
    sales: DataFrame, service_lines: Sequence[str] = SERVICE_LINES, markets: int = 8
) -> DataFrame:
    """The leading line of each big market, and whether it is a charge, not a product."""
    return with_service_flag(
        top_products_by_country(sales, markets, ranks=1), "product", service_lines
    ).select(
        "Country",
        "product",
        "product_revenue",
        "units_sold",
        "pct_of_country_revenue",
        "is_service_line",
    )


def null_customer_share(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("CustomerID").isNull()).alias("null_customer_rows"),
    ).withColumn("share_pct", pct(F.col("null_customer_rows"), F.col("rows"), 1))


def weekday_profile(sales: DataFrame) -> DataFrame:
    """Trading days, orders and revenue by day of the week (1 is Monday).

    Summed per day and invoice first, as in :func:`kpis`.
    """
    invoices = sales.groupBy(F.to_date("InvoiceDate").alias("day"), "Invoice").agg(
        F.sum("Revenue").alias("Revenue")
    )
    return (
        invoices.groupBy((F.weekday("day") + 1).alias("weekday"))
        .agg(
            F.count_distinct("day").alias("trading_days"),
            F.count_distinct("Invoice").alias("orders"),
            F.sum("Revenue").alias("revenue"),
        )
        .orderBy("weekday")
    )
