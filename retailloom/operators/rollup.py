"""Month by country totals whose distinct counts can be added up: exact bitmaps, not sketches.

The dashboard counts distinct orders and customers under any range of dates and choice of countries, and
such counts cannot be summed. Here every order and customer gets a number, and a (month, country) keeps the
set of its numbers as bitmaps of 32,768 bits, one for each stretch of numbers that it has any of. A query
unites the bitmaps of whole months and counts bits. It reads sales lines only for months that
the range cuts, at most two, and with them the numbers of the members of these months.

Numbers follow the month and country of an order's first line (a customer's country), so the
members of one (month, country) stand close together and fill few bitmaps. Equal sets of lines give equal
results, whatever the numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailloom.functions.expressions import ratio
from retailloom.operators import filters, series
from retailloom.schema import SALE_MONTH, SALES
from retailloom.session import materialise

ORDER, CUSTOMER = "order", "customer"
MEMBERS = {ORDER: "Invoice", CUSTOMER: "CustomerID"}


@dataclass
class Rollup:
    """The stored parts, and the sales they were made of."""

    sales: DataFrame
    measures: DataFrame  # sale_month, Country, revenue
    bitmaps: DataFrame  # sale_month, Country, kind, bucket, bits
    numbers: dict[str, DataFrame]  # per kind: member, number, sale_month


def _months(sales: DataFrame) -> DataFrame:
    if SALE_MONTH in sales.columns:
        return sales
    return sales.withColumn(SALE_MONTH, F.trunc(F.to_date("InvoiceDate"), "month"))


def _numbered(sales: DataFrame, column: str) -> DataFrame:
    """Every member with its number, in the order of month, country and member, and the places it
    occurs in, at most as many as there are months and countries.

    Places are made distinct first, so that a member with very many lines is spread over tasks until then,
    and gathered by member. Nothing is joined afterwards.
    Sorting by range and counting on from the partition's start needs no pass to count; the numbers of
    different partitions lie far apart, which costs no bitmap, as empty stretches have none.
    """
    places = F.expr(f"collect_list(DISTINCT struct({SALE_MONTH}, Country))").alias("places")
    found = sales.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("member")).agg(places)
    first = F.array_min("places")
    place = [first[SALE_MONTH], first["Country"], F.col("member")]
    if column == MEMBERS[CUSTOMER]:
        place = place[1:]
    ordered = found.repartitionByRange(*place).sortWithinPartitions(*place)
    return ordered.select("member", "places", F.monotonically_increasing_id().alias("number"))


def _members(lines: DataFrame, kind: str, numbers: DataFrame, on: Sequence[str]) -> DataFrame:
    """Which members occur in each (month, country), with their numbers."""
    column = MEMBERS[kind]
    found = (
        lines.where(F.col(column).isNotNull())
        .groupBy(SALE_MONTH, "Country", F.col(column).alias("member"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    return found.join(numbers, list(on)).select(SALE_MONTH, "Country", "member", "number")


def _bitmaps(members: dict[str, DataFrame]) -> DataFrame:
    """One row per month, country, kind and stretch of numbers."""
    orders, customers = (
        rows.select(
            SALE_MONTH, "Country", F.lit(kind).alias("kind"),
            F.bitmap_bucket_number("number").alias("bucket"),
            F.bitmap_bit_position("number").alias("position"),
        )
        for kind, rows in members.items()
    )
    return orders.unionByName(customers).groupBy(SALE_MONTH, "Country", "kind", "bucket").agg(
        F.bitmap_construct_agg("position").alias("bits")
    )


def _measures(lines: DataFrame) -> DataFrame:
    return lines.groupBy(SALE_MONTH, "Country").agg(F.sum("Revenue").alias("revenue"))


def build(sales: DataFrame, folder: str) -> Rollup:
    """Store the rollup of ``sales`` below ``folder``, replacing what is there."""
    spark, lines = sales.sparkSession, _months(sales)
    members = {}
    for kind, column in MEMBERS.items():
        numbers = materialise(_numbered(lines, column), f"{kind}-numbers")
        members[kind] = numbers.select(F.explode("places").alias("place"), "number").select("place.*", "number")
        months = F.array_distinct(F.col(f"places.{SALE_MONTH}"))
        by_month = numbers.select("member", "number", F.explode(months).alias(SALE_MONTH))
        by_month.where(F.col(SALE_MONTH).isNotNull()).hint("rebalance", SALE_MONTH).write.mode("overwrite").partitionBy(
            SALE_MONTH
        ).parquet(f"{folder}/numbers/{kind}")
    _measures(lines).write.mode("overwrite").parquet(f"{folder}/measures")
    bits = _bitmaps(members)
    # Ordered by month, so that the files of other months are skipped by their statistics.
    bits = bits.repartitionByRange(SALE_MONTH, "kind", "bucket").sortWithinPartitions(SALE_MONTH, "kind", "bucket")
    bits.write.mode("overwrite").parquet(f"{folder}/bitmaps")
    return read(spark, folder, sales)


def read(spark: SparkSession, folder: str, sales: DataFrame) -> Rollup:
    return Rollup(
        sales,
        spark.read.parquet(f"{folder}/measures"),
        spark.read.parquet(f"{folder}/bitmaps"),
        {
            kind: spark.read.schema(
                f"member {SALES[column].dataType.simpleString()}, number bigint, {SALE_MONTH} date"
            ).parquet(f"{folder}/numbers/{kind}")
            for kind, column in MEMBERS.items()
        },
    )


def _span(start: date | str | None, end: date | str | None) -> tuple[list[str], Column | None]:
    """The months that the range cuts, and the condition on those it holds whole.

    The last instant of ``end`` is its last second, so lines in a later fraction of it would be counted by a
    whole month though they are out. A month that ends with ``end`` therefore counts as cut.
    """
    if start is None or end is None:
        return [], None
    first, last = date.fromisoformat(str(start)), date.fromisoformat(str(end))
    cut = {last.replace(day=1)} | ({first.replace(day=1)} if first.day > 1 else set())
    whole = F.col(SALE_MONTH).between(F.lit(first), F.lit(last)) & ~F.col(SALE_MONTH).isin(*cut)
    return sorted(day.isoformat() for day in cut), whole


def _parts(
    rollup: Rollup, start: date | str | None, end: date | str | None, countries: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Revenue and bitmaps of every (month, country) within the filter, from both sources."""
    cut, whole = _span(start, end)
    inside = F.lit(True) if whole is None else whole
    if countries:
        inside = inside & F.col("Country").isin(*countries)
    revenue, bits = rollup.measures.where(inside), rollup.bitmaps.where(inside)
    if cut:
        lines = filters.filter_sales(_months(rollup.sales), start, end, countries)
        in_cut = F.col(SALE_MONTH).isin(*[F.lit(day).cast("date") for day in cut])
        lines, on = lines.where(in_cut), [SALE_MONTH, "member"]
        members = {k: _members(lines, k, rollup.numbers[k].where(in_cut), on) for k in MEMBERS}
        revenue = revenue.unionByName(_measures(lines))
        bits = bits.unionByName(_bitmaps(members))
    return revenue, bits


def _counts(bits: DataFrame, by: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    united = bits.where(F.col("kind").isin(*kinds)).groupBy(*by, "kind", "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")
    )
    totals = [
        F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"{kind}s") for kind in kinds
    ]
    return united.groupBy(*by).agg(*totals)


def kpis(
    rollup: Rollup,
    start: date | str | None = None,
    end: date | str | None = None,
    countries: Sequence[str] = (),
) -> DataFrame:
    """As ``reports.kpis`` of the filtered sales."""
    revenue, bits = _parts(rollup, start, end, countries)
    counts = _counts(bits, [], [ORDER, CUSTOMER])
    # One row each.
    total = revenue.agg(F.sum("revenue").alias("revenue"))
    both = counts.select(total.scalar().alias("revenue"), "orders", "customers")
    return both.select(
        "revenue", "orders", ratio(F.col("revenue"), F.col("orders")).alias("avg_order_value"), "customers"
    )


def monthly_trend(
    rollup: Rollup,
    start: date | str | None = None,
    end: date | str | None = None,
    countries: Sequence[str] = (),
) -> DataFrame:
    """As ``reports.monthly_trend`` of the filtered sales, with orders."""
    revenue, bits = _parts(rollup, start, end, countries)
    month = F.col(SALE_MONTH).cast("timestamp_ntz").alias("month")
    totals = revenue.groupBy(month).agg(F.sum("revenue").alias("monthly_revenue"))
    orders = _counts(bits.withColumn("month", month), ["month"], [ORDER])
    # A few hundred rows; a month may be null, where lines have no date.
    same = totals["month"].eqNullSafe(orders["month"])
    return (
        totals.join(orders, same)
        .select(totals["month"], "monthly_revenue", "orders")
        .withColumn("running_total_revenue", series.running_total(F.col("monthly_revenue"), "month"))
        .orderBy(F.col("month").asc_nulls_last())
    )
