"""An index for the transaction search: which descriptions match, and in which months they occur.

A search compares the description of every line with a pattern, though there are few descriptions and the
newest 500 lines are wanted. The index holds the distinct descriptions with their trigrams, and how
many lines each has per month and country. A search looks up the trigrams that every match must contain, tries the
pattern on the descriptions that have them all, and goes back from the newest month until the counts
promise enough lines. Only those months of the sales are opened, by their partition.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailloom.operators import filters
from retailloom.plans import reports
from retailloom.schema import SALE_MONTH

GRAM = 3
LATEST = 500


@dataclass
class SearchIndex:
    sales: DataFrame
    descriptions: DataFrame  # id, Description
    trigrams: DataFrame  # gram, id
    months: DataFrame  # id, sale_month, Country, lines


def _months(sales: DataFrame) -> DataFrame:
    if SALE_MONTH in sales.columns:
        return sales
    return sales.withColumn(SALE_MONTH, F.trunc(F.to_date("InvoiceDate"), "month"))


def build(sales: DataFrame, folder: str) -> SearchIndex:
    """Store the index of ``sales`` below ``folder``, replacing what is there."""
    spark = sales.sparkSession
    counted = (
        _months(sales)
        .where(F.col("Description").isNotNull())
        .groupBy("Description", SALE_MONTH, "Country")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    counted.write.mode("overwrite").parquet(f"{folder}/counted")
    counted = spark.read.parquet(f"{folder}/counted")
    named = counted.select("Description").distinct().select(
        F.monotonically_increasing_id().alias("id"), "Description"
    )
    named.write.mode("overwrite").parquet(f"{folder}/descriptions")
    named = spark.read.parquet(f"{folder}/descriptions")
    lower = F.lower("Description")
    starts = F.sequence(F.lit(1), F.length(lower) - (GRAM - 1))
    grams = F.transform(starts, lambda i: F.substring(lower, i, F.lit(GRAM)))
    # Sorted, so that the statistics of the files lead to the few grams of a search.
    (
        named.where(F.length(lower) >= GRAM)
        .select(F.explode(F.array_distinct(grams)).alias("gram"), "id")
        .repartitionByRange("gram")
        .sortWithinPartitions("gram")
        .write.mode("overwrite")
        .parquet(f"{folder}/trigrams")
    )
    counted.join(named, "Description").select("id", SALE_MONTH, "Country", "lines").write.mode(
        "overwrite"
    ).parquet(f"{folder}/months")
    return read(spark, folder, sales)


def read(spark: SparkSession, folder: str, sales: DataFrame) -> SearchIndex:
    parts = [spark.read.parquet(f"{folder}/{n}") for n in ("descriptions", "trigrams", "months")]
    return SearchIndex(sales, *parts)


def needed_grams(term: str) -> list[str]:
    """Trigrams of the stretches between wildcards: every match contains them all."""
    runs = re.split("[%_]", term.lower())
    return sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def matching(index: SearchIndex, term: str) -> DataFrame:
    """id and Description of the descriptions that match. A term without trigrams tries all."""
    grams = needed_grams(term)
    some = index.descriptions
    if grams:
        held = index.trigrams.where(F.col("gram").isin(*grams)).groupBy("id").agg(F.count("*").alias("n"))
        some = some.join(held.where(F.col("n") == len(grams)), "id", "left_semi")
    return filters.search_description(some, term)


def first_month(
    index: SearchIndex,
    found: DataFrame,
    n: int = LATEST,
    start: date | str | None = None,
    end: date | str | None = None,
    countries: Sequence[str] = (),
) -> tuple[date | None, bool]:
    """The month back to which at least ``n`` matching lines lie within the filter, and whether there
    are as many. Months that the range may cut promise none. One row per month comes to the driver."""
    months = index.months.join(found.select("id"), "id", "left_semi").where(F.col(SALE_MONTH).isNotNull())
    if countries:
        months = months.where(F.col("Country").isin(*countries))
    if start is not None and end is not None:
        first, last = (date.fromisoformat(str(d)).replace(day=1) for d in (start, end))
        inside = (F.col(SALE_MONTH) > F.lit(first)) & (F.col(SALE_MONTH) < F.lit(last))
        months = months.where(inside)
    counts = months.groupBy(SALE_MONTH).agg(F.sum("lines").alias("lines")).collect()
    total = 0
    for row in sorted(counts, key=lambda r: r[SALE_MONTH], reverse=True):
        total += row.lines
        if total >= n:
            return row[SALE_MONTH], True
    return None, False


def transaction_search(
    index: SearchIndex,
    term: str = "",
    n: int = LATEST,
    start: date | str | None = None,
    end: date | str | None = None,
    countries: Sequence[str] = (),
) -> DataFrame:
    """As ``reports.transaction_search`` of the filtered sales."""
    lines = filters.filter_sales(_months(index.sales), start, end, countries)
    if not term:  # lines without a description count too
        return reports.transaction_search(lines, "", n)
    found = matching(index, term)
    since, enough = first_month(index, found, n, start, end, countries)
    if enough:
        lines = lines.where(F.col(SALE_MONTH) >= F.lit(since))
    return reports.transaction_search(lines.join(found.select("Description"), "Description", "left_semi"), "", n)
