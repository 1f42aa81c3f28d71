"""The stored ``sales`` table, result files, and bound-parameter SQL over it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from retailloom.operators import cleaning
from retailloom.schema import PACKED, SALE_MONTH, SALES, SALES_COLUMNS


def _laid_out(sales: DataFrame, gather: bool = True) -> DataFrame:
    """Rows grouped by month for writing; without ``gather`` they stay in the tasks that read them.

    ``rebalance`` lets adaptive execution split a month that is too big for one
    task and merge months that are too small, so no month makes a hot task. Lines that come without
    their revenue get it behind that shuffle.
    """
    month = F.trunc(F.to_date("InvoiceDate"), "month").alias(SALE_MONTH)
    columns = [c for c in SALES_COLUMNS if c in sales.columns or c != "Revenue"]
    rows = sales.select(*columns, month)
    rows = rows.hint("rebalance", SALE_MONTH) if gather else rows
    return rows if "Revenue" in columns else cleaning.priced(rows, SALE_MONTH)


def write_sales(sales: DataFrame, path: str, seen: Observation | None = None) -> None:
    """Replace the table stored at ``path``. ``seen`` takes the figures of the audit, and the lines
    without customer, from the rows as they are written."""
    rows = _laid_out(sales)
    if seen is not None:
        rows = rows.observe(seen, *_audit(), F.count_if(F.col("CustomerID").isNull()).alias("nulls"))
    rows.write.mode("overwrite").options(**PACKED).partitionBy(SALE_MONTH).parquet(path)


def restate_months(sales: DataFrame, path: str, by_month: DataFrame | None = None) -> None:
    """Replace the months that ``sales`` has lines of, and leave all others as they are.

    ``by_month`` are more lines, read from files of one month each; these need no shuffle to keep the files few.
    """
    rows = _laid_out(sales)
    if by_month is not None:
        rows = rows.unionByName(_laid_out(by_month, gather=False))
    rows.write.mode("overwrite").options(
        partitionOverwriteMode="dynamic", **PACKED
    ).partitionBy(SALE_MONTH).parquet(path)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SALES).parquet(path)


def save_sales_table(sales: DataFrame, table: str = "sales") -> None:
    """Drop and recreate a catalog table from ``sales``."""
    _laid_out(sales).write.mode("overwrite").partitionBy(SALE_MONTH).format("parquet").saveAsTable(
        table
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Result files with a heading row, one folder per result."""
    df.write.mode("overwrite").option("header", True).csv(path)


def load_audit(sales: DataFrame) -> DataFrame:
    """Row count, date range and revenue, to check a load."""
    return sales.agg(*_audit())


def _audit() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        F.min("InvoiceDate").alias("first_date"),
        F.max("InvoiceDate").alias("last_date"),
        F.sum("Revenue").alias("revenue"),
    ]


AUDIT = "rows bigint not null, first_date timestamp_ntz, last_date timestamp_ntz, revenue decimal(28,4)"


def observed_audit(stored: dict, spark: SparkSession) -> DataFrame:
    """The audit from what the write has counted."""
    names = [part.split()[0] for part in AUDIT.split(", ")]
    return spark.createDataFrame([[stored[n] for n in names]], AUDIT)


# Quoted text and comments, in which a question mark is no marker, or a marker.
_MARKER = re.compile(
    r"""'(?:[^'\\]|\\.)*' | "(?:[^"\\]|\\.)*" | `[^`]*` | --[^\n]* | /\*.*?\*/ | (?P<marker>\?)""",
    re.VERBOSE | re.DOTALL,
)


def run_query(
    spark: SparkSession, sql: str, params: Sequence = (), sales: DataFrame | None = None
) -> DataFrame:
    """Run SQL over ``sales`` with ``?`` markers bound by position.

    The markers are named before binding: Spark 4.1 assigns a list of five or more
    values to the wrong markers. ``sales`` bears its name only while the text is resolved; a view
    of that name that was there before is there again afterwards. The table is stored by month:
    a range on ``sale_month`` beside one on ``InvoiceDate`` keeps other months closed.
    """
    if sales is None:
        return _bound(spark, sql, params)
    views = [t for t in spark.catalog.listTables() if t.isTemporary and t.name == "sales"]
    before = spark.table("sales") if views else None
    sales.createOrReplaceTempView("sales")
    try:
        return _bound(spark, sql, params)
    finally:
        spark.catalog.dropTempView("sales")
        if before is not None:
            before.createOrReplaceTempView("sales")


def _bound(spark: SparkSession, sql: str, params: Sequence) -> DataFrame:
    if not params:
        return spark.sql(sql)
    position = count()

    def named(match: re.Match) -> str:
        return f":p{next(position)}" if match["marker"] else match[0]

    text = _MARKER.sub(named, sql)
    markers = next(position)
    if markers != len(params):
        raise ValueError(f"{markers} markers for {len(params)} values")
    return spark.sql(text, args={f"p{i}": value for i, value in enumerate(params)})
