"""A copy of the sales laid out by customer, for reports that group by customer.

Lines with a customer are stored in buckets by customer, so such a report reads each bucket in a task
and aggregates there: no line is shuffled again, however often it is asked. A file of a bucket is
not split, so customers with more lines than ``large`` (wholesale accounts may hold a third of all) do not go
into buckets but into a plain table beside them. Their lines are summed where they are read, and only
sums are shuffled. Without such customers there is no second table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailloom.operators import rfm
from retailloom.schema import SALES, SALES_COLUMNS
from retailloom.session import materialise

BUCKETS = 64
LARGE = 5_000_000  # lines of a customer
KEY, ORDER = "CustomerID", ("CustomerID", "Invoice")


@dataclass
class ByCustomer:
    sales: DataFrame  # all lines, in their usual layout
    bucketed: DataFrame
    large: DataFrame | None


def _columns() -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SALES if f.name in SALES_COLUMNS)


def _register(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    spark.sql(
        f"CREATE TABLE `{table}` ({_columns()}) USING parquet CLUSTERED BY ({KEY})"
        f" SORTED BY ({', '.join(ORDER)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def write(
    sales: DataFrame, folder: str, table: str = "sales_by_customer", buckets: int = BUCKETS, large: int = LARGE
) -> ByCustomer:
    """Store the copy below ``folder``, which must be new, and name its buckets ``table`` in the catalog."""
    spark = sales.sparkSession
    named = sales.where(F.col(KEY).isNotNull()).select(*SALES_COLUMNS)
    counts = named.groupBy(KEY).agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") > large)
    # Stored: few rows, of which the optimizer then knows the size.
    heavy = materialise(counts.select(KEY), "large-customers")
    regular = named
    if not heavy.isEmpty():
        regular = named.join(heavy, KEY, "left_anti").select(*SALES_COLUMNS)
        # Not by customer: one of them is to be many tasks.
        named.join(heavy, KEY, "left_semi").select(*SALES_COLUMNS).write.parquet(f"{folder}/large")
    # Dealt as the buckets are, so that each gets one file.
    dealt = regular.repartition(buckets, KEY)
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    dealt.write.bucketBy(buckets, KEY).sortBy(*ORDER).format("parquet").option(
        "path", f"{folder}/buckets-{buckets}"
    ).saveAsTable(table)
    return read(spark, folder, sales, table, buckets)


def read(
    spark: SparkSession, folder: str, sales: DataFrame, table: str = "sales_by_customer", buckets: int = BUCKETS
) -> ByCustomer:
    """The copy that is stored below ``folder``, in this or another session."""
    bucketed = _register(spark, table, f"{folder}/buckets-{buckets}", buckets)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/large")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    large = spark.read.parquet(f"{folder}/large") if system.exists(where) else None
    return ByCustomer(sales, bucketed, large)


def customers(copy: ByCustomer) -> DataFrame:
    """As ``rfm.rfm`` of the sales."""
    as_of = rfm.as_of(copy.sales)
    found = rfm.rfm(copy.bucketed, as_of)
    return found if copy.large is None else found.unionByName(rfm.rfm(copy.large, as_of))
