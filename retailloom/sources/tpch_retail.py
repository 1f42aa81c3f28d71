"""Shape the order/line-item test tables into raw retail invoice lines.

Every line gives a sale, except returned lines that are still open; every returned
line gives a cancellation. Lines with neither discount nor tax are priced zero,
which exercises the value rules. Two overlapping sheets come out, so that the
overlap holds exact duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailloom.schema import PACKED, PRICE, RAW_COLUMNS
from retailloom.session import materialise

FIRST_SHEET_ENDS = "1998-06-01 00:00:00"
SECOND_SHEET_STARTS = "1998-05-01 00:00:00"


def lines_by_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw lines with the number of the sheet they stand on, in one pass."""

    def table(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    part = table("part").select(
        "p_partkey",
        F.col("p_brand").alias("StockCode"),
        F.when(F.col("p_size") != 1, F.col("p_name")).alias("Description"),
        F.col("p_retailprice").cast(PRICE).alias("Price"),
    )
    # What the joins move is as narrow as it can be.
    lines = table("lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_shipdate",
        F.col("l_quantity").cast("int").alias("units"),
        ((F.col("l_discount") == 0) & (F.col("l_tax") == 0)).alias("free"),
        (F.col("l_linenumber") == 1).alias("first_line"),
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_linestatus") == "O").alias("open"),
    )
    orders = table("orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderpriority") != "5-LOW").alias("named")
    )
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    is_sale = F.col("is_sale")
    free, returned, units = F.col("free"), F.col("returned"), F.col("units")
    order = F.col("l_orderkey").cast("string")
    hours = F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 24).cast("int"))
    at = F.col("InvoiceDate")
    ends, starts = (
        F.lit(text).cast("timestamp_ntz") for text in (FIRST_SHEET_ENDS, SECOND_SHEET_STARTS)
    )
    return (
        joined.withColumn("is_sale", F.explode(F.array(F.lit(True), F.lit(False))))
        .where(F.when(is_sale, ~(returned & F.col("open"))).otherwise(returned))
        .select(
            F.when(is_sale, order).otherwise(F.concat(F.lit("C"), order)).alias("Invoice"),
            "StockCode",
            "Description",
            F.when(is_sale & ~(free & F.col("first_line")), units)
            .otherwise(-units)
            .alias("Quantity"),
            F.when(is_sale, F.col("o_orderdate") + hours)
            .otherwise(F.col("l_shipdate"))
            .alias("InvoiceDate"),
            F.when(free, F.lit(0).cast(PRICE)).otherwise(F.col("Price")).alias("Price"),
            F.when(F.col("named"), F.col("o_custkey")).alias("CustomerID"),
            F.col("n_name").alias("Country"),
        )
        .withColumn("sheet", F.explode(F.array(F.lit(1), F.lit(2))))
        .where(F.when(F.col("sheet") == 1, at < ends).otherwise(at >= starts))
        .select(*RAW_COLUMNS, "sheet")
    )


def sheets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The two sheets, exported once to the shared folder."""
    exported = materialise(lines_by_sheet(spark, sf_dir), "raw-lines", partition_by=("sheet",), **PACKED)
    return [exported.where(F.col("sheet") == n).drop("sheet") for n in (1, 2)]
