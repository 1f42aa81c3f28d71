"""Raw invoice lines: any number of equally shaped sheets stacked into one frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailloom.schema import RAW, RAW_CUSTOMER_HEADING


def conform(sheet: DataFrame) -> DataFrame:
    """Rename the customer heading and cast every column to the raw schema.

    NaN in a floating-point source means missing, so it becomes null first. A price that the
    stored scale cannot hold fails the job, for rounding it could drop or merge lines.
    """
    sheet = sheet.withColumnRenamed(RAW_CUSTOMER_HEADING, "CustomerID")
    types = {f.name: f.dataType for f in sheet.schema.fields}

    def column(field: T.StructField):
        col = F.col(field.name)
        if isinstance(types[field.name], (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(col), col)
            if field.name in ("Invoice", "StockCode"):
                # A numeric code column with gaps is read as floating point.
                col = F.when(col == F.floor(col), col.cast("long").cast("string")).otherwise(
                    col.cast("string")
                )
        if field.name == "Price":
            kept = col.cast(field.dataType)
            exact = F.isnull(col) | (kept.cast(types["Price"]) == col)
            col = F.when(exact, kept).otherwise(
                F.raise_error(F.concat(F.lit("price beyond four decimals: "), col.cast("string")))
            )
        return col.cast(field.dataType).alias(field.name)

    return sheet.select(*[column(f) for f in RAW.fields])


def stack(sheets: Sequence[DataFrame]) -> DataFrame:
    """Bag union of the sheets, matched by column name."""
    return reduce(DataFrame.unionByName, [conform(s) for s in sheets])


def _whole(text: Column, name: str) -> Column:
    """A whole number, also when written like 3.0."""
    return _checked(text, text.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_extract(text, r"^([+-]?[0-9]+)", 1), name)


def _checked(text: Column, fits: Column, value: Column, name: str) -> Column:
    message = F.concat(F.lit(f"{name} does not parse: "), text)
    return F.when(text.isNull(), None).when(fits, value).otherwise(F.raise_error(message))


def _headings(spark: SparkSession, path: str, options: dict) -> list[str]:
    """The file's own headings, checked against what a sheet must have."""
    heading = spark.read.options(**options).option("header", True).csv(path).columns
    found = ["CustomerID" if h == RAW_CUSTOMER_HEADING else h for h in heading]
    if sorted(found) != sorted(RAW.names):
        raise ValueError(f"the headings of {path} are {heading}")
    return found


def read_csv_sheet(
    spark: SparkSession,
    path: str,
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
    multi_line: bool = False,
) -> DataFrame:
    """One sheet exported as CSV, columns in any order, by their headings.

    Quotes inside quoted text are doubled, as spreadsheets write them. Every value is read as text
    and must parse; a row with too few or too many fields fails the job. An empty field is missing.
    ``multi_line`` allows line breaks inside quotes, but such a file is read by one task.
    """
    options = {"quote": '"', "escape": '"', "multiLine": multi_line, "enforceSchema": False}
    names = _headings(spark, path, options)
    schema = T.StructType([T.StructField(n if n != "CustomerID" else RAW_CUSTOMER_HEADING, T.StringType()) for n in names])
    text = spark.read.schema(schema).options(**options, mode="FAILFAST", header=True).csv(path)
    text = text.toDF(*names)
    at = F.try_to_timestamp("InvoiceDate", F.lit(timestamp_format)).cast("timestamp_ntz")
    price = F.expr("try_cast(Price AS DECIMAL(38, 18))")
    return text.select(
        "Invoice",
        "StockCode",
        "Description",
        _whole(F.col("Quantity"), "Quantity").cast("int").alias("Quantity"),
        _checked(F.col("InvoiceDate"), at.isNotNull(), at, "InvoiceDate").alias("InvoiceDate"),
        _checked(F.col("Price"), price.isNotNull(), price, "Price").alias("Price"),
        _whole(F.col("CustomerID"), "CustomerID").cast("long").alias("CustomerID"),
        "Country",
    )


def read_sheet(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """One exported sheet."""
    if fmt == "csv":
        return read_csv_sheet(spark, path, **options)
    return spark.read.format(fmt).load(path)


def read_raw(
    spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options
) -> DataFrame:
    return stack([read_sheet(spark, p, fmt, **options) for p in paths])
