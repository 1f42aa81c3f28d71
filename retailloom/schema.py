"""Schemas and fixed values shared by every module."""

from pyspark.sql import types as T

# Published totals have three decimals, so prices keep four. Decimal sums are exact and do not
# depend on the partitioning.
PRICE = T.DecimalType(12, 4)
MONEY = T.DecimalType(18, 4)

RAW = T.StructType(
    [
        T.StructField("Invoice", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("Price", PRICE),
        T.StructField("CustomerID", T.LongType()),
        T.StructField("Country", T.StringType()),
    ]
)
RAW_COLUMNS = RAW.fieldNames()

# Raw exports head the customer column with a space.
RAW_CUSTOMER_HEADING = "Customer ID"

# Physical partition column of the stored table; not part of the logical row.
SALE_MONTH = "sale_month"
SALES = T.StructType(
    [*RAW.fields, T.StructField("Revenue", MONEY), T.StructField(SALE_MONTH, T.DateType())]
)
SALES_COLUMNS = [*RAW_COLUMNS, "Revenue"]

# What a return must share with the sale it reverses.
MATCH_KEY = ["CustomerID", "StockCode", "Quantity"]

# Descriptions that are charges or adjustments, not products.
SERVICE_LINES = ("POSTAGE", "DOTCOM POSTAGE", "Manual", "CARRIAGE")

# The four segment names.
CHAMPIONS = "Champions - recent and high value"
NEW_LOW = "New / low-engagement - recent but small"
AT_RISK = "At risk - valuable but slipping away"
DORMANT = "Dormant - inactive and low value"

# How whole lines are stored: a third smaller than by Spark's own choice.
PACKED = {"compression": "zstd"}
