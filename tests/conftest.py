import os
import sys
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from retailloom.schema import MONEY, RAW, SALES_COLUMNS  # noqa: E402
from retailloom.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # Small inputs would be merged into one partition; the tests want several.
    session = local_session(
        "8",
        shuffle_partitions=6,
        **{
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    yield session
    session.stop()


def day(n, hour=0):
    return datetime(2020, 1 + (n - 1) // 28, 1 + (n - 1) % 28, hour)


@pytest.fixture(scope="session")
def raw_frame(spark):
    def make(rows):
        """Rows as dicts; what is not given takes an ordinary value."""
        default = {
            "Invoice": "1",
            "StockCode": "A",
            "Description": "thing",
            "Quantity": 5,
            "InvoiceDate": day(1),
            "Price": 1,
            "CustomerID": 1,
            "Country": "X",
        }
        full = [{**default, **row} for row in rows]
        table = spark.createDataFrame(
            [tuple(r[c] if c != "Price" else (None if r[c] is None else str(r[c])) for c in RAW.names) for r in full],
            ", ".join(
                f"{f.name} {'string' if f.name == 'Price' else f.dataType.simpleString()}"
                for f in RAW.fields
            ),
        )
        return table.withColumn("Price", table["Price"].cast(RAW["Price"].dataType))

    return make


@pytest.fixture(scope="session")
def sales_frame(raw_frame):
    from pyspark.sql import functions as F

    def make(rows):
        raw = raw_frame(rows)
        return raw.withColumn("Revenue", (F.col("Quantity") * F.col("Price")).cast(MONEY)).select(
            *SALES_COLUMNS
        )

    return make
