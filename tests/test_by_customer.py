"""The copy by customer: same results, no shuffle of lines."""

import random
import re
from datetime import datetime

import pytest

from retailloom.operators import rfm
from retailloom.plans import segmentation
from retailloom.sources import by_customer, warehouse


@pytest.fixture(scope="module")
def stored(sales_frame, spark, tmp_path_factory):
    rng = random.Random(21)
    rows = [
        {
            "Invoice": str(rng.randrange(300)),
            "CustomerID": rng.choice([None, 7, 7, 7, rng.randrange(100)]),
            "InvoiceDate": datetime(2020, rng.randint(1, 12), rng.randint(1, 28)),
            "Price": rng.choice([1, 2.5]),
        }
        for _ in range(2000)
    ]
    folder = tmp_path_factory.mktemp("customers")
    warehouse.write_sales(sales_frame(rows), str(folder / "sales"))
    return warehouse.read_sales(spark, str(folder / "sales")), folder


def in_order(df):
    return sorted(df.collect())


@pytest.mark.parametrize("large", [5_000_000, 500, 10])
def test_like_rfm_of_the_sales(stored, spark, large):
    sales, folder = stored
    path, table = str(folder / f"copy-{large}"), f"by_customer_{large}"
    copy = by_customer.write(sales, path, table, buckets=5, large=large)
    assert (copy.large is None) == (large > 2000)
    assert in_order(by_customer.customers(copy)) == in_order(rfm.rfm(sales))
    if large == 500:
        assert {r.CustomerID for r in copy.large.select("CustomerID").distinct().collect()} == {7}
    # Found again by its folder.
    again = by_customer.read(spark, path, sales, table, 5)
    assert in_order(by_customer.customers(again)) == in_order(rfm.rfm(sales))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_line_is_shuffled(stored):
    """The only exchange belongs to the day to count from, a scalar of its own."""
    sales, folder = stored
    copy = by_customer.write(sales, str(folder / "plan"), "by_customer_plan", buckets=5)

    def above(df):  # branches of subqueries begin with a colon
        return [line for line in plan_of(df).splitlines() if not re.match(r"\s*:", line)]

    assert any("Exchange" in line for line in above(rfm.rfm(sales)))
    plan = above(by_customer.customers(copy))
    assert not any("Exchange" in line for line in plan) and any("Bucketed: true" in line for line in plan)


def test_segments_from_the_copy(stored):
    sales, folder = stored
    copy = by_customer.write(sales, str(folder / "segments"), "by_customer_segments", buckets=3)
    found = segmentation.search(by_customer.customers(copy), ks=(2, 3), restarts=2)
    want = segmentation.search(rfm.rfm(sales), ks=(2, 3), restarts=2)
    assert [f.inertia for f in found.fits] == pytest.approx([f.inertia for f in want.fits])


def test_no_customers_at_all(stored):
    sales, folder = stored
    none = sales.where("CustomerID IS NULL")
    copy = by_customer.write(none, str(folder / "none"), "by_customer_none", buckets=2)
    assert by_customer.customers(copy).count() == 0
