"""Counts of distinct orders and customers from bitmaps, against counts over the lines."""

import random
import shutil
from datetime import datetime, timedelta

import pytest

from retailloom.operators import filters, rollup
from retailloom.plans import reports
from retailloom.sources import warehouse


@pytest.fixture(scope="module")
def stored(sales_frame, spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for i in range(3000):
        order = rng.randrange(700)
        rows.append(
            {
                # Some orders are spread over months and countries, some customers too.
                "Invoice": f"{order}",
                "InvoiceDate": datetime(2020, 1, 1) + timedelta(days=(order * 3 + rng.randrange(40)) % 500, seconds=rng.randrange(86400)),
                "CustomerID": rng.choice([None, order % 90, rng.randrange(90)]),
                "Country": rng.choice(["X", "X", "X", "Y", "Z"]),
                "Price": rng.choice([1, 2.5, None]),
            }
        )
    rows += [{"Invoice": "late", "InvoiceDate": datetime(2020, 3, 31, 23, 59, 59, 500_000), "CustomerID": 5000}]
    rows += [{"Invoice": "undated", "InvoiceDate": None, "CustomerID": 5001}, {"Invoice": "1", "InvoiceDate": None}]
    path = str(tmp_path_factory.mktemp("rollup") / "sales")
    warehouse.write_sales(sales_frame(rows), path)
    sales = warehouse.read_sales(spark, path)
    return sales, rollup.build(sales, path + "-rollup"), path


RANGES = [
    (None, None), ("2020-02-01", "2020-03-31"), ("2020-02-10", "2020-02-20"), ("2020-01-15", "2021-01-31"), ("2020-03-31", "2020-03-31"),
    ("2020-05-01", "2020-05-31"), ("2020-04-02", "2020-06-01"), ("2021-05-01", "2020-05-31"), ("2030-01-01", "2030-12-31"),
]


@pytest.mark.parametrize("start,end", RANGES)
@pytest.mark.parametrize("countries", [(), ("X", "Z")])
def test_like_counts_over_lines(stored, start, end, countries):
    sales, made, _ = stored
    lines = filters.filter_sales(sales, start, end, countries)
    found = rollup.kpis(made, start, end, countries)
    assert found.collect() == reports.kpis(lines).collect()
    assert rollup.monthly_trend(made, start, end, countries).collect() == reports.monthly_trend(lines).collect()
    assert found.dtypes[1:] == reports.kpis(lines).dtypes[1:]


def test_only_the_cut_months_are_read(stored, spark, tmp_path):
    """With the files of all other months torn the result stays."""
    sales, made, path = stored
    copy = tmp_path / "sales"
    shutil.copytree(path, copy)
    for folder in copy.glob("sale_month=*"):
        if folder.name not in ("sale_month=2020-02-01", "sale_month=2020-11-01"):
            for part in folder.glob("part-*"):
                part.write_bytes(b"torn")
    torn = rollup.read(spark, path + "-rollup", warehouse.read_sales(spark, str(copy)))
    want = reports.kpis(filters.filter_sales(sales, "2020-02-10", "2020-11-20")).collect()
    assert rollup.kpis(torn, "2020-02-10", "2020-11-20").collect() == want
    with pytest.raises(Exception):
        rollup.kpis(torn, "2020-03-10", "2020-11-20").collect()


def test_no_lines_at_all(stored):
    sales, _, path = stored
    none = rollup.build(sales.limit(0), path + "-empty")
    for bounds in ((None, None), ("2020-02-10", "2020-05-20")):
        assert rollup.kpis(none, *bounds).collect() == reports.kpis(sales.limit(0)).collect()
        assert rollup.monthly_trend(none, *bounds).count() == 0


def test_members_of_a_month_share_bitmaps(stored):
    """Numbers follow month and country, so a (month, country) has at most a bitmap for each of the six
    partitions that gave numbers, and most have fewer."""
    _, made, _ = stored
    groups = made.bitmaps.select("sale_month", "Country", "kind").distinct().count()
    assert made.bitmaps.count() < 5 * groups
    for kind in rollup.MEMBERS:
        numbers = made.numbers[kind].select("member", "number").distinct()
        assert numbers.count() == numbers.select("number").distinct().count() == numbers.select("member").distinct().count()


def test_members_are_numbered_without_a_join(stored):
    """Distinct places, gathered by member, ordered by range; places and numbers stand in one row."""
    sales = stored[0]
    for column in rollup.MEMBERS.values():
        numbered = rollup._numbered(sales, column)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 3 and "Join" not in plan
        rows = numbered.collect()
        assert len({r.number for r in rows}) == len({r.member for r in rows}) == len(rows)
        found = {(r.member, p.sale_month, p.Country) for r in rows for p in r.places}
        lines = sales.where(f"{column} IS NOT NULL").select(column, "sale_month", "Country").distinct().collect()
        assert found == {tuple(r) for r in lines} and sum(len(r.places) for r in rows) == len(found)
