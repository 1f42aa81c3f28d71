from datetime import datetime
from decimal import Decimal

import pytest
from conftest import day

from retailloom.operators import filters, series
from retailloom.plans import reports


def month(n, **more):
    return {"InvoiceDate": datetime(2019 + (n - 1) // 12, (n - 1) % 12 + 1, 15), **more}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def gapped(sales_frame):
    """Months 1..14 without month 5; revenue 5 times the month, and nothing in month 8."""
    return sales_frame(
        [month(n, Price=n if n != 8 else 0) for n in range(1, 15) if n != 5]
    )


def test_running_total(gapped):
    rows = rows_of(reports.monthly_trend(gapped))
    total = 0
    for row in rows:
        total += row["monthly_revenue"]
        assert row["running_total_revenue"] == total and row["orders"] == 1
    assert len(rows) == 13


def test_lag_counts_rows(gapped):
    rows = {r["month"].month + 12 * (r["month"].year - 2019): r for r in rows_of(reports.growth(gapped))}
    assert rows[6]["prev_month_revenue"] == 20 and rows[6]["mom_growth_pct"] == 50.0
    assert rows[1]["prev_month_revenue"] is None and rows[1]["mom_growth_pct"] is None
    # Twelve rows back from month 14 is month 1, because month 5 is missing.
    assert rows[14]["same_month_last_year"] == 5 and rows[13]["same_month_last_year"] is None
    assert rows[9]["prev_month_revenue"] == 0 and rows[9]["mom_growth_pct"] is None


def test_lag_by_calendar(gapped):
    rows = {
        r["month"].month + 12 * (r["month"].year - 2019): r
        for r in rows_of(reports.growth(gapped, mode=series.CALENDAR))
    }
    assert rows[6]["prev_month_revenue"] is None
    assert rows[14]["same_month_last_year"] == 10 and rows[13]["same_month_last_year"] == 5


def test_growth_tile(gapped):
    rows = rows_of(reports.growth_tile(gapped))
    assert list(rows[0]) == ["Month", "Revenue (£)", "MoM %", "YoY %"]
    assert rows[0]["Month"] == "2020-02" and rows[-1]["Month"] == "2019-01"


def test_ties_share_a_rank_and_unnamed_products_stay_out(sales_frame):
    rows = [{"Invoice": str(i), "Description": f"p{i}", "Price": 10 - min(i, 4)} for i in range(6)]
    rows += [{"Invoice": "9", "Description": None, "Price": 100}]
    rows += [{"Invoice": "10", "Country": "Small", "Description": "q", "Price": 1}]
    found = rows_of(reports.top_products_by_country(sales_frame(rows), markets=1))
    assert [(r["product"], r["rank_in_country"]) for r in found] == [
        ("p0", 1), ("p1", 2), ("p2", 3), ("p3", 4), ("p4", 5), ("p5", 5)
    ]
    # The market is chosen with the unnamed revenue, the shares are without it.
    assert {r["Country"] for r in found} == {"X"}
    # 10 of 10+9+8+7+6+6.
    assert found[0]["pct_of_country_revenue"] == 21.74


def test_top_products_reads_the_sales_once(sales_frame, spark, tmp_path):
    path = str(tmp_path / "s")
    sales_frame([{"Country": c} for c in "XYZ"]).write.parquet(path)
    df = reports.top_products_by_country(spark.read.parquet(path))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_includes_the_last_second(sales_frame):
    sales = sales_frame(
        [
            {"Invoice": "in", "InvoiceDate": datetime(2020, 1, 2, 23, 59, 59)},
            {"Invoice": "fraction", "InvoiceDate": datetime(2020, 1, 2, 23, 59, 59, 500000)},
            {"Invoice": "out", "InvoiceDate": datetime(2020, 1, 3)},
            {"Invoice": "first", "InvoiceDate": datetime(2020, 1, 1)},
        ]
    )
    kept = filters.filter_sales(sales, "2020-01-01", "2020-01-02").collect()
    assert {r.Invoice for r in kept} == {"in", "first"}
    with pytest.raises(ValueError):
        filters.filter_sales(sales, datetime(2020, 1, 1, 9), "2020-01-02")
    with pytest.raises(ValueError):
        filters.filter_sales(sales, "2020-01-01 09:00:00", "2020-01-02")
    same = filters.filter_sales(sales, datetime(2020, 1, 1).date(), datetime(2020, 1, 2).date())
    assert {r.Invoice for r in same.collect()} == {"in", "first"}
    assert filters.filter_sales(sales, "2020-01-01", None).count() == 4
    assert filters.filter_sales(sales, countries=[]).count() == 4
    assert filters.filter_sales(sales, countries=["nowhere"]).count() == 0


def test_filter_that_matches_nothing(sales_frame):
    row = reports.kpis(filters.filter_sales(sales_frame([{}]), countries=["nowhere"])).first()
    assert row.asDict() == {"revenue": None, "orders": 0, "avg_order_value": None, "customers": 0}


def test_kpis(sales_frame):
    sales = sales_frame([{"Invoice": "1"}, {"Invoice": "1", "CustomerID": None}, {"Invoice": "2"}])
    row = reports.kpis(sales).first()
    assert (row.revenue, row.orders, row.avg_order_value, row.customers) == (15, 2, 7.5, 1)


def test_search_wildcards(sales_frame):
    sales = sales_frame([{"Description": d} for d in ("Red Bolt", "red nut", "100% wool", None)])

    def found(term):
        return {r.Description for r in reports.transaction_search(sales, term).collect()}

    assert found("RED") == {"Red Bolt", "red nut"}
    assert found("r_d b") == {"Red Bolt"}
    assert found("%") == {"Red Bolt", "red nut", "100% wool"}
    assert found("") == {"Red Bolt", "red nut", "100% wool", None}


def test_search_returns_the_latest(sales_frame):
    sales = sales_frame([{"Invoice": str(i), "InvoiceDate": day(i)} for i in range(1, 30)])
    rows = reports.transaction_search(sales, n=3).collect()
    assert [r.Invoice for r in rows] == ["29", "28", "27"]


def test_market_reports(sales_frame):
    sales = sales_frame([{"Country": "A", "Price": 3}, {"Country": "B"}, {"Country": None}])
    assert [r.Country for r in reports.filter_countries(sales).collect()] == ["A", "B", None]
    assert [r.share_pct for r in reports.market_share(sales).collect()] == [60.0, 20.0, 20.0]
    assert reports.top_market(sales).first().Country == "A"
    chart = reports.chart_order(reports.top_markets(sales, 2), "Country").collect()
    assert [r.Country for r in chart] == ["B", "A"]


def test_like_for_like(sales_frame):
    sales = sales_frame(
        [
            {"InvoiceDate": datetime(2010, 11, 30), "Price": 2},
            {"InvoiceDate": datetime(2011, 11, 30), "Price": 3},
            {"InvoiceDate": datetime(2011, 12, 1), "Price": 50},
            {"InvoiceDate": datetime(2009, 1, 1), "Price": 50},
        ]
    )
    assert reports.like_for_like(sales, 2011).first().asDict() == {
        "revenue": Decimal(15), "revenue_before": Decimal(10), "growth_pct": 50.0
    }


def test_service_lines(sales_frame):
    sales = sales_frame([{"Description": "POSTAGE", "Price": 9}, {"Country": "Y"}])
    rows = {r.Country: r.is_service_line for r in reports.service_line_leaders(sales).collect()}
    assert rows == {"X": True, "Y": False}


def test_other_reports(sales_frame):
    sales = sales_frame([{"CustomerID": None}, {}, {}, {"InvoiceDate": datetime(2020, 1, 4)}])
    assert reports.null_customer_share(sales).first().share_pct == 25.0
    assert [(r.weekday, r.trading_days) for r in reports.weekday_profile(sales).collect()] == [
        (3, 1), (6, 1)
    ]


def test_a_backslash_is_searched_as_itself(sales_frame):
    sales = sales_frame([{"Description": d} for d in ("a\\b", "ab", "50%", "50\\x")])

    def found(term):
        return sorted(r.Description for r in filters.search_description(sales, term).collect())

    assert found("a\\b") == ["a\\b"]
    assert found("50\\%") == ["50\\x"]


def test_markets_of_equal_revenue_are_chosen_by_name(sales_frame):
    sales = sales_frame(
        [{"Country": "B", "Quantity": 10, "Price": 1}, {"Country": "A", "Quantity": 1, "Price": 10}]
    )
    assert {r.Country for r in reports.top_products_by_country(sales, markets=1).collect()} == {"A"}
