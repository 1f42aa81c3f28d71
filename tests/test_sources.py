from datetime import datetime

import pytest
from conftest import day
from pyspark.sql import types as T

from retailloom.operators import cleaning, filters
from retailloom.plans import build
from retailloom.schema import RAW, SALES_COLUMNS
from retailloom.sources import raw as raw_source
from retailloom.sources import warehouse

HEAD = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


def test_csv_sheets_are_stacked(spark, tmp_path):
    (tmp_path / "1.csv").write_text(
        HEAD + "489434,85048,LIGHTS,12,2009-12-01 07:45:00,6.95,13085.0,United Kingdom\n"
    )
    (tmp_path / "2.csv").write_text(
        HEAD + "C489449,22087,,-12,2009-12-01 10:33:00,0.001,,Australia\n"
    )
    raw = raw_source.read_raw(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")], "csv")
    assert [(f.name, f.dataType) for f in raw.schema] == [(f.name, f.dataType) for f in RAW]
    first, second = sorted(raw.collect(), key=lambda r: r.Invoice)
    assert (first.CustomerID, float(first.Price)) == (13085, 6.95)
    assert (second.CustomerID, float(second.Price), second.Description) == (None, 0.001, None)
    assert first.InvoiceDate == datetime(2009, 12, 1, 7, 45)


def test_floating_point_sources(spark):
    nan = float("nan")
    sheet = spark.createDataFrame(
        [("A", 1.5, nan, 489434.0), ("B", nan, 7.0, nan)],
        "StockCode string, Price double, `Customer ID` double, Invoice double",
    ).selectExpr(
        "*", "'d' Description", "2 Quantity", "timestamp_ntz'2020-01-01' InvoiceDate", "'X' Country"
    )
    rows = {r.StockCode: r for r in raw_source.stack([sheet]).collect()}
    assert (float(rows["A"].Price), rows["A"].CustomerID, rows["A"].Invoice) == (1.5, None, "489434")
    assert (rows["B"].Price, rows["B"].CustomerID, rows["B"].Invoice) == (None, 7, None)


def test_load_writes_a_pruned_table(raw_frame, spark, tmp_path):
    raw = raw_frame(
        [
            {"Invoice": "1", "InvoiceDate": datetime(2020, 1, 5)},
            {"Invoice": "2", "InvoiceDate": datetime(2020, 2, 5)},
            {"Invoice": "C3", "InvoiceDate": datetime(2020, 3, 5), "Quantity": -5},
            {"Invoice": "4", "InvoiceDate": None},
        ]
    )
    path = str(tmp_path / "sales")
    for _ in range(2):  # the second load replaces the first
        done = build.load(raw, path)
    assert done.report.first().matched_returns_netted == 1
    audit = done.audit.first()
    assert (audit.rows, audit.first_date, audit.revenue) == (2, datetime(2020, 2, 5), 10)
    sales = done.sales
    assert set(SALES_COLUMNS) <= set(sales.columns)
    one = filters.filter_sales(sales, "2020-02-01", "2020-02-28")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_month" in plan and one.count() == 1
    assert build.build_sales(raw, path).count() == 2


def test_catalog_table_is_replaced(raw_frame, spark):
    sales = cleaning.clean(raw_frame([{"Invoice": "1"}, {"Invoice": "2"}]))
    try:
        for _ in range(2):
            warehouse.save_sales_table(sales, "sales_for_test")
        assert spark.table("sales_for_test").count() == 2
    finally:
        spark.sql("DROP TABLE IF EXISTS sales_for_test")


def test_csv_results(sales_frame, spark, tmp_path):
    path = str(tmp_path / "out")
    warehouse.write_csv(sales_frame([{}]).select("Invoice", "Revenue"), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["Invoice", "Revenue"] and back.count() == 1


def test_bound_parameters(sales_frame, spark):
    sales = sales_frame([{"Invoice": str(i), "Country": c, "InvoiceDate": day(i)} for i, c in enumerate("XYZWV", 1)])
    sql = """
        SELECT Invoice, '?' AS quoted /* ? */ FROM sales -- ?
        WHERE InvoiceDate BETWEEN ? AND ? AND Country IN (?, ?, ?) ORDER BY Invoice"""
    params = ("2020-01-01", "2020-01-04 23:59:59", "X", "Z", "V")
    rows = warehouse.run_query(spark, sql, params, sales).collect()
    assert [tuple(r) for r in rows] == [("1", "?"), ("3", "?")]
    injected = warehouse.run_query(spark, "SELECT * FROM sales WHERE Country = ?", ("X' OR 'a'='a",), sales)
    assert injected.count() == 0
    assert warehouse.run_query(spark, "SELECT * FROM sales", sales=sales).count() == 5
    with pytest.raises(ValueError):
        warehouse.run_query(spark, "SELECT ?", (1, 2))


def test_raw_schema_is_explicit():
    assert isinstance(RAW["InvoiceDate"].dataType, T.TimestampNTZType)


def _sheet(path, text):
    path.write_text(text)
    return str(path)


def test_csv_sheet_with_quotes_and_other_column_order(spark, tmp_path):
    path = _sheet(
        tmp_path / "s.csv",
        "Price,Customer ID,Invoice,StockCode,Description,InvoiceDate,Quantity,Country\n"
        '1.25,7.0,1,A,"SIGN ""BUSY"", BLUE",2009-12-01 07:45:00,3.0,X\n'
        "0.5,,,B,plain,2009-12-02 07:45:00,4,Y\n",
    )
    a, b = sorted(raw_source.read_raw(spark, [path], "csv").collect(), key=lambda r: r.StockCode)
    assert a.Description == 'SIGN "BUSY", BLUE'
    assert (a.Quantity, float(a.Price), a.CustomerID, a.Country) == (3, 1.25, 7, "X")
    assert (b.Invoice, b.CustomerID, b.Quantity) == (None, None, 4)


@pytest.mark.parametrize(
    "line",
    [
        "1,A,d,1,2009-12-01 07:45:00,1.0,5",
        "1,A,d,1,2009-12-01 07:45:00,1.0,5,X,more",
        "1,A,d,1,01/12/2009 07:45,1.0,5,X",
        "1,A,d,1.5,2009-12-01 07:45:00,1.0,5,X",
        "1,A,d,1,2009-12-01 07:45:00,0.00004,5,X",
    ],
    ids=["short", "long", "date", "units", "price"],
)
def test_csv_rows_that_do_not_parse_fail(spark, tmp_path, line):
    path = _sheet(tmp_path / "s.csv", HEAD + line + "\n")
    with pytest.raises(Exception):
        raw_source.read_raw(spark, [path], "csv").collect()


def test_csv_with_other_headings_fails(spark, tmp_path):
    path = _sheet(tmp_path / "s.csv", HEAD.replace("Quantity", "Units") + "1,A,d,1,2009-12-01 07:45:00,1.0,5,X\n")
    with pytest.raises(ValueError):
        raw_source.read_raw(spark, [path], "csv")


def test_a_query_leaves_views_as_they_were(sales_frame, spark):
    spark.range(3).createOrReplaceTempView("sales")
    got = warehouse.run_query(spark, "SELECT COUNT(*) AS n FROM sales", sales=sales_frame([{}]))
    assert got.first()["n"] == 1
    assert spark.table("sales").count() == 3
    spark.catalog.dropTempView("sales")


def test_revenue_does_not_travel_to_the_writers(raw_frame, spark, tmp_path):
    raw = raw_frame([{"Invoice": "1"}, {"Invoice": "2", "Quantity": None}, {"Invoice": "3", "InvoiceDate": None}])
    rows = warehouse._laid_out(cleaning.clean_lines(raw))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Revenue" in plan.split("RebalancePartitions")[0] and "Revenue" not in plan.split("RebalancePartitions")[1]
    warehouse.write_sales(cleaning.clean_lines(raw), str(tmp_path / "sales"))
    stored, plain = warehouse.read_sales(spark, str(tmp_path / "sales")), cleaning.clean(raw)
    assert sorted(map(str, stored.drop("sale_month").collect())) == sorted(map(str, plain.collect()))
