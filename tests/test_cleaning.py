from conftest import day

from retailloom.operators import cleaning


def test_missing_values_are_kept(raw_frame):
    raw = raw_frame(
        [
            {"Invoice": "1", "Price": None},
            {"Invoice": None, "Quantity": 3},
            {"Invoice": "c123"},
            {"Invoice": "2", "Quantity": None},
        ]
    )
    rows = {r.Invoice: r for r in cleaning.clean(raw).collect()}
    assert set(rows) == {"1", "nan", "c123", "2"}
    assert rows["1"].Revenue is None and rows["2"].Revenue is None
    assert rows["nan"].Revenue == 3


def test_bad_values_are_dropped(raw_frame):
    raw = raw_frame(
        [
            {"Invoice": "1", "Quantity": 0},
            {"Invoice": "2", "Price": 0},
            {"Invoice": "3", "Quantity": -1, "Price": -1},
            {"Invoice": "4", "Price": "0.001"},
        ]
    )
    kept = cleaning.clean(raw).collect()
    assert [(r.Invoice, float(r.Revenue)) for r in kept] == [("4", 0.005)]


def test_duplicates_compare_every_column_and_missing_as_equal(raw_frame):
    raw = raw_frame(
        [
            {"Description": None},
            {"Description": None},
            {"CustomerID": None},
            {"CustomerID": 1},
            {"Country": "Y"},
        ]
    )
    assert cleaning.clean(raw).count() == 4


def test_report_reconciles(raw_frame):
    raw = raw_frame(
        [
            {"Invoice": "1"},
            {"Invoice": "1"},
            {"Invoice": "2", "Quantity": -1, "Price": 0},
            {"Invoice": "3", "Price": 0},
            {"Invoice": "4", "CustomerID": None},
            {"Invoice": "5", "InvoiceDate": day(2)},
            {"Invoice": "C6", "InvoiceDate": day(3), "Quantity": -5},
            {"Invoice": "C7", "InvoiceDate": day(3), "Quantity": -9, "Price": 0},
        ]
    )
    expected = {
        "rows_in": 8,
        "cancelled": 2,
        "non_positive_qty": 1,
        "non_positive_price": 2,
        "duplicates": 1,
        "matched_returns_netted": 1,
        "null_customer_id": 1,
        "rows_out": 2,
        "kept_pct": 25.0,
    }
    sales = cleaning.clean(raw)
    assert sales.count() == 2
    assert cleaning.cleaning_report(raw).first().asDict() == expected
    assert cleaning.cleaning_report(raw, sales=sales).first().asDict() == expected


def test_empty_input(raw_frame, spark):
    raw = raw_frame([{}]).limit(0)
    row = cleaning.cleaning_report(raw).first()
    assert (row.rows_in, row.rows_out, row.kept_pct) == (0, 0, None)
    assert cleaning.clean(raw).count() == 0


def test_big_side_is_shuffled_once(raw_frame, spark):
    """Too big to broadcast, the anti-join reuses the placement made by the duplicate removal."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        sales = cleaning.clean(raw_frame([{}, {"Invoice": "C1", "Quantity": -5}]))
        lines = sales._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set(name, before)
    join = next(i for i, line in enumerate(lines) if "LeftAnti" in line)
    between = []
    for line in lines[join + 1 :]:
        if "HashAggregate" in line:
            break
        between.append(line)
    assert not any("Exchange" in line for line in between), between
