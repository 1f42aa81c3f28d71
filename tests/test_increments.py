"""Batches in any order give the table of one load."""

import os
import random
from datetime import datetime, timedelta

import pytest

from retailloom.operators import cleaning
from retailloom.plans import build, increments
from retailloom.schema import RAW, SALES_COLUMNS


def raw_rows(seed, n=500, start=datetime(2020, 1, 1)):
    """Few keys, so that queues are long, interleaved and tied; copies; missing values."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        when = start + timedelta(days=rng.randrange(200), hours=rng.choice([0, 12]))
        cancel = rng.random() < 0.35
        rows.append(
            {
                "Invoice": rng.choice([None, f"{i}", f"{i % 40}"]) if not cancel else f"C{i % 60}",
                "StockCode": rng.choice(["A", "A", "B", None]),
                "Description": rng.choice(["x", "y", None]),
                "Quantity": rng.choice([1, 2, 2, 2, 0, None]),
                "InvoiceDate": None if rng.random() < 0.03 else when,
                "Price": rng.choice([1, 1, 2, 0, None]),
                "CustomerID": rng.choice([1, 1, 2, None]),
                "Country": rng.choice("XY"),
            }
        )
    return rows + [dict(r) for r in rng.sample(rows, n // 8)]


def whole(df):
    return sorted(map(tuple, df.select(*SALES_COLUMNS).collect()), key=str)


def split(rows, how, rng):
    if how == "in order":
        rows = sorted(rows, key=lambda r: r["InvoiceDate"] or datetime(1900, 1, 1))
    elif how == "backwards":
        rows = sorted(rows, key=lambda r: r["InvoiceDate"] or datetime(1900, 1, 1), reverse=True)
    else:
        rng.shuffle(rows)
    cuts = sorted(rng.sample(range(len(rows)), 3))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


@pytest.mark.parametrize("how", ["in order", "backwards", "mixed"])
def test_batches_give_the_table_of_one_load(raw_frame, spark, tmp_path, how):
    rng = random.Random(how)
    rows = raw_rows(how)
    raw = raw_frame(rows)
    folder = str(tmp_path / "load")
    for some in split(rows, how, rng):
        increments.apply(raw_frame(some), folder)
    one = build.load(raw, str(tmp_path / "one"))
    assert whole(increments.sales(spark, folder)) == whole(one.sales)
    assert increments.report(spark, folder).collect() == one.report.collect()
    assert one.report.first().matched_returns_netted > 10


def test_a_late_sale_gives_another_back(raw_frame, spark, tmp_path):
    folder = str(tmp_path / "load")

    def line(invoice, day):
        return {"Invoice": invoice, "InvoiceDate": datetime(2020, day, 1), "Description": None}

    def invoices():
        return sorted(r.Invoice for r in increments.sales(spark, folder).collect())

    assert increments.apply(raw_frame([line("2", 2), line("9", 9)]), folder)
    assert invoices() == ["2", "9"]
    months = increments.apply(raw_frame([line("C3", 3)]), folder)
    assert invoices() == ["9"] and [m.month for m in months] == [2]
    # February is empty now, and its folder gone.
    assert not [f for f in os.listdir(f"{folder}/sales") if f.endswith("2020-02-01")]
    months = increments.apply(raw_frame([line("1", 1)]), folder)
    assert invoices() == ["2", "9"] and [m.month for m in months] == [1, 2]
    assert increments.apply(raw_frame([line("1", 1), line("2", 2)]), folder) == []
    assert increments.apply(raw_frame([{}]).limit(0), folder) == []
    row = increments.report(spark, folder).first()
    assert (row.rows_in, row.duplicates, row.matched_returns_netted, row.rows_out) == (6, 2, 1, 2)


def test_only_changed_months_are_written(raw_frame, spark, tmp_path):
    folder = str(tmp_path / "load")
    increments.apply(raw_frame([{"Invoice": str(m), "InvoiceDate": datetime(2020, m, 3), "StockCode": f"{m}"} for m in range(1, 9)]), folder)

    def files():
        return {m: sorted(os.listdir(f"{folder}/sales/{m}")) for m in os.listdir(f"{folder}/sales") if "=" in m}

    before = files()
    months = increments.apply(
        raw_frame(
            [
                {"Invoice": "C9", "InvoiceDate": datetime(2020, 9, 3), "StockCode": "4"},
                {"Invoice": "10", "InvoiceDate": datetime(2020, 8, 4), "StockCode": "4"},
            ]
        ),
        folder,
    )
    after = files()
    assert [m.month for m in months] == [4, 8]
    assert {m for m in before if before[m] != after.get(m)} == {"sale_month=2020-04-01", "sale_month=2020-08-01"}


def test_keys_in_order_are_not_matched_anew(raw_frame, spark, tmp_path):
    """Later sales, and returns that find nothing to consume, change the state row alone."""
    folder = str(tmp_path / "load")

    def line(invoice, month):
        return {"Invoice": invoice, "InvoiceDate": datetime(2020, month, 1)}

    increments.apply(raw_frame([line("1", 1), line("C2", 2)]), folder)
    for number, rows in enumerate([[line("C3", 3)], [line("4", 4), line("5", 5)]], 1):
        increments._arrived(raw_frame(rows), folder, number)
        moved, keys = increments._rematched(folder, number, spark)
        assert moved.count() == 1 and keys.count() == 0
        increments._matched(folder, number, spark)
    state = increments._latest_states(spark, folder, 2).first().state
    # The return of March finds no sale, so it is spent for good.
    assert (state.sales, state.cancels, state.slack, state.consumed) == (3, 2, -1, 1)
    increments._arrived(raw_frame([line("C6", 6)]), folder, 3)
    _, keys = increments._rematched(folder, 3, spark)
    assert keys.count() == 1


@pytest.mark.parametrize("cut", ["_matched", "_restated", "counts"])
def test_a_batch_cut_short_is_finished(raw_frame, spark, tmp_path, monkeypatch, cut):
    rows = raw_rows(3, 300)
    first, second = raw_frame(rows[:200]), raw_frame(rows[200:])
    folder = str(tmp_path / "load")
    increments.apply(first, folder, 0)

    def fail(*_, **__):
        raise RuntimeError("cut short")

    with monkeypatch.context() as broken:
        if cut == "counts":
            broken.setattr(cleaning, "line_counts", fail)
        else:
            broken.setattr(increments, cut, fail)
        with pytest.raises(RuntimeError, match="cut short"):
            increments.apply(second, folder, 1)
    increments.apply(second, folder, 1)
    increments.apply(second, folder, 1)
    one = build.load(raw_frame(rows), str(tmp_path / "one"))
    assert whole(increments.sales(spark, folder)) == whole(one.sales)
    assert increments.report(spark, folder).collect() == one.report.collect()


def test_a_stream_of_files(raw_frame, spark, tmp_path):
    rows = raw_rows(4, 240)
    source, folder = str(tmp_path / "in"), str(tmp_path / "load")
    for part in (rows[:100], rows[100:180]):
        raw_frame(part).coalesce(1).write.mode("append").parquet(source)

    def run():
        raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(source)
        increments.stream(raw, folder, str(tmp_path / "checkpoint")).awaitTermination()

    run()
    raw_frame(rows[180:]).coalesce(1).write.mode("append").parquet(source)
    run()
    assert len(increments._batches(spark, folder, "counts")) == 3
    one = build.load(raw_frame(rows), str(tmp_path / "one"))
    assert whole(increments.sales(spark, folder)) == whole(one.sales)


@pytest.mark.parametrize("cut_at", [1, None])
def test_compaction_changes_nothing(raw_frame, spark, tmp_path, monkeypatch, cut_at):
    rows = raw_rows(5, 320)
    folder = str(tmp_path / "load")
    for a, b in ((0, 120), (120, 200)):
        increments.apply(raw_frame(rows[a:b]), folder)
    before, report = whole(increments.sales(spark, folder)), increments.report(spark, folder).collect()
    real, renamed = increments._rename, []

    def rename(session, old, new):
        if len(renamed) == cut_at:
            raise RuntimeError("cut short")
        renamed.append(new)
        real(session, old, new)

    monkeypatch.setattr(increments, "_rename", rename)
    if cut_at is None:
        increments.compact(spark, folder)
    else:
        with pytest.raises(RuntimeError, match="cut short"):
            increments.compact(spark, folder)
        monkeypatch.setattr(increments, "_rename", real)
        increments._finish_compaction(spark, folder)
    for part in increments.STORED:
        assert increments._batches(spark, folder, part) == [1]
    assert whole(increments.sales(spark, folder)) == before
    assert increments.report(spark, folder).collect() == report
    assert not [n for n in os.listdir(folder) if n.startswith("compacted")]
    increments.apply(raw_frame(rows[200:]), folder)
    one = build.load(raw_frame(rows), str(tmp_path / "one"))
    assert whole(increments.sales(spark, folder)) == whole(one.sales)
    assert increments.report(spark, folder).collect() == one.report.collect()


def test_lines_beyond_the_netted_ones_are_not_shuffled(raw_frame, spark, tmp_path):
    lines = cleaning.distinct_lines(cleaning.valid_lines(raw_frame(raw_rows("open")))).select("line.*")
    lines.write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    events.where("Quantity = 1").select(cleaning.whole_line()).write.parquet(str(tmp_path / "netted"))
    netted = spark.read.parquet(str(tmp_path / "netted"))
    beyond, left = increments._open_lines(events, netted)
    kept = sorted(map(tuple, beyond.unionByName(left).collect()), key=str)
    assert kept == sorted(map(tuple, events.where("NOT Quantity <=> 1").collect()), key=str)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    # The bitmap comes first: its join lies below the one with the netted lines.
    assert plan.index("Join LeftOuter") < plan.index("Join Inner")


def test_a_month_whose_lines_are_all_netted_goes(raw_frame, spark, tmp_path):
    folder, day = str(tmp_path / "load"), datetime(2020, 1, 5)
    sale = {"Invoice": "1", "StockCode": "A", "Quantity": 2, "CustomerID": 1, "Price": 1, "InvoiceDate": day}
    later = {**sale, "Invoice": "2", "StockCode": "B", "InvoiceDate": datetime(2020, 2, 5)}
    increments.apply(raw_frame([sale, later]), folder)
    back = {**sale, "Invoice": "C1", "Quantity": -2, "InvoiceDate": datetime(2020, 3, 1)}
    increments.apply(raw_frame([back]), folder)
    assert [r.Invoice for r in increments.sales(spark, folder).collect()] == ["2"]
