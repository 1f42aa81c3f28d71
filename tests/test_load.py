"""The load counts as it goes."""

import random
import re

import pytest
from conftest import day
from pyspark.sql import Observation

from retailloom.operators import cleaning
from retailloom.plans import build
from retailloom.sources import warehouse


def raw_lines(raw_frame, n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        rows.append(
            {
                "Invoice": rng.choice([None, f"C{i % 50}", f"{i % 90}", f"{i % 90}", f"{i % 90}"]),
                "StockCode": rng.choice("AB"),
                "Quantity": rng.choice([None, -2, 0, 1, 2, 3, 3, 3]),
                "InvoiceDate": day(rng.randint(1, 80)),
                "Price": rng.choice([None, -1, 0, 1, 2, 2.5]),
                "CustomerID": rng.choice([None, 1, 2, 3]),
            }
        )
    return raw_frame(rows + rows[:60]).repartition(4)


@pytest.fixture
def stored_raw(raw_frame, spark, tmp_path):
    raw_lines(raw_frame).write.parquet(str(tmp_path / "raw"))
    return spark.read.parquet(str(tmp_path / "raw"))


def test_report_and_audit_like_scans(stored_raw, spark, tmp_path):
    done = build.load(stored_raw, str(tmp_path / "sales"))
    matches = cleaning.match_returns(stored_raw)
    assert done.observed
    want = cleaning.cleaning_report(stored_raw, matches, done.sales)
    assert done.report.collect() == want.collect() and done.report.dtypes == want.dtypes
    audit = warehouse.load_audit(done.sales)
    assert done.audit.collect() == audit.collect() and done.audit.dtypes == audit.dtypes
    row = done.report.first()
    assert min(row[:8]) > 0


def test_no_rows_at_all(raw_frame, tmp_path):
    done = build.load(raw_frame([{}]).limit(0), str(tmp_path / "sales"))
    row = done.report.first()
    assert (row.rows_in, row.duplicates, row.rows_out, row.kept_pct) == (0, 0, 0, None)
    audit = done.audit.first()
    assert (audit.rows, audit.first_date, audit.revenue) == (0, None, None)


def test_nothing_is_scanned_again(stored_raw, spark, tmp_path, monkeypatch):
    """One scan of the raw lines feeds the table, with the counts above it. Neither of the reports that
    scan is asked, and the numbers of rows come from the footers: no column is read for them."""

    def fail(*_):
        raise AssertionError("a report by scans")

    monkeypatch.setattr(cleaning, "cleaning_report", fail)
    monkeypatch.setattr(warehouse, "load_audit", fail)
    done = build.load(stored_raw, str(tmp_path / "sales"))
    assert done.observed and done.report.first().rows_in == stored_raw.count()
    assert done.audit.first().rows == done.sales.count()

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    matches = cleaning.match_returns(stored_raw)
    table = plan_of(cleaning.clean(stored_raw, matches, Observation("raw lines")))
    counts = [plan_of(df.groupBy().count()) for df in (stored_raw, done.sales)]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert table.count("CollectMetrics") == 1
    assert len(re.findall(rf"FileScan parquet [^\n]*{tmp_path}/raw\]", table)) == 1
    assert all("ReadSchema: struct<>" in plan for plan in counts)


def test_rows_counted_twice_are_noticed(stored_raw, tmp_path, monkeypatch):
    """As after a stage that ran again."""
    real = Observation.get.fget

    def inflated(self):
        return {k: v * 2 if k in ("rows_in", "cancelled", "valid") else v for k, v in real(self).items()}

    monkeypatch.setattr(Observation, "get", property(inflated))
    done = build.load(stored_raw, str(tmp_path / "sales"))
    assert not done.observed
    assert done.report.first().rows_in == stored_raw.count()
