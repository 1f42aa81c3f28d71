"""The load: raw sheets in, cleaned and stored ``sales`` out."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation

from retailloom.operators import cleaning, returns
from retailloom.sources import warehouse


@dataclass
class Load:
    sales: DataFrame
    report: DataFrame
    audit: DataFrame
    observed: bool  # whether report and audit come from the load itself


def build_sales(raw: DataFrame, path: str) -> DataFrame:
    """Clean ``raw``, replace the table at ``path`` and return a scan of it."""
    warehouse.write_sales(cleaning.clean_lines(raw), path)
    return warehouse.read_sales(raw.sparkSession, path)


def _figures(seen: Observation) -> dict:
    """What was observed; nothing if Spark has planned an empty input away, observation and all."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def load(raw: DataFrame, path: str) -> Load:
    """Build the table, and tell what was dropped and what was stored.

    Both are counted while the rows pass, so nothing is scanned again. Stages that are run once more
    after an executor was lost count their rows once more, so the numbers of rows are checked against the
    files (Parquet keeps them in its footers). Where they differ, the lines are counted by scans.
    """
    spark = raw.sparkSession
    seen, stored = Observation("raw lines"), Observation("stored lines")
    matches = cleaning.match_returns(raw)
    warehouse.write_sales(cleaning.clean_lines(raw, matches, seen), path, stored)
    sales = warehouse.read_sales(spark, path)
    counted, kept = _figures(seen), _figures(stored)
    if counted.get("rows_in") == raw.count() and kept.get("rows") == sales.count():
        matched = returns.matched_count(matches).first().matched
        report = cleaning.observed_report(counted, matched, kept, spark)
        return Load(sales, report, warehouse.observed_audit(kept, spark), True)
    report = cleaning.cleaning_report(raw, matches, sales)
    return Load(sales, report, warehouse.load_audit(sales), False)
