"""Row filters shared by the dashboard reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailloom.schema import SALE_MONTH

LAST_SECOND = "23:59:59"


def _day(value: date | str) -> str:
    """A bound is a whole day. One with a time of day is refused, for it would not be used."""
    if isinstance(value, datetime):
        raise ValueError(f"a date is wanted, not {value!r}")
    return date.fromisoformat(str(value)).isoformat()


def _instant(value: date | str, time: str = "00:00:00"):
    return F.lit(f"{_day(value)} {time}").cast("timestamp_ntz")


def filter_sales(
    sales: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    countries: Sequence[str] = (),
) -> DataFrame:
    """Sales from ``start`` to ``end``, both days included, in some countries.

    Without both dates the whole range is meant; without countries, all of them.
    The last second of ``end`` is the bound, so a later fraction of it is out.
    On the stored table the same range is also put on the partition column, so
    months outside it are never opened.
    """
    if start is not None and end is not None:
        sales = sales.where(
            F.col("InvoiceDate").between(_instant(start), _instant(end, LAST_SECOND))
        )
        if SALE_MONTH in sales.columns:
            first, last = (F.trunc(F.lit(_day(d)).cast("date"), "month") for d in (start, end))
            sales = sales.where(F.col(SALE_MONTH).between(first, last))
    if countries:
        sales = sales.where(F.col("Country").isin(*countries))
    return sales


def search_description(sales: DataFrame, term: str = "") -> DataFrame:
    """Case-insensitive substring match; ``%`` and ``_`` in the term are wildcards, a backslash
    is itself."""
    if not term:
        return sales
    pattern = term.lower().replace("\\", "\\\\")
    return sales.where(F.lower("Description").like(f"%{pattern}%"))
