"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def month_start(ts: Column) -> Column:
    """First instant of the month, without passing through a time zone."""
    return F.trunc(F.to_date(ts), "month").cast(NTZ)


def week_start(ts: Column) -> Column:
    """First instant of the Monday-based week."""
    return F.trunc(F.to_date(ts), "week").cast(NTZ)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in double precision; null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct(part: Column, whole: Column, digits: int) -> Column:
    """``part`` as a percentage of ``whole``, rounded half up as SQL does."""
    return F.round(F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double")), digits)


def growth_pct(now: Column, before: Column, digits: int = 1) -> Column:
    return pct(now - before, before, digits)


def is_cancellation(invoice: Column) -> Column:
    """Only an upper-case ``C`` marks a cancellation; there is no status column."""
    return F.coalesce(invoice.startswith("C"), F.lit(False))


def not_positive(value: Column) -> Column:
    """True for values <= 0; a missing value is not rejected."""
    return F.coalesce(value <= 0, F.lit(False))


def is_service_line(description: Column, service_lines) -> Column:
    return F.coalesce(description.isin(*service_lines), F.lit(False))


def money_to_double(df):
    """Cast every decimal column to double, for output."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal"
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
