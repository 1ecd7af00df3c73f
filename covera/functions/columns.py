"""Column expressions (JVM side, inside whole-stage codegen; no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month abbreviations of a `DD-MON-YY` date, January first.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

# The vehicle type whose technical columns are reset, and the
# production year given to its rows when the year is missing.
TRADE_PLATES = "Trade plates"
TRADE_PLATES_YEAR = 2010.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_index(date_text) -> Column:
    """B1: `DD-MON-YY` -> two-digit year * 12 + month (JAN = 0).

    An unknown month name gives null instead of a silently wrong index.
    """
    parts = F.split(_c(date_text), "-")
    year = parts.getItem(2).try_cast("int")
    pos = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), parts.getItem(1))
    month = F.when(pos > 0, (pos - 1).cast("int"))
    return year * 12 + month


def begin_year(date_text) -> Column:
    """The two-digit year part of the date text."""
    return F.split(_c(date_text), "-").getItem(2).try_cast("int")


def duration(start, end) -> Column:
    """B2: policy length in months."""
    return _c(end) - _c(start)


def object_age(start_mnth, prod_year) -> Column:
    """Months from production to policy start (two-digit-year months)."""
    return _c(start_mnth) - (_c(prod_year) - F.lit(2000.0)) * F.lit(12.0)


def make_key(make) -> Column:
    """Null -> '', upper case, spaces removed."""
    return F.upper(F.replace(F.coalesce(_c(make), F.lit("")), F.lit(" "), F.lit("")))


def is_zero(insured_value="INSURED_VALUE") -> Column:
    """Segment flag.  Null is *not* zero, so it lands in the other segment."""
    return _c(insured_value).eqNullSafe(F.lit(0.0))


def text_of(c) -> Column:
    """Category value as text (for rule mining and rule matching)."""
    return _c(c).cast("string")
