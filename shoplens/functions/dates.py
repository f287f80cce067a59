"""Date helpers with the two weekday conventions the application mixes.

* SQL endpoints number weekdays Sunday=0..Saturday=6.
* The forecasting features number them Monday=0..Sunday=6.

Spark's ``dayofweek`` is Sunday=1..Saturday=7 and ``weekday`` is Monday=0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(c) -> Column:
    """Calendar day of a timestamp (``DATE(ts)``)."""
    return F.to_date(col_(c))


def sql_dow(c) -> Column:
    """Weekday, Sunday=0 .. Saturday=6."""
    return (F.dayofweek(col_(c)) - 1).cast("int")


def iso_dow(c) -> Column:
    """Weekday, Monday=0 .. Sunday=6."""
    return F.weekday(col_(c)).cast("int")


def is_sql_weekend(c) -> Column:
    """Saturday or Sunday (weekday ids 0 or 6 in the Sunday=0 numbering)."""
    return F.dayofweek(col_(c)).isin(1, 7)


def is_sql_weekday(c) -> Column:
    """Monday..Friday (ids 1..5 in the Sunday=0 numbering)."""
    return F.dayofweek(col_(c)).between(2, 6)


def month_start(c) -> Column:
    """First day of the month as DATE (a month period)."""
    return F.trunc(F.to_date(col_(c)), "MM")


def month_label(c) -> Column:
    """``yyyy-MM`` text of a month period."""
    return F.date_format(col_(c), "yyyy-MM")


def months_between_periods(later, earlier) -> Column:
    """Whole-month distance between two month periods."""
    return ((F.year(col_(later)) - F.year(col_(earlier))) * 12
            + (F.month(col_(later)) - F.month(col_(earlier)))).cast("int")


def whole_days(start, end) -> Column:
    """Whole days from start to end (floor for end >= start)."""
    return F.timestamp_diff("DAY", col_(start), col_(end))
