"""Money coercion, half-even rounding and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplens.schema import MONEY
from shoplens.functions.dates import col_


def to_money(c) -> Column:
    """Text or number -> DECIMAL(18,2); NULL and what is no number -> 0.

    A number that doesn't fit raises: a silent 0 (or NULL) would lose revenue.
    """
    x = col_(c)
    exact, number = x.try_cast(MONEY), x.try_cast("double")
    out_of_range = F.raise_error(F.concat(F.lit("money value out of range: "), x.cast("string"))).cast(MONEY)
    return (F.when(exact.isNotNull(), exact)
            .when(number.isNull() | F.isnan(number), F.lit(0).cast(MONEY))
            .otherwise(out_of_range))


def try_double(c) -> Column:
    return col_(c).try_cast("double")


def half_even(c, scale: int = 0) -> Column:
    """Banker's rounding, as numpy / Python ``round`` do."""
    return F.bround(col_(c), scale)


def pct_increase(current, baseline) -> Column:
    """Percentage increase over a baseline.

    baseline <= 0 -> 0 when current <= 0 else 100; NULL baseline -> NULL.
    """
    cur, base = col_(current).cast("double"), col_(baseline).cast("double")
    return (F.when(base.isNull(), F.lit(None).cast("double"))
            .when(base <= 0, F.when(cur <= 0, F.lit(0.0)).otherwise(F.lit(100.0)))
            .otherwise((cur - base) / base * 100.0))


def finite_or_null(c) -> Column:
    """NaN / +-inf -> NULL."""
    x = col_(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)
