"""Dashboard filters and weekday predicates.

Filters are Column predicates (no SQL text). ``DATE(order_date) >= d`` is
rewritten by Catalyst into a timestamp range that reaches the Parquet scan;
when the month partition column is present we add the implied month bound
so whole partitions are skipped at planning time.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.dates import day
from shoplens.schema import MONEY

PARTITION_COLUMN = "order_month"


def _money_bound(bound: float, rounding: str) -> Column:
    """``bound`` in cents, as a literal of the column's own type, so that the
    comparison reaches the Parquet reader; beyond that type a wider one."""
    cents = Decimal(repr(float(bound))).quantize(Decimal("0.01"), rounding=rounding)
    fits = abs(cents) < Decimal(10) ** (MONEY.precision - MONEY.scale)
    return F.lit(cents).cast(MONEY if fits else "decimal(38,2)")


def apply_filters(oc: DataFrame, start_date: str | None = None, end_date: str | None = None,
                  category: str | None = None, state: str | None = None,
                  min_revenue: float | None = None, max_revenue: float | None = None) -> DataFrame:
    """Conjunction of up to six predicates, both ends inclusive.

    Text filters use truthiness (``""`` means no filter); revenue bounds use
    ``is not None`` (0 is a real bound).
    """
    df = oc
    has_month = PARTITION_COLUMN in oc.columns
    if start_date:
        df = df.where(day("order_date") >= F.to_date(F.lit(start_date)))
        if has_month:
            df = df.where(F.col(PARTITION_COLUMN) >= F.trunc(F.to_date(F.lit(start_date)), "MM"))
    if end_date:
        df = df.where(day("order_date") <= F.to_date(F.lit(end_date)))
        if has_month:
            df = df.where(F.col(PARTITION_COLUMN) <= F.trunc(F.to_date(F.lit(end_date)), "MM"))
    if category:
        df = df.where(F.col("product_category_name") == F.lit(category))
    if state:
        df = df.where(F.col("customer_state") == F.lit(state))
    if min_revenue is not None:
        df = df.where(F.col("payment_value") >= _money_bound(min_revenue, ROUND_CEILING))
    if max_revenue is not None:
        df = df.where(F.col("payment_value") <= _money_bound(max_revenue, ROUND_FLOOR))
    return df
