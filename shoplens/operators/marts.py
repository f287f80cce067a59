"""SQL-style marts over the clean fact (A3..A11, W1).

Money is summed as DECIMAL (exact, order-independent) and turned into
DOUBLE only at the output. Means are ``sum / count`` of the exact sum, so
they do not depend on partition order either. Note the reference's
counting: ``total_orders`` / ``order_count`` count item rows (``COUNT(*)``),
and ``payment_value`` is an order-level sum repeated on every item row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.dates import day, sql_dow
from shoplens.functions.numbering import exact_percentiles
from shoplens.operators.filters import apply_filters
from shoplens.schema import SEGMENT_ORDER
from shoplens.session import materialize


def revenue_sum(c: str = "payment_value") -> Column:
    """``COALESCE(SUM(x), 0)`` as DOUBLE, summed exactly."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def exact_mean(c: str = "payment_value", cond: Column | None = None) -> Column:
    """Mean of a DECIMAL column as DOUBLE: exact sum / count (NULL when empty)."""
    x = F.col(c) if cond is None else F.when(cond, F.col(c))
    return F.sum(x).cast("double") / F.count(x)


def metrics(oc: DataFrame, **filters) -> DataFrame:
    """A3: item-row count and revenue; one row even when nothing matches."""
    return apply_filters(oc, **filters).agg(
        F.count(F.lit(1)).alias("total_orders"),
        revenue_sum().alias("total_revenue"))


def daily_revenue(oc: DataFrame, **filters) -> DataFrame:
    """A4: revenue per calendar day, ascending."""
    return (apply_filters(oc, **filters)
            .groupBy(day("order_date").alias("date"))
            .agg(revenue_sum().alias("total_revenue"))
            .orderBy("date"))


def daily_orders(oc: DataFrame, **filters) -> DataFrame:
    """A5: item rows per calendar day, ascending."""
    return (apply_filters(oc, **filters)
            .groupBy(day("order_date").alias("date"))
            .agg(F.count(F.lit(1)).alias("order_count"))
            .orderBy("date"))


def data_growth(oc: DataFrame, **filters) -> DataFrame:
    """Running total of daily item rows.

    The window runs over the per-day aggregate (one row per observed day, a
    calendar-bounded table), never over the fact itself.
    """
    return growth_of(daily_orders(oc, **filters))


def growth_of(daily: DataFrame) -> DataFrame:
    """W1 of a (date, order_count) table."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (daily.select("date", F.sum("order_count").over(w).cast("bigint").alias("cumulative_orders"))
            .orderBy("date"))


def category_analysis(oc: DataFrame, **filters) -> DataFrame:
    """Revenue by category, largest first (ties by name)."""
    return (apply_filters(oc, **filters)
            .groupBy(F.col("product_category_name").alias("category"))
            .agg(revenue_sum().alias("revenue"))
            .orderBy(F.desc("revenue"), F.asc("category")))


def geo_analysis(oc: DataFrame, **filters) -> DataFrame:
    """Revenue by customer state, largest first (ties by name)."""
    return (apply_filters(oc, **filters)
            .groupBy(F.col("customer_state").alias("state"))
            .agg(revenue_sum().alias("revenue"))
            .orderBy(F.desc("revenue"), F.asc("state")))


def weekday_analysis(oc: DataFrame, **filters) -> DataFrame:
    """Mean item-row revenue per weekday (Sunday=0), days present only."""
    return (apply_filters(oc, **filters)
            .groupBy(sql_dow("order_date").alias("day"))
            .agg(F.coalesce(exact_mean(), F.lit(0.0)).alias("avg_revenue"))
            .orderBy("day"))


def customer_spend(oc: DataFrame, **filters) -> DataFrame:
    """Per-customer total spend (DECIMAL) — the A9 input."""
    return (apply_filters(oc, **filters).groupBy("customer_id")
            .agg(F.coalesce(F.sum("payment_value"), F.lit(0)).alias("total_spend")))


#: size of the quantile sketch; its rank error stays under ``RANK_ERROR`` but for a chance under 1 %
SKETCH_K, RANK_ERROR = 800, 0.01


def segment_thresholds(spend: DataFrame, approx: bool = False) -> DataFrame:
    """p25 / p75 of customer spend (one row). Exact: a distributed sort, no single task.
    ``approx``: a quantile sketch a task, merged, so that no customer's spend is
    shuffled again; values of spend whose ranks are off by ``RANK_ERROR`` at most."""
    if not approx:
        return exact_percentiles(spend, "total_spend", {"p25": 0.25, "p75": 0.75})
    sketch = spend.agg(F.expr(f"kll_sketch_agg_double(CAST(total_spend AS DOUBLE), {SKETCH_K})").alias("s"), F.count("total_spend").alias("n"))
    at = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.lit(q)))
    return sketch.select(at(0.25).alias("p25"), at(0.75).alias("p75"))


def customer_segments(oc: DataFrame, approx: bool = False, **filters) -> DataFrame:
    """High (> p75) / Low (< p25) / Medium customers; always three rows.
    ``approx`` takes the thresholds from a sketch (very many customers)."""
    # the thresholds and the classification both read the per-customer
    # spend: write it once instead of aggregating the fact twice
    spend = materialize(customer_spend(oc, **filters), "customer_spend")
    th = segment_thresholds(spend, approx)
    s = F.col("total_spend").cast("double")
    seg = (spend.crossJoin(F.broadcast(th))  # one-row thresholds
           .select(F.when(s > F.col("p75"), "High").when(s < F.col("p25"), "Low")
                   .otherwise("Medium").alias("segment")))
    counts = seg.agg(*[F.count(F.when(F.col("segment") == s_, 1)).alias(f"n{i}")
                       for i, s_ in enumerate(SEGMENT_ORDER)])
    stack = ", ".join(f"'{s_}', {i}, n{i}" for i, s_ in enumerate(SEGMENT_ORDER))
    return (counts.selectExpr(f"stack({len(SEGMENT_ORDER)}, {stack}) AS (segment, segment_order, count)")
            .select("segment", F.col("segment_order").cast("int"), F.col("count").cast("bigint"))
            .orderBy("segment_order"))


def filter_summary(oc: DataFrame) -> DataFrame:
    """A10: date and revenue bounds for the filter widgets ('' / 0 when empty)."""
    return summary_of(oc, "order_date", "order_date", "payment_value", "payment_value")


def summary_of(df: DataFrame, first: str, last: str, least: str, most: str) -> DataFrame:
    """A10 from the columns that bound the dates and values."""
    return df.agg(
        F.coalesce(F.date_format(F.min(first), "yyyy-MM-dd"), F.lit("")).alias("min_date"),
        F.coalesce(F.date_format(F.max(last), "yyyy-MM-dd"), F.lit("")).alias("max_date"),
        F.coalesce(F.min(least), F.lit(0)).cast("double").alias("min_revenue"),
        F.coalesce(F.max(most), F.lit(0)).cast("double").alias("max_revenue"))


def distinct_values(oc: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of one label column (binary order)."""
    return oc.select(column).distinct().orderBy(column)
