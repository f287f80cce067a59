"""Signals behind the insight texts (A12..A15, W2, W3, R1).

Each signal is a one-row DataFrame. R1 (``signal_context``) computes all of
them from one GROUPING SETS pass over the fact instead of four scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.dates import day, is_sql_weekday, is_sql_weekend
from shoplens.operators.filters import apply_filters
from shoplens.operators.marts import exact_mean
from shoplens.schema import UNKNOWN_TOP_CATEGORY, Z_THRESHOLD
from shoplens.session import materialize


def daily_revenue_exact(df: DataFrame, date_col: str = "date", value: str = "revenue") -> DataFrame:
    """Per-day revenue kept as exact DECIMAL (the input of trend / z-score)."""
    return (df.groupBy(day("order_date").alias(date_col))
            .agg(F.coalesce(F.sum("payment_value"), F.lit(0)).alias(value)))


def latest_days(daily: DataFrame, n: int, date_col: str = "date") -> DataFrame:
    """The ``n`` latest observed days with ``recency_rank`` 1..n.

    ``orderBy().limit()`` is a distributed top-k (each task keeps n rows),
    so only n rows reach the numbering window.
    """
    top = daily.orderBy(F.desc(date_col)).limit(n)
    return top.withColumn("recency_rank", F.row_number().over(Window.orderBy(F.desc(date_col))))


def trend_signal(oc: DataFrame, **filters) -> DataFrame:
    """Mean daily revenue of observed-day ranks 1-7 and 8-14 (0 when absent)."""
    ranked = latest_days(daily_revenue_exact(apply_filters(oc, **filters)), 14)
    r = F.col("recency_rank")
    return ranked.agg(
        F.coalesce(exact_mean("revenue", r.between(1, 7)), F.lit(0.0)).alias("last_7_avg"),
        F.coalesce(exact_mean("revenue", r.between(8, 14)), F.lit(0.0)).alias("previous_7_avg"))


def weekpart_signal(oc: DataFrame, **filters) -> DataFrame:
    """Mean item-row revenue on weekends vs weekdays (0 when absent)."""
    df = apply_filters(oc, **filters)
    return df.agg(
        F.coalesce(exact_mean("payment_value", is_sql_weekend("order_date")), F.lit(0.0)).alias("weekend_avg"),
        F.coalesce(exact_mean("payment_value", is_sql_weekday("order_date")), F.lit(0.0)).alias("weekday_avg"))


def top_category(oc: DataFrame, **filters) -> DataFrame:
    """The top category, its revenue, the total and its share (0 or 1 row)."""
    cat = (apply_filters(oc, **filters).groupBy("product_category_name")
           .agg(F.coalesce(F.sum("payment_value"), F.lit(0)).alias("revenue")))
    total = cat.agg(F.coalesce(F.sum("revenue"), F.lit(0)).alias("total_revenue"))  # one row
    return (cat.crossJoin(F.broadcast(total))
            .select("product_category_name",
                    F.col("revenue").cast("double").alias("revenue"),
                    F.col("total_revenue").cast("double").alias("total_revenue"),
                    F.when(F.col("total_revenue") == 0, F.lit(0.0))
                    .otherwise(F.col("revenue").cast("double") / F.col("total_revenue").cast("double"))
                    .alias("revenue_share"))
            .orderBy(F.desc("revenue"), F.asc("product_category_name"))
            .limit(1))


def day_stats(daily: DataFrame, value: str = "revenue") -> DataFrame:
    """One row: mean and population sigma of the days.

    The mean comes from the exact sum; sigma from central moments in DOUBLE,
    as squares of sums outgrow any decimal when days sell 10^13 and more.
    """
    return daily.agg(
        (F.sum(value).cast("double") / F.count(F.lit(1))).alias("mean_revenue"),
        F.coalesce(F.stddev_pop(F.col(value).cast("double")), F.lit(0.0)).alias("std_revenue"))


def zscore_days(daily: DataFrame, value: str = "revenue") -> DataFrame:
    """Population z-score of every day against all days (0 when sigma is 0).

    Mean and sigma are one global aggregate (one row) joined back by a
    broadcast cross join instead of an ``OVER ()`` window, which would pull
    every day into one task.
    """
    return (daily.crossJoin(F.broadcast(day_stats(daily, value)))
            .withColumn("z_score", F.when(F.col("std_revenue") == 0, F.lit(0.0))
                        .otherwise((F.col(value).cast("double") - F.col("mean_revenue")) / F.col("std_revenue"))))


def anomaly_count(oc: DataFrame, z: float = Z_THRESHOLD, **filters) -> DataFrame:
    """Observed days whose |z| exceeds the threshold."""
    scored = zscore_days(daily_revenue_exact(apply_filters(oc, **filters)))
    return scored.agg(F.count(F.when(F.abs("z_score") > z, 1)).cast("bigint").alias("anomaly_count"))


# grouping_id of the two grouping sets over (date, product_category_name)
_GID_DAY, _GID_CATEGORY = 1, 2


def signal_cube(oc: DataFrame, **filters) -> DataFrame:
    """Revenue and row count per day and per category from ONE scan of the
    fact (``GROUPING SETS``); every R1 signal derives from these rows."""
    df = apply_filters(oc, **filters).select(day("order_date").alias("date"), "product_category_name",
                                             "payment_value")
    return (df.groupingSets([["date"], ["product_category_name"]], "date", "product_category_name")
            .agg(F.coalesce(F.sum("payment_value"), F.lit(0)).alias("revenue"),
                 F.count(F.lit(1)).alias("rows"),
                 F.grouping_id().alias("_gid")))


def signal_context(oc: DataFrame, **filters) -> DataFrame:
    """One row with every signal and the reference defaults.

    Same values as ``trend_signal`` x ``weekpart_signal`` x ``top_category``
    x ``anomaly_count``, but the fact is scanned once: the per-day and
    per-category cube (calendar- and label-bounded rows) is written, and each
    signal is a small aggregate of it. Weekend / weekday means are exact: sum
    of the daily decimal sums over the number of rows.
    """
    return context_of(materialize(signal_cube(oc, **filters), "signal_cube"))


def context_of(cube: DataFrame) -> DataFrame:
    """R1 from the rows of :func:`signal_cube`."""
    days = cube.where(F.col("_gid") == _GID_DAY).select("date", "revenue", "rows")
    categories = cube.where(F.col("_gid") == _GID_CATEGORY).select("product_category_name", "revenue")

    rec = F.col("recency_rank")
    trend = latest_days(days, 14).agg(
        F.coalesce(exact_mean("revenue", rec.between(1, 7)), F.lit(0.0)).alias("last_7_avg"),
        F.coalesce(exact_mean("revenue", rec.between(8, 14)), F.lit(0.0)).alias("previous_7_avg"))

    def day_mean(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("revenue"))).cast("double") / F.sum(F.when(cond, F.col("rows"))),
                          F.lit(0.0))

    scored = zscore_days(days).agg(
        day_mean(is_sql_weekend("date")).alias("weekend_avg"),
        day_mean(is_sql_weekday("date")).alias("weekday_avg"),
        F.count(F.when(F.abs("z_score") > Z_THRESHOLD, 1)).cast("bigint").alias("anomaly_count"))
    total = categories.agg(F.sum("revenue").cast("double").alias("_total"))
    top = (categories.orderBy(F.desc("revenue"), F.asc("product_category_name")).limit(1)
           .crossJoin(F.broadcast(total))
           .agg(F.coalesce(F.max("product_category_name"), F.lit(UNKNOWN_TOP_CATEGORY)).alias("top_category"),
                F.coalesce(F.max(F.when(F.col("_total") == 0, F.lit(0.0))
                                 .otherwise(F.col("revenue").cast("double") / F.col("_total"))), F.lit(0.0))
                .alias("top_category_share")))
    # each side is one row
    return (trend.crossJoin(scored).crossJoin(top)
            .select("last_7_avg", "previous_7_avg", "weekend_avg", "weekday_avg", "top_category", "top_category_share",
                    "anomaly_count"))
