"""Stored partial aggregates of the fact by month, and the marts from them.

Two tables stand beside the clean table, partitioned by the same month:

* ``cube``   — a row a (day, category, state): rows, revenue, bounds. It merges by sum,
  min and max, and serves the KPI, trend, category, geographic, weekday, signal,
  anomaly, root-cause and forecast tables;
* ``orders`` — a row a (customer, order, moment): revenue. Distinct orders and customers
  don't add up over months, so these keys are kept; it serves segments, cohorts,
  decomposition, churn and lifetime value by the operators that read the fact.

:func:`refresh` compares the files that each month of the clean table now has
with those that its partials were made from, and makes anew what differs: after an
upsert the months it touched, and no other month of the fact is read. The list of
files is written last, so that a refresh that dies is done again.

Filters by date, category and state apply to the cube as to the fact, those by date to
``orders`` too. Tables filtered otherwise read the fact (:func:`usable`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.dates import day, sql_dow
from shoplens.operators import marts as M
from shoplens.operators import signals as G
from shoplens.operators.clean import prepare_orders
from shoplens.operators.filters import apply_filters
from shoplens.schema import ADVANCED_UNKNOWN
from shoplens.session import path_exists, remove_path
from shoplens.sources.clean_store import PARTITION_COLUMN, read_clean
from shoplens.sources.upsert import finish_stage, month_files

TABLES = ("cube", "orders")
SOURCES = f"{PARTITION_COLUMN} string, digest string"


def cube(oc: DataFrame) -> DataFrame:
    """(month, day, category, state, known customer) -> rows, revenue, values, bounds."""
    known = F.coalesce(F.col("customer_id") != ADVANCED_UNKNOWN, F.lit(False))
    return (oc.groupBy(PARTITION_COLUMN, day("order_date").alias("date"), "product_category_name", "customer_state",
                       known.alias("known"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("payment_value").alias("payment_value"),
                 F.count("payment_value").alias("values"), F.min("order_date").alias("first_at"),
                 F.max("order_date").alias("last_at"), F.min("payment_value").alias("least"),
                 F.max("payment_value").alias("most")))


def orders(oc: DataFrame) -> DataFrame:
    """(month, customer, order, moment) -> revenue."""
    return oc.groupBy(PARTITION_COLUMN, "customer_id", "order_id", "order_date").agg(F.sum("payment_value").alias("payment_value"))


def _digests(spark: SparkSession, table_path: str) -> dict[str, str]:
    """Month folder -> digest of the names of its files."""
    return {month: hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()
            for month, names in month_files(spark, table_path).items()}


def stale_months(spark: SparkSession, table_path: str, partials: str) -> tuple[list[str], list[str]]:
    """(months whose files are not those that the partials were made from, months that are gone)."""
    now, was = _digests(spark, table_path), {}
    if path_exists(spark, f"{partials}/sources/_SUCCESS"):
        was = {r[PARTITION_COLUMN]: r["digest"] for r in spark.read.schema(SOURCES).json(f"{partials}/sources").collect()}
    return sorted(m for m in now if was.get(m) != now[m]), sorted(set(was) - set(now))


def touched(spark: SparkSession, table_path: str, months: list[str]) -> DataFrame:
    """The clean table's rows of these month folders; other months are pruned."""
    values = [m.split("=", 1)[1] for m in months]
    return read_clean(spark, table_path).where(F.col(PARTITION_COLUMN).isin([F.to_date(F.lit(v)) for v in values]))


def refresh(spark: SparkSession, table_path: str, partials: str) -> list[str]:
    """Bring the partials up to date with the clean table; returns the months made anew."""
    finish_stage(spark, table_path)
    stale, gone = stale_months(spark, table_path, partials)
    if stale:
        fact = touched(spark, table_path, stale)
        for name, plan in (("cube", cube(fact)), ("orders", orders(fact))):
            (plan.hint("rebalance", PARTITION_COLUMN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(PARTITION_COLUMN).parquet(f"{partials}/{name}"))
    for month in gone:
        for name in TABLES:
            remove_path(spark, f"{partials}/{name}/{month}")
    if stale or gone:
        rows = sorted(_digests(spark, table_path).items())
        spark.createDataFrame(rows, SOURCES).coalesce(1).write.mode("overwrite").json(f"{partials}/sources")
    return stale


def load(spark: SparkSession, partials: str) -> tuple[DataFrame, DataFrame]:
    """(cube, orders); the cube's ``order_date`` is the day, its ``payment_value`` the sum of its rows."""
    c = spark.read.parquet(f"{partials}/cube").withColumn("order_date", F.col("date").cast("timestamp_ntz"))
    return c, spark.read.parquet(f"{partials}/orders")


def usable(filters: dict) -> tuple[bool, bool]:
    """Can tables with these filters be made from (the cube, ``orders``)?"""
    by_value = any(filters.get(k) is not None for k in ("min_revenue", "max_revenue"))
    return not by_value, not by_value and not (filters.get("category") or filters.get("state"))


def signal_cube(c: DataFrame, **filters) -> DataFrame:
    """R1's cube, merged from the partials."""
    return (apply_filters(c, **filters).groupingSets([["date"], ["product_category_name"]], "date", "product_category_name")
            .agg(F.coalesce(F.sum("payment_value"), F.lit(0)).alias("revenue"), F.sum("rows").alias("rows"),
                 F.grouping_id().alias("_gid")))


def daily_orders(c: DataFrame, **filters) -> DataFrame:
    return apply_filters(c, **filters).groupBy("date").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("order_count")).orderBy("date")


def mart_plans(c: DataFrame, once: Callable, **filters) -> dict[str, Callable[[], DataFrame]]:
    """Name -> plan of the filtered tables whose form over the cube is not the one over
    the fact, as they count rows; the others take the cube as their fact."""
    context = lambda: once("signals", lambda: G.context_of(once("signal_cube", lambda: signal_cube(c, **filters))))
    f = apply_filters(c, **filters)
    return {
        "metrics": lambda: f.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_orders"), M.revenue_sum().alias("total_revenue")),
        "daily_orders": lambda: daily_orders(c, **filters),
        "data_growth": lambda: M.growth_of(daily_orders(c, **filters)),
        "weekday_analysis": lambda: f.groupBy(sql_dow("order_date").alias("day")).agg(
            F.coalesce(F.sum("payment_value").cast("double") / F.sum("values"), F.lit(0.0)).alias("avg_revenue")).orderBy("day"),
        "signals": context,
    }


def summary(c: DataFrame) -> DataFrame:
    """A10 from the cube's bounds."""
    return M.summary_of(c, "first_at", "last_at", "least", "most")


def analytics(c: DataFrame, o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stands for the prepared orders (P9): by customer and order where distinct
    orders count, by day and label where sums do."""
    label = lambda name: F.coalesce(F.col(name), F.lit(ADVANCED_UNKNOWN)).alias(name)
    causes = c.where("known AND order_date IS NOT NULL").select(
        "order_date", label("product_category_name"), label("customer_state"), "payment_value")
    return prepare_orders(o), causes
