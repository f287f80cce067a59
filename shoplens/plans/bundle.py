"""Compute every dashboard table for one filter set and write each one.

Each table is a small aggregate of its own columns of the clean fact, read
from Parquet with its filters and months pruned; the fact is never held in
memory. With ``partials`` (``plans.partials``, brought up to date before) the tables
are merged from stored monthly aggregates instead; the fact is read only by tables
whose filter needs its rows. The signals (R1) are computed once and written. Core tables (metrics
and the daily series) must succeed; any other that fails is written empty,
with its schema, and listed with its error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.operators import advanced as A
from shoplens.operators import marts as M
from shoplens.operators import rules as R
from shoplens.operators import signals as G
from shoplens.operators.clean import prepare_orders
from shoplens.plans import forecast as FC
from shoplens.plans import partials as PT
from shoplens.plans import timeseries as TS
from shoplens.session import materialize, path_exists

CORE = ("metrics", "daily_revenue", "daily_orders", "data_growth")

PREDICTION_SCHEMA = "date date, predicted_revenue double, lower_bound double, upper_bound double"
DRIVERS_SCHEMA = "feature string, value double, impact double"


def mart_plans(oc: DataFrame, model_dir: str | None = None, partials: str | None = None,
               **filters) -> dict[str, Callable[[], DataFrame]]:
    """Name -> plan of each of the 19 tables and the filter bounds."""
    spark = oc.sparkSession
    shared: dict[str, DataFrame] = {}

    def once(name: str, plan: Callable[[], DataFrame]) -> DataFrame:
        if name not in shared:
            shared[name] = materialize(plan(), name)
        return shared[name]

    # what the tables read: the fact, or frames of partials that stand for it
    whole = labels = customers = oc
    orders = causes = prepare_orders(oc)
    merged: dict[str, Callable[[], DataFrame]] = {}
    if partials:
        cube, by_order = PT.load(spark, partials)
        by_cube, by_orders = PT.usable(filters)
        whole, (orders, causes) = cube, PT.analytics(cube, by_order)
        merged["filter_summary"] = lambda: PT.summary(cube)
        if by_cube:
            labels = cube
            merged.update(PT.mart_plans(cube, once, **filters))
        if by_orders:
            customers = by_order

    context = merged.pop("signals", lambda: once("signals", lambda: G.signal_context(oc, **filters)))
    series = lambda: once("series", lambda: TS.daily_series(whole).coalesce(1))
    trained = model_dir is not None and path_exists(spark, f"{model_dir}/metrics")

    def prediction() -> DataFrame:
        if not trained:
            return spark.createDataFrame([], PREDICTION_SCHEMA)
        score = FC.by_model(FC.load_model(spark, model_dir))
        return FC.predict_next(score, TS.next_day_features(series()), FC.load_metrics(spark, model_dir))

    def explanation() -> DataFrame:
        if not trained:
            return spark.createDataFrame([], DRIVERS_SCHEMA)
        return FC.prediction_drivers(FC.load_model(spark, model_dir), TS.next_day_features(series()))

    plans = {
        "metrics": lambda: M.metrics(oc, **filters),
        "daily_revenue": lambda: M.daily_revenue(labels, **filters),
        "daily_orders": lambda: M.daily_orders(oc, **filters),
        "data_growth": lambda: M.data_growth(oc, **filters),
        "prediction": prediction,
        "model_metrics": lambda: FC.load_metrics(spark, model_dir or "none"),
        "prediction_explanation": explanation,
        "anomalies": lambda: TS.detect_anomalies(series()),
        "category_analysis": lambda: M.category_analysis(labels, **filters),
        "customer_segments": lambda: M.customer_segments(customers, **filters),
        "weekday_analysis": lambda: M.weekday_analysis(oc, **filters),
        "insights": lambda: R.insights(context()),
        "recommendations": lambda: R.recommendations(context()),
        "geo_analysis": lambda: M.geo_analysis(labels, **filters),
        "cohort_retention": lambda: A.cohort_retention(orders),
        "revenue_decomposition": lambda: A.revenue_decomposition(orders),
        "churn_risk": lambda: A.churn_risk(orders),
        "anomaly_root_cause": lambda: A.anomaly_root_cause(causes),
        "customer_ltv": lambda: A.customer_ltv(orders, 10),
        "filter_summary": lambda: M.filter_summary(oc),
    }
    return {**plans, **merged}


def _write(name: str, plan: Callable[[], DataFrame], out: str) -> str:
    df = None
    try:
        df = plan()
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return "ok"
    except Exception as exc:
        if name in CORE:
            raise
        if df is not None:  # the plan stands, its run failed: its columns are known
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{out}/{name}")
        return f"{type(exc).__name__}: {exc}"


def materialize_marts(spark: SparkSession, oc: DataFrame, out: str, model_dir: str | None = None,
                      partials: str | None = None, **filters) -> dict[str, str]:
    """Write every table under ``out/<name>``; returns {name: "ok" | error text}.

    A failed table has no rows; one whose plan can't even be made has no folder.
    """
    return {name: _write(name, plan, out) for name, plan in mart_plans(oc, model_dir, partials, **filters).items()}


def mart_status(spark: SparkSession, out: str, status: dict[str, str]) -> DataFrame:
    """(mart, status, rows) of every table, failed ones too."""
    listed = spark.createDataFrame([*status.items()], "mart string, status string")
    counts = None
    for name in status:
        if path_exists(spark, f"{out}/{name}"):
            n = spark.read.parquet(f"{out}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("mart"), "rows")
            counts = n if counts is None else counts.unionByName(n)
    return listed.join(counts, "mart", "left").select("mart", "status", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))
