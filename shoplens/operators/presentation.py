"""Presentation relations the dashboard derives from the marts (K2..K8).

All of them work on small mart outputs (categories, states, weekdays,
anomaly days, cohorts); the top-n ones are distributed top-k sorts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.schema import RETENTION_BANDS, WEEKDAY_LABELS


def top_categories_chart(category_mart: DataFrame, n: int = 10) -> DataFrame:
    """K2: the first n categories, underscores shown as spaces."""
    return (category_mart.orderBy(F.desc("revenue"), F.asc("category")).limit(n)
            .select(F.translate("category", "_", " ").alias("category"), "revenue"))


def top_states_chart(geo_mart: DataFrame, n: int = 10) -> DataFrame:
    """K3: the first n states, the leader labelled "(Top)"."""
    top = geo_mart.orderBy(F.desc("revenue"), F.asc("state")).limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("revenue"), F.asc("state")))  # n rows
    return (top.withColumn("_rank", rank)
            .select(F.when(F.col("_rank") == 1, F.concat("state", F.lit(" (Top)"))).otherwise(F.col("state"))
                    .alias("state"), "revenue", F.col("_rank").cast("int").alias("rank")))


def weekday_chart(weekday_mart: DataFrame) -> DataFrame:
    """K4: weekday ids (Sunday=0) to names, in weekday order."""
    labels = F.array(*[F.lit(x) for x in WEEKDAY_LABELS])
    name = F.coalesce(F.element_at(labels, F.col("day") + 1), F.col("day").cast("string"))
    return weekday_mart.orderBy("day").select("day", name.alias("label"), "avg_revenue")


def latest_anomalies(anomalies: DataFrame, n: int = 3) -> DataFrame:
    """K5: the n most recent anomaly days."""
    return anomalies.orderBy(F.desc("date")).limit(n)


def segment_shares(segments: DataFrame) -> DataFrame:
    """K6: each segment's whole-percent share of customers (half-up, like Math.round)."""
    total = segments.agg(F.sum("count").alias("_total"))  # one row
    share = F.when(F.col("_total") > 0, F.floor(F.col("count") * 100.0 / F.col("_total") + 0.5))
    return (segments.crossJoin(F.broadcast(total))
            .select("segment", "segment_order", "count", share.cast("int").alias("share_pct"))
            .orderBy("segment_order"))


def first_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """K7: first n rows of a mart in its display order."""
    return df.orderBy(*order).limit(n)


def retention_band(col: str = "retention_pct"):
    """K8: colour band of a retention percentage (75 / 50 / 25 / >0 / 0)."""
    c = F.col(col)
    expr = None
    for bound, label in RETENTION_BANDS:
        cond = (c >= bound) if bound > 0 else (c > 0)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("none"))


def retention_bands(cohort_long: DataFrame, cohorts: int = 12) -> DataFrame:
    """K7 + K8: the first ``cohorts`` cohorts, every cell with its band."""
    first = cohort_long.select("cohort_month").distinct().orderBy("cohort_month").limit(cohorts)
    return (cohort_long.join(first, "cohort_month", "left_semi")
            .withColumn("band", retention_band())
            .orderBy("cohort_month", "period_number"))
