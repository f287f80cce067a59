"""Rule operators turning the signal row into ordered texts.

Both are expressions over the one-row signal context: an array of optional
texts, compacted, then exploded with its position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens import schema as S


def _ordered(texts: list, name: str) -> DataFrame:
    return F.array_compact(F.array(*texts)).alias(name)


def insights_array(ctx: DataFrame) -> DataFrame:
    last, prev = F.col("last_7_avg"), F.col("previous_7_avg")
    wkend, wkday = F.col("weekend_avg"), F.col("weekday_avg")
    share, top, n = F.col("top_category_share"), F.col("top_category"), F.col("anomaly_count")
    trend = (F.when((last > prev) & (prev > 0), F.lit(S.INSIGHT_TREND_UP))
             .when((prev > last) & (last > 0), F.lit(S.INSIGHT_TREND_DOWN))
             .otherwise(F.lit(S.INSIGHT_TREND_STABLE)))
    week = (F.when((wkend > wkday) & (wkday > 0), F.lit(S.INSIGHT_WEEKEND))
            .when((wkday > wkend) & (wkend > 0), F.lit(S.INSIGHT_WEEKDAY)))
    category = (F.when(share >= S.TOP_SHARE_THRESHOLD,
                       F.format_string(S.INSIGHT_LARGEST_SHARE.replace("{}", "%s"), top))
                .when(top != S.UNKNOWN_TOP_CATEGORY,
                      F.format_string(S.INSIGHT_TOP_CATEGORY.replace("{}", "%s"), top)))
    anomalies = F.when(n > 0, F.format_string(S.INSIGHT_ANOMALIES.replace("{}", "%d"), n))
    return ctx.select(_ordered([trend, week, category, anomalies], "insights"))


def insights(ctx: DataFrame) -> DataFrame:
    """R2: ordered insight texts (position, insight)."""
    return insights_array(ctx).select(F.posexplode("insights").alias("position", "insight"))


def recommendations_from(insight_arr: DataFrame) -> DataFrame:
    """Recommendations by substring rules over the lower-cased insights."""
    text = F.lower(F.array_join(F.col("insights"), " "))
    has = text.contains
    weekpart = (F.when(has(S.MATCH_WEEKEND), F.lit(S.RECO_WEEKEND))
                .when(has(S.MATCH_WEEKDAY), F.lit(S.RECO_WEEKDAY)))
    category = F.when(has(S.MATCH_TOP_CATEGORY) | has(S.MATCH_LARGEST_SHARE), F.lit(S.RECO_CATEGORY))
    anomaly = F.when(has(S.MATCH_ANOMALIES), F.lit(S.RECO_ANOMALY))
    trend = (F.when(has(S.MATCH_DOWN), F.lit(S.RECO_DOWN))
             .when(has(S.MATCH_UP), F.lit(S.RECO_UP)))
    recos = F.array_compact(F.array(weekpart, category, anomaly, trend))
    with_fallback = F.when(F.size(recos) == 0, F.array(F.lit(S.RECO_FALLBACK))).otherwise(recos)
    return (insight_arr.select(with_fallback.alias("recommendations"))
            .select(F.posexplode("recommendations").alias("position", "recommendation")))


def recommendations(ctx: DataFrame) -> DataFrame:
    return recommendations_from(insights_array(ctx))
