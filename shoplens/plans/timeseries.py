"""Daily revenue series and forecasting features (F1..F5, F11, W4..W9).

Every operator takes ``keys`` (default ``[]``): with no keys there is one
series and its windows run over one row per calendar day — a table bounded
by the date span, not by the data volume. With keys (e.g. state or
category) every window is partitioned by the key and the work spreads
across the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.dates import day, iso_dow
from shoplens.functions.numeric import finite_or_null
from shoplens.schema import (
    FEATURE_COLUMNS,
    LAGS,
    MIN_ROWS_FOR_SPLIT,
    ROLLING_MEANS,
    ROLLING_STD_WINDOW,
    TARGET_COLUMN,
    TRAIN_FRACTION,
    Z_THRESHOLD,
)


def _w(keys: list[str], descending: bool = False) -> Window:
    order = F.desc("date") if descending else F.col("date")
    return Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)


def _running(keys: list[str], descending: bool = False) -> Window:
    """A running frame (start .. current row). A frame reaching *forward* to
    the end would be re-aggregated per row (quadratic); looking back over the
    reversed order gives "next non-NULL value" in one linear pass."""
    return _w(keys, descending).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def observed_daily(oc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per-day revenue (exact sum, then DOUBLE) on observed days only."""
    keys = list(keys or [])
    return (oc.where(F.col("order_date").isNotNull())
            .groupBy(*keys, day("order_date").alias("date"))
            .agg(F.coalesce(F.sum("payment_value"), F.lit(0)).cast("double").alias(TARGET_COLUMN)))


def fill_gaps(series: DataFrame, keys: list[str] | None = None, value: str = TARGET_COLUMN) -> DataFrame:
    """W8 + W9: linear interpolation between the nearest observed neighbours,
    then forward fill, back fill, and 0."""
    keys = list(keys or [])
    before, after = _running(keys), _running(keys, descending=True)
    v = F.col(value)
    seen = F.when(v.isNotNull(), F.col("date"))
    y0, x0 = F.last(v, True).over(before), F.last(seen, True).over(before)
    y1, x1 = F.last(v, True).over(after), F.last(seen, True).over(after)
    slope = (y1 - y0) / F.datediff(x1, x0)
    interp = y0 + slope * F.datediff(F.col("date"), x0)
    filled = (F.when(v.isNotNull(), v)
              .when(y0.isNotNull() & y1.isNotNull(), interp)
              .otherwise(F.coalesce(y0, y1, F.lit(0.0))))
    return series.withColumn(value, filled)


def expand_calendar(observed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """J8 in one lineage: every observed day expands to itself plus the
    missing days up to the next observed day (``lead`` + ``sequence``), the
    missing ones with a NULL value. Same rows as ``calendar ⟕ observed``
    without a second pass over the observed days."""
    keys = list(keys or [])
    nxt = F.lead("date").over(_w(keys))
    upto = F.coalesce(F.date_sub(nxt, 1), F.col("date"))
    return (observed.withColumn("_upto", upto)
            .select(*keys, "date", TARGET_COLUMN, F.explode(F.sequence(F.col("date"), F.col("_upto"))).alias("_d"))
            .select(*keys, F.col("_d").alias("date"),
                    F.when(F.col("_d") == F.col("date"), F.col(TARGET_COLUMN)).alias(TARGET_COLUMN)))


def daily_series(oc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """gap-free daily revenue series (date, daily_revenue)."""
    keys = list(keys or [])
    return fill_gaps(expand_calendar(observed_daily(oc, keys), keys), keys).select(*keys, "date", TARGET_COLUMN)


def _calendar_features(d: Column) -> dict[str, Column]:
    dow = iso_dow(d)
    return {
        "day_of_week": dow.cast("double"),
        "day_of_month": F.dayofmonth(d).cast("double"),
        "month": F.month(d).cast("double"),
        "quarter": F.quarter(d).cast("double"),
        "is_weekend": F.when(dow.isin(5, 6), 1.0).otherwise(0.0),
    }


def _count_of(xs: list[Column]) -> Column:
    total = F.lit(0)
    for x in xs:
        total = total + F.when(x.isNotNull(), 1).otherwise(0)
    return total


def _sum_of(xs: list[Column]) -> Column:
    total = F.coalesce(xs[0], F.lit(0.0))
    for x in xs[1:]:
        total = total + F.coalesce(x, F.lit(0.0))
    return total


def _mean_of(xs: list[Column]) -> Column:
    """Mean of the non-NULL values (NULL when all are NULL), min_periods = 1."""
    n = _count_of(xs)
    return F.when(n > 0, _sum_of(xs) / n)


def _pop_std_of(xs: list[Column]) -> Column:
    """Population std of the non-NULL values; 0 with fewer than two."""
    n = _count_of(xs)
    mean = _sum_of(xs) / n
    sq = [F.when(x.isNotNull(), (x - mean) * (x - mean)) for x in xs]
    return F.when(n >= 2, F.sqrt(_sum_of(sq) / n)).otherwise(F.lit(0.0))


def time_features(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """the 14 features in fixed order.

    Lags and rolling statistics look only at *previous* days; leading gaps
    are back-filled (row 0 takes row 1's value), then 0.
    """
    keys = list(keys or [])
    w = _w(keys)
    r = F.coalesce(F.col(TARGET_COLUMN).cast("double"), F.lit(0.0))
    base = series.withColumn(TARGET_COLUMN, r)
    r = F.col(TARGET_COLUMN)
    feats: dict[str, Column] = _calendar_features(F.col("date"))
    for k in LAGS:
        feats[f"lag_{k}"] = F.lag(r, k).over(w)
    # rolling statistics over the previous n days, written as an explicit
    # left-to-right sum of lags: the same arithmetic on every engine and run
    lags = {k: F.lag(r, k).over(w) for k in range(1, max(*ROLLING_MEANS, ROLLING_STD_WINDOW) + 1)}
    for n in ROLLING_MEANS:
        feats[f"rolling_mean_{n}"] = _mean_of([lags[k] for k in range(1, n + 1)])
    feats[f"rolling_std_{ROLLING_STD_WINDOW}"] = _pop_std_of([lags[k] for k in range(1, ROLLING_STD_WINDOW + 1)])
    feats["revenue_change_1"] = lags[1] - lags[2]
    raw = base.select(*keys, "date", TARGET_COLUMN, *[feats[c].alias(c) for c in FEATURE_COLUMNS])
    before, after = _running(keys), _running(keys, descending=True)
    filled = raw.select(*keys, "date", TARGET_COLUMN, *[
        F.coalesce(F.col(c), F.last(c, True).over(before)).alias(c) for c in FEATURE_COLUMNS])
    return filled.select(*keys, "date", TARGET_COLUMN, *[
        F.coalesce(F.col(c), F.last(c, True).over(after), F.lit(0.0)).cast("double").alias(c)
        for c in FEATURE_COLUMNS])


def feature_frame(oc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F1 + F2: the model-ready daily frame."""
    return time_features(daily_series(oc, keys), keys)


def next_day_features(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """features of the day after the last one, with short-history fallbacks
    (lag_2/lag_3 -> last value, lag_7 -> first value, std of < 2 values -> 0)."""
    keys = list(keys or [])
    wd = (Window.partitionBy(*keys) if keys else Window).orderBy(F.desc("date"))
    r = F.col(TARGET_COLUMN).cast("double")
    ranked = series.withColumn("_rn", F.row_number().over(wd))
    at = lambda k: F.max(F.when(F.col("_rn") == k, r))
    within = lambda n: F.when(F.col("_rn") <= n, r)
    agg = ranked.groupBy(*keys).agg(
        F.max("date").alias("_last"), F.count(F.lit(1)).alias("_n"),
        at(1).alias("_v1"), at(2).alias("_v2"), at(3).alias("_v3"), at(7).alias("_v7"),
        F.min_by(r, F.col("date")).alias("_first"),
        *[F.avg(within(n)).alias(f"_m{n}") for n in ROLLING_MEANS],
        F.stddev_pop(within(ROLLING_STD_WINDOW)).alias("_s7"),
        F.count(within(ROLLING_STD_WINDOW)).alias("_c7"))
    d = F.date_add(F.col("_last"), 1)
    n = F.col("_n")
    feats = _calendar_features(d)
    feats.update({
        "lag_1": F.col("_v1"),
        "lag_2": F.when(n >= 2, F.col("_v2")).otherwise(F.col("_v1")),
        "lag_3": F.when(n >= 3, F.col("_v3")).otherwise(F.col("_v1")),
        "lag_7": F.when(n >= 7, F.col("_v7")).otherwise(F.col("_first")),
        **{f"rolling_mean_{m}": F.col(f"_m{m}") for m in ROLLING_MEANS},
        f"rolling_std_{ROLLING_STD_WINDOW}": F.when(F.col("_c7") >= 2, F.col("_s7")).otherwise(F.lit(0.0)),
        "revenue_change_1": F.when(n >= 2, F.col("_v1") - F.col("_v2")).otherwise(F.lit(0.0)),
    })
    return agg.select(*keys, d.alias("date"), *[feats[c].cast("double").alias(c) for c in FEATURE_COLUMNS])


def clean_training(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """require the columns, turn +-inf/NaN into NULL and drop those rows."""
    keys = list(keys or [])
    need = FEATURE_COLUMNS + [TARGET_COLUMN]
    missing = [c for c in need if c not in features.columns]
    if missing:
        raise ValueError(f"training needs the columns {missing}")
    cols = [c for c in (*keys, "date") if c in features.columns]
    return (features.select(*cols, *[finite_or_null(c).alias(c) for c in need])
            .dropna(subset=need))


def time_split(clean: DataFrame, keys: list[str] | None = None,
               fraction: float = TRAIN_FRACTION) -> DataFrame:
    """first floor(f*n) days train (at least 1, at most n-1); n < 5 -> all train.

    Adds ``split`` ('train' / 'test') and ``position`` (1-based by date).
    """
    keys = list(keys or [])
    w = _w(keys)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    n = F.count(F.lit(1)).over(whole)
    cut = F.least(F.greatest(F.floor(n * F.lit(float(fraction))), F.lit(1)), n - 1)
    return (clean.withColumn("position", F.row_number().over(w).cast("bigint"))
            .withColumn("_n", n)
            .withColumn("split", F.when((F.col("_n") < MIN_ROWS_FOR_SPLIT) | (F.col("position") <= cut),
                                        F.lit("train")).otherwise(F.lit("test")))
            .drop("_n"))


def detect_anomalies(series: DataFrame, keys: list[str] | None = None, z: float = Z_THRESHOLD) -> DataFrame:
    """calendar days (gap-filled series) with |z| > threshold; none if sigma is 0.

    Mean and sigma are a grouped (per key) aggregate joined back, not an
    unpartitioned window.
    """
    keys = list(keys or [])
    r = F.col(TARGET_COLUMN).cast("double")
    stats = series.groupBy(*keys).agg(F.avg(r).alias("_mu"), F.stddev_pop(r).alias("_sd"))
    joined = series.crossJoin(F.broadcast(stats)) if not keys else series.join(stats, keys)
    zc = (r - F.col("_mu")) / F.col("_sd")
    return (joined.where(F.col("_sd") != 0)
            .select(*keys, "date", r.alias("revenue"), zc.alias("z_score"))
            .where(F.abs("z_score") > z)
            .orderBy(*keys, "date"))
