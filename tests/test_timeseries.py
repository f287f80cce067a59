"""Daily series and features (the reference's own cases plus T10)."""

from __future__ import annotations

import datetime as dt

from shoplens.plans import timeseries as TS
from shoplens.schema import FEATURE_COLUMNS
from tests.frames import clean_frame, row


def four_rows(spark):
    return clean_frame(spark, [row("a", "c", "p", "2024-01-01", 10), row("b", "c", "p", "2024-01-01", 15),
                               row("c", "c", "p", "2024-01-03", 30), row("d", "c", "p", "2024-01-08", 40)])


def test_daily_dataset_eight_days_no_nulls(spark):
    feats = TS.feature_frame(four_rows(spark))
    assert feats.count() == 8
    assert {"date", "daily_revenue", *FEATURE_COLUMNS} <= set(feats.columns)
    nulls = feats.select([sum_nulls(c) for c in ["daily_revenue", *FEATURE_COLUMNS]]).first()
    assert sum(nulls) == 0


def sum_nulls(c):
    from pyspark.sql import functions as F
    return F.sum(F.col(c).isNull().cast("int")).alias(c)


def test_interpolation_and_backfill(spark):
    s = {r.date: r.daily_revenue for r in TS.daily_series(four_rows(spark)).collect()}
    assert s[dt.date(2024, 1, 2)] == 27.5          # between 25 and 30
    assert s[dt.date(2024, 1, 5)] == 30 + 10 * 2 / 5
    f = TS.feature_frame(four_rows(spark)).orderBy("date").collect()
    assert f[0].lag_1 == 25.0 and f[0].rolling_mean_3 == 25.0   # back-filled from row 1
    assert f[0].lag_7 == 25.0                                   # row 7's lag_7 = first value
    assert f[1].rolling_std_7 == 0.0 and f[2].rolling_std_7 == 1.25
    assert [c for c in f[0].asDict() if c in FEATURE_COLUMNS] == FEATURE_COLUMNS


def test_next_day_features_short_history(spark):
    series = spark.createDataFrame([(dt.date(2024, 1, 1), 100.0), (dt.date(2024, 1, 2), 120.0)],
                                   "date date, daily_revenue double")
    r = TS.next_day_features(series).first()
    assert r.date == dt.date(2024, 1, 3)
    assert (r.lag_1, r.lag_2, r.lag_3, r.lag_7) == (120.0, 100.0, 120.0, 100.0)
    assert r.rolling_std_7 == 10.0 and r.revenue_change_1 == 20.0
    assert list(r.asDict())[1:] == FEATURE_COLUMNS
    one = TS.next_day_features(series.limit(1)).first()
    assert one.rolling_std_7 == 0.0 and one.revenue_change_1 == 0.0


def test_time_split_rules(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(10)]
    df = spark.createDataFrame(days, "date date, daily_revenue double")
    split = {r.position: r.split for r in TS.time_split(df).collect()}
    assert [split[i] for i in range(1, 11)] == ["train"] * 8 + ["test"] * 2
    small = TS.time_split(df.limit(4)).collect()
    assert {r.split for r in small} == {"train"}


def test_anomalies_zero_variance_and_keys(spark):
    flat = spark.createDataFrame([(dt.date(2024, 1, i), 5.0) for i in range(1, 10)], "date date, daily_revenue double")
    assert TS.detect_anomalies(flat).count() == 0
    spiky = flat.union(spark.createDataFrame([(dt.date(2024, 1, 10), 500.0)], flat.schema))
    for i in range(11, 21):
        spiky = spiky.union(spark.createDataFrame([(dt.date(2024, 1, i), 5.0)], flat.schema))
    out = TS.detect_anomalies(spiky).collect()
    assert [r.date for r in out] == [dt.date(2024, 1, 10)]
    keyed = TS.daily_series(clean_frame(spark, [row("a", "c", "p", "2024-01-01", 1, state="X"),
                                                row("b", "c", "p", "2024-01-03", 3, state="X"),
                                                row("c", "c", "p", "2024-01-02", 7, state="Y")]),
                            ["customer_state"])
    got = sorted((r.customer_state, str(r.date), r.daily_revenue) for r in keyed.collect())
    assert got == [("X", "2024-01-01", 1.0), ("X", "2024-01-02", 2.0), ("X", "2024-01-03", 3.0),
                   ("Y", "2024-01-02", 7.0)]
