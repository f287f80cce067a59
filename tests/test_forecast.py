"""Forecast operators (rows and properties; values differ from other learners)."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from pyspark.sql import functions as F

from shoplens.plans import forecast as FC
from shoplens.plans import timeseries as TS
from shoplens.schema import FEATURE_COLUMNS


def series(spark, n=40):
    vals = [100.0 + (i % 7) * 10 + i for i in range(n)]
    return spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)],
                                 "date date, daily_revenue double")


def test_train_predict_metrics_and_drivers(spark, tmp_dir):
    s = series(spark)
    split = TS.time_split(TS.clean_training(TS.time_features(s))).cache()
    model = FC.train_forecast(split)
    metrics = FC.forecast_metrics(FC.by_model(model), split)
    m = metrics.first()
    assert m.training_rows == 32 and m.test_rows == 8 and m.mae >= 0 and m.residual_std >= 0
    nxt = TS.next_day_features(s)
    pred = FC.predict_next(FC.by_model(model), nxt, metrics).first()
    assert pred.predicted_revenue >= 0 and pred.lower_bound <= pred.predicted_revenue <= pred.upper_bound
    fixed = spark.createDataFrame([(10.0,)], "residual_std double")
    p2 = FC.predict_next(FC.by_model(model), nxt, fixed).first()
    assert abs(p2.upper_bound - p2.predicted_revenue - 10.0) < 1e-9
    imp = FC.feature_importance(model, split.where("split = 'train'")).collect()
    assert sorted(r.feature for r in imp) == sorted(FEATURE_COLUMNS)
    drivers = FC.prediction_drivers(model, nxt, 3).collect()
    assert len(drivers) == 3 and all(r.feature in FEATURE_COLUMNS for r in drivers)
    FC.save_model(model, metrics, spark.createDataFrame(imp), f"{tmp_dir}/m")
    stored = FC.load_metrics(spark, f"{tmp_dir}/m").first()
    assert stored.test_rows == 8 and stored.features == FEATURE_COLUMNS
    assert stored.model_version.startswith("HistogramBoosting-") and stored.last_trained_at
    assert FC.load_importance(spark, f"{tmp_dir}/m", 5).count() == 5
    loaded = FC.load_model(spark, f"{tmp_dir}/m")
    assert loaded.agg(F.max("tree")).first()[0] == 160 and loaded.where("feature IS NULL").groupBy("tree").count().agg(F.max("count")).first()[0] <= 8
    assert FC.by_model(loaded)(nxt).first().prediction == FC.by_model(model)(nxt).first().prediction


def test_untrained_metrics_are_null(spark, tmp_dir):
    r = FC.load_metrics(spark, f"{tmp_dir}/none").first()
    assert r.mae is None and r.model_type == "HistogramBoosting" and r.features == FEATURE_COLUMNS


def test_broken_store_raises(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/metrics")
    with open(f"{tmp_dir}/metrics/part-0.json", "w") as f:
        f.write('{"model_type": 1, "mae": "x"')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        FC.load_metrics(spark, tmp_dir).collect()


def test_no_test_rows_gives_zeros(spark):
    split = TS.time_split(TS.clean_training(TS.time_features(series(spark, 4))))
    model = FC.train_forecast(split)
    m = FC.forecast_metrics(FC.by_model(model), split).first()
    assert m.test_rows == 0 and m.mae == 0.0 and m.training_rows == 4
    assert split.where(F.col("split") == "test").count() == 0


def test_a_model_for_each_state(spark):
    keys = ["state"]
    one = series(spark)
    both = (one.withColumn("state", F.lit("A")).unionByName(one.withColumn("daily_revenue", F.col("daily_revenue") * 3).withColumn("state", F.lit(None).cast("string")))
            .unionByName(one.limit(3).withColumn("state", F.lit("short"))))
    split = TS.time_split(TS.clean_training(TS.time_features(both, keys), keys), keys)
    nodes = FC.train_forecast(split, keys)
    alone = TS.time_split(TS.clean_training(TS.time_features(one)))
    single = FC.train_forecast(alone)
    mine = nodes.where("state = 'A'").select(*single.columns)
    assert sorted(map(str, mine.collect())) == sorted(map(str, single.collect()))
    metrics = FC.forecast_metrics(FC.by_model(nodes, keys), split, keys)
    m = {r.state: r for r in metrics.collect()}
    want = FC.forecast_metrics(FC.by_model(single), alone).first()
    assert set(m) == {"A", None, "short"} and m["short"].test_rows == 0 and m["short"].mae == 0.0 and m["short"].training_rows == 3
    assert m["A"].mae == pytest.approx(want.mae) and m[None].test_rows == want.test_rows
    nxt = TS.next_day_features(both, keys)
    pred = {r.state: r for r in FC.predict_next(FC.by_model(nodes, keys), nxt, metrics, keys).collect()}
    assert set(pred) == set(m) and all(p.lower_bound <= p.predicted_revenue <= p.upper_bound for p in pred.values())
    assert FC.prediction_drivers(nodes, nxt, 3, keys).groupBy("state").count().where("count = 3").count() == 3
    imp = FC.feature_importance(nodes, split.where("split = 'train'"), keys=keys).collect()
    assert len(imp) == 3 * len(FEATURE_COLUMNS)


def test_unknown_series_has_no_prediction(spark):
    keys = ["state"]
    split = TS.time_split(TS.clean_training(TS.time_features(series(spark).withColumn("state", F.lit("A")), keys), keys), keys)
    other = split.withColumn("state", F.lit("B"))
    assert FC.by_model(FC.train_forecast(split, keys), keys)(other).where("prediction IS NOT NULL").count() == 0
