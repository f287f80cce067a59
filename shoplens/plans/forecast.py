"""Next-day revenue forecast (F6..F10, F12).

The learner is ``plans.boosting`` with the reference's settings (160 trees,
depth 3, rate 0.05, 90% of the rows and of the columns a tree, seed 42); its
random draws are its own, so that predictions are comparable but not equal in
value to another library's. Feature attributions are the Shapley values of the
trees (``plans.attribution``). All functions take ``keys``: without any there is
one series, with keys (e.g. the state) a model a series, trained in the same job.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.plans import attribution as AT
from shoplens.plans import boosting as BO
from shoplens.schema import FEATURE_COLUMNS, MODEL_SETTINGS, TARGET_COLUMN, TOP_DRIVERS
from shoplens.session import materialize, path_exists

#: rows with the feature columns -> the same rows with ``prediction``
Score = Callable[[DataFrame], DataFrame]

MODEL_TYPE = "HistogramBoosting"
METRIC_COLUMNS = ["mae", "rmse", "mape", "baseline_mae", "baseline_rmse", "baseline_mape",
                  "baseline_improvement_pct", "residual_std", "training_rows", "test_rows"]


def train_forecast(split: DataFrame, keys: list[str] | None = None, settings: dict | None = None) -> DataFrame:
    """the node table of a model a series, fitted on the ``split == 'train'``
    rows (error if there are none) and written once."""
    train = split.where(F.col("split") == "train")
    if train.limit(1).count() == 0:
        raise ValueError("no day is left to train on")
    nodes = BO.train(train, list(keys or []), FEATURE_COLUMNS, TARGET_COLUMN, {**MODEL_SETTINGS, **(settings or {})})
    return materialize(nodes, "forest")


def by_model(nodes: DataFrame, keys: list[str] | None = None) -> Score:
    return BO.scorer(nodes, list(keys or []), FEATURE_COLUMNS)


def _errors(y, p) -> list:
    e = y - p
    nz = y != 0
    return [F.avg(F.abs(e)), F.sqrt(F.avg(e * e)),
            F.coalesce(F.avg(F.when(nz, F.abs(e / y))) * 100.0, F.lit(0.0))]


def forecast_metrics(score: Score, split: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """model and lag_1-baseline MAE / RMSE / MAPE on the test days,
    improvement %, residual population std, row counts; zeros without test days.
    ``score`` adds ``prediction`` to rows with the features. A row a series."""
    keys = list(keys or [])
    scored = score(split.where(F.col("split") == "test"))
    y, p, b = F.col(TARGET_COLUMN), F.col("prediction"), F.col("lag_1")
    mae, rmse, mape = _errors(y, p)
    bmae, brmse, bmape = _errors(y, b)
    test = scored.groupBy(*keys).agg(
        mae.alias("mae"), rmse.alias("rmse"), mape.alias("mape"),
        bmae.alias("baseline_mae"), brmse.alias("baseline_rmse"), bmape.alias("baseline_mape"),
        F.stddev_pop(y - p).alias("residual_std"), F.count(F.lit(1)).alias("test_rows"))
    train_n = split.groupBy(*keys).agg(F.count(F.when(F.col("split") == "train", 1)).alias("training_rows"))
    both = BO.on_series(train_n, test, keys, test.columns[len(keys):])
    tests = F.coalesce("test_rows", F.lit(0))
    imp = F.when(F.col("baseline_mae") > 0,
                 (F.col("baseline_mae") - F.col("mae")) / F.col("baseline_mae") * 100.0).otherwise(F.lit(0.0))
    zero = lambda c: F.when(tests == 0, F.lit(0.0)).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    return both.select(*keys, F.lit(MODEL_TYPE).alias("model_type"),
                       *[zero(c).alias(c) for c in ("mae", "rmse", "mape", "baseline_mae", "baseline_rmse", "baseline_mape")],
                       F.when(tests == 0, F.lit(0.0)).otherwise(imp).alias("baseline_improvement_pct"),
                       zero("residual_std").alias("residual_std"),
                       F.col("training_rows").cast("bigint"), tests.cast("bigint").alias("test_rows"))


def predict_next(score: Score, next_features: DataFrame, metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F8: next-day prediction clamped at 0, band max(0, p - sigma) .. p + sigma."""
    keys = list(keys or [])
    spread = metrics.select(*keys, F.coalesce(F.col("residual_std"), F.lit(0.0)).alias("_sd"))  # a row a series
    p, sd = F.greatest(F.col("prediction"), F.lit(0.0)), F.coalesce("_sd", F.lit(0.0))
    return (BO.on_series(score(next_features), spread, keys, ["_sd"])
            .select(*keys, "date", p.alias("predicted_revenue"),
                    F.greatest(p - sd, F.lit(0.0)).alias("lower_bound"), (p + sd).alias("upper_bound")))


def _occlusion_effects(score: Score, rows: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per (input row, feature): the prediction, less the one with that
    feature replaced by its mean over ``reference``."""
    n = len(FEATURE_COLUMNS)
    means = reference.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in FEATURE_COLUMNS])
    doubles = [F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS]
    whole = (score(rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", *doubles))
             .withColumnRenamed("prediction", "_p"))
    each = whole.crossJoin(F.broadcast(means)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    changed = [F.when(F.col("_j") == j, F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) for j, c in enumerate(FEATURE_COLUMNS)]
    names = F.array(*[F.lit(c) for c in FEATURE_COLUMNS])
    return score(each.select("_row", "_j", "_p", *changed)).select(
        "_row", names[F.col("_j")].alias("feature"), F.col("_j").alias("feature_index"),
        (F.col("_p") - F.col("prediction")).alias("impact"))


def occlusion_drivers(score: Score, next_features: DataFrame, train: DataFrame, n: int = TOP_DRIVERS) -> DataFrame:
    """For a predictor without trees: the ``n`` features whose replacement by
    their training mean changes the next-day prediction most."""
    eff = _occlusion_effects(score, next_features, train)
    values = next_features.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in FEATURE_COLUMNS]))
                                  .alias("feature_index", "value"))
    return (eff.join(values, "feature_index")
            .orderBy(F.desc(F.abs("impact")), "feature_index").limit(int(n))
            .select("feature", "value", "impact"))


def feature_importance(nodes: DataFrame, train: DataFrame, n: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """mean |Shapley value| of each feature over the training days, ranked; the first ``n`` if given."""
    keys = list(keys or [])
    ranked = (AT.mean_impact(nodes, train, keys, FEATURE_COLUMNS)
              .orderBy(*keys, F.desc("mean_abs_shap"), "feature_index").select(*keys, "feature", "mean_abs_shap"))
    return ranked.limit(int(n)) if n else ranked


def prediction_drivers(nodes: DataFrame, next_features: DataFrame, n: int = TOP_DRIVERS,
                       keys: list[str] | None = None) -> DataFrame:
    """the ``n`` features with the largest |Shapley value| for the next-day prediction."""
    keys = list(keys or [])
    impacts = AT.row_impacts(nodes, next_features, keys, FEATURE_COLUMNS)
    return AT.top_impacts(impacts, keys, n).select(*keys, "feature", "value", "impact")


def training_split(oc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F1..F5 of the fact, written once: one row per series and calendar day."""
    from shoplens.plans import timeseries as TS

    split = TS.time_split(TS.clean_training(TS.time_features(TS.daily_series(oc, keys), keys), keys), keys)
    return materialize(split if keys else split.coalesce(1), "forecast_split")


def train_and_save(oc: DataFrame, path: str, split: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """F1..F9 + F12 in one call: series, features, split, fit, metrics,
    importance, all saved under ``path``; returns the stored metrics.
    ``split`` may be passed when the caller already built (and wrote) it."""
    if split is None:
        split = training_split(oc, keys)
    nodes = train_forecast(split, keys)
    metrics = forecast_metrics(by_model(nodes, keys), split, keys)
    importance = feature_importance(nodes, split.where(F.col("split") == "train"), keys=keys)
    save_model(nodes, metrics, importance, path)
    return load_metrics(oc.sparkSession, path, keys)


# ---- F12 persistence -------------------------------------------------------------------------


def _metrics_schema(keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` string" for k in keys), "model_type string", *(f"{c} double" for c in METRIC_COLUMNS[:-2]),
                      "training_rows bigint", "test_rows bigint", "model_version string", "features array<string>",
                      "last_trained_at string"])


def save_model(nodes: DataFrame, metrics: DataFrame, importance: DataFrame, path: str) -> None:
    """The model's nodes, its metrics with version, features and time, and the importances."""
    nodes.write.mode("overwrite").parquet(f"{path}/model")
    now = dt.datetime.now(dt.timezone.utc)
    (metrics.withColumns({"model_version": F.lit(f"{MODEL_TYPE}-{now:%Y%m%d%H%M%S}"),
                          "features": F.array(*[F.lit(c) for c in FEATURE_COLUMNS]),
                          "last_trained_at": F.lit(now.isoformat(timespec="seconds"))})
     .coalesce(1).write.mode("overwrite").json(f"{path}/metrics"))
    importance.coalesce(1).write.mode("overwrite").json(f"{path}/importance")


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """The node table; raises if there is none."""
    return spark.read.parquet(f"{path}/model")


def load_importance(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """F9 as saved, largest first; the first ``n`` if given."""
    df = (spark.read.schema("feature string, mean_abs_shap double").json(f"{path}/importance")
          .orderBy(F.desc("mean_abs_shap"), "feature"))
    return df.limit(int(n)) if n else df


def load_metrics(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Stored metrics, or one row of NULL metrics when nothing was trained
    (no folder). A store that is there and can't be read raises."""
    schema = _metrics_schema(list(keys or []))
    if path_exists(spark, f"{path}/metrics"):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/metrics")
    row = {"model_type": MODEL_TYPE, "features": list(FEATURE_COLUMNS)}
    return spark.createDataFrame([row], schema)
