"""Shapley attributions of boosted trees, by paths.

The value of a set of features S for a row is the prediction in which a node
whose feature is in S sends the row its way, and any other node sends it both
ways in the shares of its cover. A leaf with value v, whose path has the
distinct features D with shares z_j, contributes ``v * prod(j in S: o_j) *
prod(j not in S: z_j)`` to that, o_j = 1 if the row meets the path's condition
on j and 0 otherwise. So the Shapley value of i in D is

    v (o_i - z_i) sum over S in D without i of |S|! (d-|S|-1)! / d! prod(S: o) prod(rest: z)

and the sum over S is taken by size from the polynomial prod(z_j + o_j t). It
depends on the row only through which conditions hold: 2^d patterns a path. The
impacts of all patterns are therefore a small table made once from the model;
explaining rows is a join with the paths of their series, a pattern, and a sum
by row and feature. Attributions of a row and the expected value add up to
its prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.plans.boosting import follows, on_series, paths


def _bit(pattern: Column, k: Column) -> Column:
    return F.floor(pattern / F.pow(F.lit(2), k)) % 2


def _pattern_impacts(pattern: Column, value: Column, shares: Column) -> Column:
    """Impact of each of a path's features when the conditions in ``pattern`` hold."""
    d = F.size(shares)
    places = F.filter(F.sequence(F.lit(0), d), lambda k: k < d)  # none for a tree without a split

    def one(i: Column) -> Column:
        def times(poly: Column, j: Column) -> Column:
            o, z = _bit(pattern, j).cast("double"), shares[j]
            longer = F.sequence(F.lit(0), F.size(poly))
            return F.transform(longer, lambda k: F.coalesce(F.get(poly, k), F.lit(0.0)) * z
                               + F.coalesce(F.get(poly, k - 1), F.lit(0.0)) * o)

        others = F.filter(places, lambda j: j != i)
        by_size = F.aggregate(others, F.array(F.lit(1.0)), times)
        weight = lambda k: F.factorial(k) * F.factorial(d - k - 1) / F.factorial(d)
        inner = F.aggregate(F.sequence(F.lit(0), d - 1), F.lit(0.0), lambda acc, k: acc + by_size[k] * weight(k))
        return value * (_bit(pattern, i) - shares[i]) * inner

    return F.transform(places, one)


def path_impacts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`paths` and ``impacts``: for each pattern the impacts of the path's features."""
    shares = F.transform("conds", lambda c: c["share"])
    patterns = F.sequence(F.lit(0), F.pow(F.lit(2), F.size("conds")).cast("int") - 1)
    return (paths(nodes, keys).withColumn("_shares", shares)
            .withColumn("impacts", F.transform(patterns, lambda p: _pattern_impacts(p, F.col("value"), F.col("_shares"))))
            .drop("_shares"))


def expected_value(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """A row a series: ``expected``, the prediction when no feature is known."""
    whole = F.aggregate("conds", F.lit(1.0), lambda acc, c: acc * c["share"])
    return paths(nodes, keys).groupBy(*keys).agg(F.sum(F.col("value") * whole).alias("expected"))


def attributions(nodes: DataFrame, rows: DataFrame, keys: list[str], features: list[str], row_id: str = "date") -> DataFrame:
    """(keys, row_id, feature_index, impact) of the features that any path uses;
    ``row_id`` tells the rows of a series apart."""
    per_series = path_impacts(nodes, keys).groupBy(*keys).agg(F.collect_list(F.struct("conds", "impacts")).alias("_paths"))
    x = F.array(*(F.col(f).cast("double") for f in features)).alias("_x")
    # few rows, each met by all paths of its series: spread by row, which the sum below needs as well
    spread = rows.select(*keys, row_id, x).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, row_id)
    each = on_series(spread, per_series, keys, ["_paths"])
    each = each.select(*keys, row_id, "_x", F.explode("_paths").alias("p"))
    places = F.filter(F.sequence(F.lit(0), F.size("p.conds")), lambda k: k < F.size("p.conds"))
    pattern = F.aggregate(places, F.lit(0), lambda acc, k: acc + F.when(
        follows(F.col("_x"), F.col("p.conds")[k]), F.pow(F.lit(2), k).cast("int")).otherwise(0))
    pairs = each.select(*keys, row_id, F.explode(F.arrays_zip(
        F.transform("p.conds", lambda c: c["feature"]).alias("f"), F.col("p.impacts")[pattern].alias("v"))).alias("e"))
    return pairs.groupBy(*keys, row_id, F.col("e.f").alias("feature_index")).agg(F.sum("e.v").alias("impact"))


def _every_feature(per_series: DataFrame, features: list[str]) -> DataFrame:
    names = F.array(*(F.lit(f) for f in features))
    return per_series.select("*", F.posexplode(names).alias("feature_index", "feature"))


def mean_impact(nodes: DataFrame, rows: DataFrame, keys: list[str], features: list[str], row_id: str = "date") -> DataFrame:
    """(keys, feature, feature_index, mean_abs_shap): mean size of the impacts over ``rows``, 0 for unused features."""
    sums = (attributions(nodes, rows, keys, features, row_id).groupBy(*keys, "feature_index")
            .agg(F.sum(F.abs("impact")).alias("_sum")))
    spine = _every_feature(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), features)
    return _joined(spine, sums, keys, "_sum").select(
        *keys, "feature", "feature_index",
        F.when(F.col("_n") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("_n")).otherwise(0.0).alias("mean_abs_shap"))


def _joined(spine: DataFrame, values: DataFrame, keys: list[str], name: str) -> DataFrame:
    other = values.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("feature_index").alias("_of"), name)
    on = F.col("feature_index") == F.col("_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return spine.join(other, on, "left")


def row_impacts(nodes: DataFrame, rows: DataFrame, keys: list[str], features: list[str], row_id: str = "date") -> DataFrame:
    """(keys, row_id, feature, feature_index, value, impact): every feature of every row, 0 for unused ones."""
    values = F.array(*(F.col(f).cast("double") for f in features))
    spine = _every_feature(rows.select(*keys, row_id, values.alias("_values")), features)
    spine = spine.select(*keys, row_id, "feature", "feature_index", F.col("_values")[F.col("feature_index")].alias("value"))
    return _joined(spine, attributions(nodes, rows, keys, features, row_id), [*keys, row_id], "impact").select(
        *keys, row_id, "feature", "feature_index", "value", F.coalesce("impact", F.lit(0.0)).alias("impact"))


def top_impacts(impacts: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` largest impacts by size of each group, ties by feature order."""
    order = [F.desc(F.abs("impact")), F.col("feature_index")]
    if not by:
        return impacts.orderBy(*order).limit(int(n))
    return (impacts.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
            .where(F.col("_k") <= int(n)).drop("_k"))
