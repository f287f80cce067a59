"""gradient-boosted trees for all series in one job, as a table of nodes.

A series' training rows are its days, bounded by the calendar, so one shuffle
brings each series to a task and all series are trained by the same job, one
series or a million. Within the task a tree is grown level by level from
histograms of the gradient per (node, feature, bin). The learner follows the
published second-order boosting for squared loss: gain ``GL^2/(HL+l) + GR^2/(HR+l)
- G^2/(H+l)``, leaf ``-G/(H+l)`` times the learning rate, l = 1, at least one row
on each side; each tree sees its own sample of rows and of columns.

The model is an ordinary table, a row a node: the series' keys, ``tree`` (0 is
the base value), ``node`` (heap numbers: children of i are 2i and 2i + 1),
``feature`` (null: a leaf), ``threshold`` (left: not above it), ``cover`` (sampled
training rows that reach the node) and ``value`` (of a leaf). :func:`paths`
turns it into root-to-leaf paths, by which :func:`predict` scores rows and
``plans.attribution`` explains them, both with SQL functions only.

Features must not be null. A key that is null is a series of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_FIELDS = "tree int, node int, feature int, threshold double, cover double, value double"
#: ridge term of a leaf, least gain of a split, most bins of a feature
RIDGE, LEAST_GAIN, BINS = 1.0, 1e-6, 256


# ---- growing trees (numpy, one series) ------------------------------------------------


def _cuts(x: np.ndarray) -> np.ndarray:
    """Thresholds of a feature: between neighbours of its values, or of ``BINS`` quantiles."""
    u = np.unique(x)
    if len(u) > BINS:
        u = np.unique(np.quantile(x, np.linspace(0, 1, BINS), method="nearest"))
    return (u[:-1] + u[1:]) / 2


def _best_splits(code, g, at, n_nodes: int, allowed: np.ndarray, width: int):
    """Of each node the best (gain, feature, bin) over the histograms of its rows."""
    n_feat = code.shape[1]
    cell = ((at[:, None] * n_feat + np.arange(n_feat)) * width + code).ravel()
    shape = (n_nodes, n_feat, width)
    gl = np.bincount(cell, np.repeat(g, n_feat), n_nodes * n_feat * width).reshape(shape).cumsum(axis=2)
    hl = np.bincount(cell, minlength=n_nodes * n_feat * width).reshape(shape).cumsum(axis=2)
    gt, ht = gl[:, :, -1:], hl[:, :, -1:]
    gr, hr = gt - gl, ht - hl
    gain = gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE) - gt ** 2 / (ht + RIDGE)
    gain[(hl < 1) | (hr < 1) | ~allowed[None, :, None]] = -np.inf
    flat = gain.reshape(n_nodes, -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(n_nodes), best], best // width, best % width


def grow(x: np.ndarray, y: np.ndarray, settings: dict) -> list[tuple]:
    """All nodes of a boosted model: (tree, node, feature, threshold, cover, value)."""
    n, n_feat = x.shape
    cuts = [_cuts(x[:, f]) for f in range(n_feat)]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    base = float(y.mean())
    rows, predicted = [(0, 1, None, None, float(n), base)], np.full(n, base)
    draw = np.random.RandomState(settings["seed"])
    n_cols = max(1, int(settings["column_sample"] * n_feat))
    for tree in range(1, settings["n_trees"] + 1):
        used = draw.random_sample(n) < settings["row_sample"] if settings["row_sample"] < 1 else np.ones(n, bool)
        allowed = np.zeros(n_feat, bool)
        allowed[draw.choice(n_feat, n_cols, replace=False) if n_cols < n_feat else slice(None)] = True
        g, node = predicted - y, np.ones(n, np.int64)
        open_ = np.array([1])
        for depth in range(settings["max_depth"] + 1):
            at = np.searchsorted(open_, node)
            here = (at < len(open_)) & (open_[np.minimum(at, len(open_) - 1)] == node)
            mine = here & used
            total = np.bincount(at[mine], g[mine], len(open_))
            cover = np.bincount(at[mine], minlength=len(open_)).astype(float)
            gain = np.full(len(open_), -np.inf)
            if depth < settings["max_depth"]:
                gain, feature, cut = _best_splits(code[mine], g[mine], at[mine], len(open_), allowed, width)
            split = gain > LEAST_GAIN
            for k, i in enumerate(open_.tolist()):
                if split[k]:
                    rows.append((tree, i, int(feature[k]), float(cuts[feature[k]][cut[k]]), cover[k], None))
                else:
                    value = -total[k] / (cover[k] + RIDGE) * settings["learning_rate"]
                    rows.append((tree, i, None, None, cover[k], float(value)))
                    predicted[here & (at == k)] += value
            if not split.any():
                break
            moved = np.flatnonzero(here & split[np.minimum(at, len(open_) - 1)])
            k = at[moved]
            node[moved] = 2 * node[moved] + (code[moved, feature[k]] > cut[k])
            open_ = np.sort(np.concatenate([2 * open_[split], 2 * open_[split] + 1]))
    return rows


def train(rows: DataFrame, keys: list[str], features: list[str], label: str, settings: dict, order: str = "date") -> DataFrame:
    """The node table of every series of ``rows``; a series' rows are taken in ``order``."""
    names = ["tree", "node", "feature", "threshold", "cover", "value"]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keys), NODE_FIELDS])

    def one(table):
        import pyarrow as pa

        table = table.sort_by([(order, "ascending"), (label, "ascending")])
        x = np.column_stack([table.column(f).to_numpy() for f in features]).astype(float)
        cols = list(zip(*grow(x, table.column(label).to_numpy().astype(float), settings)))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        same = [pa.repeat(table.column(k)[0], len(cols[0])) for k in keys]
        return pa.table([*same, *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*keys, *names])

    needed = rows.select(*keys, order, *(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias(label))
    groups = needed.groupBy(*keys) if keys else needed.groupBy(F.lit(0).alias("_all"))
    return groups.applyInArrow(one, schema)


# ---- paths and scores (SQL functions) ----------------------------------------------------


def paths(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """A row a leaf: keys, tree, leaf, value, and ``conds``, the distinct features
    on its path in order: (feature, lo, hi, share), where a row goes along if
    lo < value <= hi, and ``share`` is the product of the covers' ratios there."""
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*keys, "tree"]]
    child, parent = nodes.where("node > 1").alias("c"), nodes.where("feature IS NOT NULL").alias("p")
    on = F.col("p.node") == F.expr("shiftright(c.node, 1)")
    for cond in same("c", "p"):
        on = on & cond
    left, infinite = F.col("c.node") % 2 == 0, F.lit(float("inf"))
    edges = child.join(parent, on).select(
        *(F.col(f"c.{k}").alias(k) for k in [*keys, "tree", "node"]), F.col("p.feature").alias("feature"),
        F.when(left, -infinite).otherwise(F.col("p.threshold")).alias("lo"),
        F.when(left, F.col("p.threshold")).otherwise(infinite).alias("hi"),
        (F.col("c.cover") / F.col("p.cover")).alias("share"))
    leaves = nodes.where("feature IS NULL").select(*keys, "tree", F.col("node").alias("leaf"), "value")
    # the leaf and those above it, but for the root: as many as the depth
    steps = leaves.select(*keys, "tree", "leaf", F.explode(F.expr("transform(sequence(0, length(bin(leaf)) - 1), k -> shiftright(leaf, k))")).alias("up"))
    on = F.col("e.node") == F.col("s.up")
    for cond in same("e", "s"):
        on = on & cond
    conds = (steps.alias("s").join(edges.alias("e"), on)
             .groupBy(*(F.col(f"s.{k}").alias(k) for k in [*keys, "tree", "leaf"]), F.col("e.feature").alias("feature"))
             .agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.product("share").alias("share"))
             .groupBy(*keys, "tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("feature", "lo", "hi", "share"))).alias("conds")))
    on = F.col("l.leaf") == F.col("d.leaf")
    for cond in same("l", "d"):
        on = on & cond
    empty = F.array().cast("array<struct<feature:int,lo:double,hi:double,share:double>>")
    return leaves.alias("l").join(conds.alias("d"), on, "left").select(
        *(F.col(f"l.{k}").alias(k) for k in [*keys, "tree", "leaf"]), "l.value", F.coalesce("d.conds", empty).alias("conds"))


def forest(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """A row a series: ``_paths``, all its paths in order (at most trees x 2^depth)."""
    return paths(nodes, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("tree", "leaf", "value", "conds"))).alias("_paths"))


def on_series(rows: DataFrame, per_series: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of their series; without keys there is one series."""
    if not keys:
        return rows.crossJoin(F.broadcast(per_series))  # one row
    other = per_series.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *names)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(other, on, "left").drop(*(f"_of_{k}" for k in keys))


def follows(x, cond):
    """Does the row with the features ``x`` meet a condition of a path?"""
    v = x[cond["feature"]]
    return (v > cond["lo"]) & (v <= cond["hi"])


def predict(nodes: DataFrame, rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``rows`` and ``prediction``: the sum of the leaves that a row reaches (null: no such series)."""
    x = F.array(*(F.col(f).cast("double") for f in features))
    with_paths = on_series(rows.withColumn("_x", x), forest(nodes, keys), keys, ["_paths"])
    total = F.aggregate("_paths", F.lit(0.0), lambda acc, p: acc + F.when(
        F.forall(p["conds"], lambda c: follows(F.col("_x"), c)), p["value"]).otherwise(0.0))
    return with_paths.withColumn("prediction", total).drop("_x", "_paths")


def scorer(nodes: DataFrame, keys: list[str], features: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: predict(nodes, rows, keys, features)
