"""Boosted trees against plain boosting, attributions against the definition."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.plans import attribution as AT
from shoplens.plans import boosting as BO

NAMES = ["a", "b", "c", "d", "e"]


# ---- brute force -----------------------------------------------------------------------


def plain_tree(x, g, rows, depth, rate, node=1):
    """One tree by trying every threshold of every feature; {node: (feature, threshold) or value}."""
    score = lambda r: sum(g[i] for i in r) ** 2 / (len(r) + 1)
    best, total = (BO.LEAST_GAIN, None, None), score(rows)
    if depth:
        for f in range(len(x[0])):
            values = sorted({x[i][f] for i in range(len(x))})
            for t in [(u + v) / 2 for u, v in zip(values, values[1:])]:
                left, right = [i for i in rows if x[i][f] <= t], [i for i in rows if x[i][f] > t]
                if left and right and score(left) + score(right) - total > best[0] + 1e-12:
                    best = (score(left) + score(right) - total, f, t)
    if best[1] is None:
        return {node: -sum(g[i] for i in rows) / (len(rows) + 1) * rate}
    _, f, t = best
    return {node: (f, t), **plain_tree(x, g, [i for i in rows if x[i][f] <= t], depth - 1, rate, 2 * node),
            **plain_tree(x, g, [i for i in rows if x[i][f] > t], depth - 1, rate, 2 * node + 1)}


def follow(tree, row):
    node = 1
    while isinstance(tree[node], tuple):
        node = 2 * node + (row[tree[node][0]] > tree[node][1])
    return tree[node]


def plain_boosting(x, y, trees, depth, rate):
    predicted = [sum(y) / len(y)] * len(y)
    for _ in range(trees):
        tree = plain_tree(x, [p - v for p, v in zip(predicted, y)], list(range(len(y))), depth, rate)
        predicted = [p + follow(tree, r) for p, r in zip(predicted, x)]
    return predicted


def known_value(nodes, row, known, node=1):
    """Prediction of a tree when only the features ``known`` are: cover-weighted both ways elsewhere."""
    feature, threshold, cover, value = nodes[node]
    if feature is None:
        return value
    if feature in known:
        return known_value(nodes, row, known, 2 * node + (row[feature] > threshold))
    return sum(nodes[c][2] / cover * known_value(nodes, row, known, c) for c in (2 * node, 2 * node + 1))


def shapley(trees, row, n):
    v = {s: sum(known_value(t, row, s) for t in trees) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    out = []
    for i in range(n):
        out.append(sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (v[tuple(sorted((*s, i)))] - v[s])
                       for s in v if i not in s))
    return out, v[()]


# ---- tests -----------------------------------------------------------------------------


def frame(spark, n=60, seed=1, series=("s", "t")):
    rnd = random.Random(seed)
    rows = [(s, k, *(round(rnd.random(), 1) for _ in range(4)), 1.0, rnd.random() * 50 + 20 * (k % 3)) for s in series for k in range(n)]
    return spark.createDataFrame(rows, "s string, date int, a double, b double, c double, d double, e double, y double").repartition(4)


SETTINGS = {"n_trees": 6, "max_depth": 3, "learning_rate": 0.3, "row_sample": 1.0, "column_sample": 1.0, "seed": 42}


def test_like_plain_boosting(spark):
    df = frame(spark)
    nodes = BO.train(df, ["s"], NAMES, "y", SETTINGS)
    got = {(r.s, r.date): r.prediction for r in BO.predict(nodes, df, ["s"], NAMES).collect()}
    for s in ("s", "t"):
        rows = sorted((r for r in df.collect() if r.s == s), key=lambda r: r.date)
        want = plain_boosting([[r[f] for f in NAMES] for r in rows], [r.y for r in rows], 6, 3, 0.3)
        assert [got[s, r.date] for r in rows] == pytest.approx(want, rel=1e-9)


def test_samples_rows_and_columns(spark):
    df = frame(spark, 200)
    settings = {**SETTINGS, "n_trees": 40, "max_depth": 1, "row_sample": 0.5, "column_sample": 0.4}
    nodes = BO.train(df.where("s = 's'"), [], NAMES, "y", settings)
    again = BO.train(df.where("s = 's'").repartition(7), [], NAMES, "y", settings)
    assert sorted(map(str, nodes.collect())) == sorted(map(str, again.collect()))
    roots = nodes.where("node = 1 AND tree > 0").collect()
    assert len(roots) == 40 and all(60 < r.cover < 140 for r in roots) and len({r.cover for r in roots}) > 5
    assert len({r.feature for r in roots}) >= 3  # the best column is not always among the two that a tree may use


@pytest.mark.parametrize("n,values,bins", [(300, 300, 8), (5, 5, 256)])
def test_cuts(n, values, bins, monkeypatch):
    monkeypatch.setattr(BO, "BINS", bins)
    x = np.array([k % values for k in range(n)], float)
    cuts = BO._cuts(x)
    assert len(cuts) == min(bins, values) - 1 and (np.diff(cuts) > 0).all()
    assert BO._cuts(np.ones(4)).tolist() == []


def test_constant_and_single_rows(spark):
    df = spark.createDataFrame([("one", 1, 1.0, 5.0), ("flat", 1, 1.0, 7.0), ("flat", 2, 1.0, 9.0)], "s string, date int, a double, y double")
    nodes = BO.train(df, ["s"], ["a"], "y", SETTINGS)
    assert nodes.where("feature IS NOT NULL").count() == 0
    got = {(r.s, r.date): r.prediction for r in BO.predict(nodes, df, ["s"], ["a"]).collect()}
    assert got["one", 1] == pytest.approx(5.0) and got["flat", 1] == got["flat", 2] == pytest.approx(8.0)
    impacts = AT.row_impacts(nodes, df, ["s"], ["a"]).collect()
    assert len(impacts) == 3 and all(r.impact == 0 for r in impacts)
    assert {r.s: r.expected for r in AT.expected_value(nodes, ["s"]).collect()} == {"one": pytest.approx(5.0), "flat": pytest.approx(8.0)}


def test_attributions_like_the_definition(spark):
    """Every subset of features, on a sampled forest in which paths ask a feature twice."""
    df = frame(spark, 40, seed=3)
    settings = {**SETTINGS, "n_trees": 4, "max_depth": 4, "row_sample": 0.8, "column_sample": 0.8}
    nodes = BO.train(df, ["s"], NAMES, "y", settings).cache()
    twice = BO.paths(nodes, ["s"]).where("size(conds) < length(bin(leaf)) - 1").count()
    assert twice > 0
    impacts = {}
    for r in AT.row_impacts(nodes, df, ["s"], NAMES).collect():
        impacts.setdefault((r.s, r.date), [0.0] * 5)[r.feature_index] = r.impact
    expected = {r.s: r.expected for r in AT.expected_value(nodes, ["s"]).collect()}
    scored = BO.predict(nodes, df, ["s"], NAMES).collect()
    trees = {}
    for r in nodes.collect():
        trees.setdefault(r.s, {}).setdefault(r.tree, {})[r.node] = (r.feature, r.threshold, r.cover, r.value)
    for r in scored:
        want, base = shapley(list(trees[r.s].values()), [r[f] for f in NAMES], 5)
        assert impacts[r.s, r.date] == pytest.approx(want, abs=1e-9)
        assert expected[r.s] == pytest.approx(base, abs=1e-9)
        assert sum(impacts[r.s, r.date]) + expected[r.s] == pytest.approx(r.prediction, rel=1e-9)
    mean = {(r.s, r.feature): r.mean_abs_shap for r in AT.mean_impact(nodes, df, ["s"], NAMES).collect()}
    assert len(mean) == 10 and mean["s", "e"] == 0.0  # never used: constant
    for s in ("s", "t"):
        own = [v for (k, _), v in impacts.items() if k == s]
        assert [mean[s, f] for f in NAMES] == pytest.approx([sum(abs(v[i]) for v in own) / len(own) for i in range(5)])


def test_top_impacts_ties(spark):
    df = spark.createDataFrame([("x", 0, 1.0), ("x", 1, -1.0), ("x", 2, 3.0), ("y", 0, 0.0)], "s string, feature_index int, impact double")
    top = AT.top_impacts(df, ["s"], 2).orderBy("s", F.desc(F.abs("impact"))).collect()
    assert [(r.s, r.feature_index) for r in top] == [("x", 2), ("x", 0), ("y", 0)]


def test_training_is_one_job(spark):
    """Two series or forty: the same number of jobs."""
    counts = []
    for k, names in enumerate((["a1", "a2"], [f"b{i}" for i in range(40)])):
        df = frame(spark, 12, series=names).persist()
        df.count()
        group = f"boosting-{k}"
        spark.sparkContext.setJobGroup(group, group)
        BO.train(df, ["s"], NAMES, "y", SETTINGS).write.format("noop").mode("overwrite").save()
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setJobGroup("other", "other")
    assert counts[0] == counts[1] <= 3
