"""Property tests for the distributed primitives (random data, random partitioning)."""

from __future__ import annotations

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shoplens.functions.numbering import exact_percentiles, global_row_number

VALUES = st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=300)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(values=VALUES, parts=st.integers(min_value=1, max_value=9))
def test_row_number_is_a_sorted_permutation(spark, values, parts):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double").repartition(parts)
    got = sorted((r.rn, r.v, r.id) for r in global_row_number(df, ["v", "id"], "rn").collect())
    assert [g[0] for g in got] == list(range(1, len(values) + 1))
    assert [(g[1], g[2]) for g in got] == sorted((float(v), i) for i, v in enumerate(values))


@SETTINGS
@given(values=VALUES, q=st.floats(min_value=0.0, max_value=1.0))
def test_exact_percentile_matches_numpy(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_percentiles(df, "x", {"p": q}).first().p
    assert got == np.percentile(np.array(values, dtype=float), q * 100) or abs(got - np.percentile(values, q * 100)) < 1e-9
