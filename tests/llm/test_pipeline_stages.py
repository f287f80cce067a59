from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from shoplens.llm.common import table, written
from tests.llm.test_line_ops import brute_runs
from tests.llm.test_near_dups import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), f"test_{name}")
        out.append(docs)
    return [table(spark, SF, "documents"), *out]


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "pack"]


def test_quality_keeps_the_good(spark, steps):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    right = [(d in kept) == (q == 1) for d, q in labels.items()]
    assert sum(right) / len(right) >= 0.9
    assert all(d in kept for d, q in labels.items() if q == 1)


def test_line_stage(steps):
    rows = sorted(steps[1].collect(), key=lambda r: r.doc_id)
    want = {}
    for r, gone in zip(rows, brute_runs([r.text for r in rows], 3)):
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone)
        if not gone or text.split():
            want[r.doc_id] = (text, len(text))
    assert {r.doc_id: (r.text, r.n_chars) for r in steps[2].collect()} == want


def test_near_stage(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    firsts = {d for d, _, c in brute(rows, 80, 100) if d == c}
    assert Counter(str(r.doc_id) for r in steps[3].collect()) == Counter(firsts)


def test_mix_and_pack(steps):
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    before, after = words(steps[3]), words(steps[4])
    assert before - 20 <= after <= before
    assert max(Counter(r.doc_id for r in steps[4].collect()).values()) <= 3
    pieces = steps[5].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in steps[4].collect()}
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= sum(used.values()) / 1024 * 1.05 + 1


def test_stages_take_odd_rows(spark, docs, empty):
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (odd, empty.select("doc_id", "text", "lang", "source", "n_chars")):
        df = start
        for _, stage in cp.STAGES:
            df = written(stage(spark, df, SF), "odd")
        assert (df.count() > 0) == (start is odd)


def test_near_stage_keeps_one_of_a_group_without_or_with_equal_ids(spark):
    from tests.llm.conftest import prose

    rnd = random.Random(3)
    a, b, c = (prose(rnd, 12) for _ in range(3))
    rows = [(None, a), (None, a + " more"), (5, b), (5, b + " more"), (9, b + " other"), (7, c), (None, c + " more"), (None, "x"), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.near_dedup(spark, df, SF).collect()]
    assert sorted(str(i) for i, _ in got) == ["4", "5", "7", "None", "None"]
    assert [t for i, t in got if i == 7] == [c] and (None, "x") in got


def test_stages_with_clashing_columns_and_hot_ids(spark, docs, tmp_path):
    """Extra columns whose names the operators use stay, and null and repeated ids run through all stages."""
    hot = docs.limit(40).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(40).withColumn("doc_id", F.lit(9).cast("long")))
    now = docs.unionByName(hot)
    labels = docs.filter("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 7 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in cp.STAGES:
        before, now = now, written(stage(spark, now, str(tmp_path)), "t-stage")
        if name != "pack":
            assert now.columns == before.columns and 0 < now.count()
    assert now.count() > 0
