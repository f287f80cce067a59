from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoplens.llm.common import n_words
from shoplens.llm.mixing import mix, taken_text
from shoplens.llm.rules import judge, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_stats(text: str) -> tuple:
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times = Counter(grams)
    covered = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_stats(corpus):
    for r in corpus:
        assert text_stats(r[1] or "") == slow_stats(r[1] or "")


def test_judge(spark, docs, corpus, empty):
    rows = judge(docs).collect()
    assert len(rows) == len(corpus) and judge(empty).count() == 0
    hosts: dict = {}
    for r in corpus:
        n, _, symbols, lines, dup, rep = slow_stats(r[1] or "")
        base = n < 20 or 100 * rep > 30 * n
        hosts.setdefault(r[2], []).append(base or symbols * 10 > n or dup * 10 > lines * 3)
    rates = [sum(f) / len(f) for f in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    s = m * (1 - m) / v - 1
    for r in rows:
        f = hosts[r.source]
        rate = (sum(f) + m * s) / (len(f) + s)
        assert r.host_rate == pytest.approx(rate) and r.kept == (not r.base_failed and rate <= 0.5)


def test_bad_host_goes_and_small_host_is_judged_mildly(spark):
    good, bad = " ".join(f"word{k}" for k in range(40)), "too short"
    rows = [(k, good, f"h{k % 6}") for k in range(600)] + [(1000 + k, bad, "spam") for k in range(200)]
    rows += [(2000, good, "spam"), (3000, bad, "tiny")]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[2000].kept and not got[2000].base_failed and got[0].kept
    assert got[3000].host_rate < 1.0


def brute_mix(rows: list) -> dict:
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    stopped: set = set()
    while True:
        rest = sum(own.values()) - sum(3 * own[s] for s in stopped)
        free = [s for s in sources if s not in stopped]
        goal = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > 3 * own[s]}
        if not over:
            return {s: (own[s], goal.get(s, 3 * own[s])) for s in sources}
        stopped |= over


def test_mix(spark, docs, corpus, empty):
    goals = brute_mix(corpus)
    out = mix(docs, n_words(F.col("text")), bucket_rows=7)
    rows = out.collect()
    assert out.columns[:len(docs.columns)] == docs.columns
    taken: Counter = Counter()
    for r in rows:
        taken[r.source] += r.mix_taken
        assert r.mix_source_size == goals[r.source][0]
        assert r.mix_target == pytest.approx(goals[r.source][1])
        assert 0 <= r.mix_taken <= r.mix_size
    for s, (_, goal) in goals.items():
        assert abs(taken[s] - goal) <= 1
    finish = [r.mix_finish for r in rows]
    assert finish == sorted(finish)
    assert len({(r.source, r.mix_bucket, r.mix_row) for r in rows}) == len(corpus)
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(3), n_words(F.col("text")), bucket_rows=7).collect()))
    assert mix(empty, n_words(F.col("text"))).count() == 0
    # a queue follows the shuffled order, however it is cut into buckets
    one = mix(docs.filter("doc_id <> 3"), n_words(F.col("text")), bucket_rows=1000).filter("source = 's1'").collect()
    first = [r for r in one if r.mix_copy == 0]
    assert [r.doc_id for r in first if r.mix_size] == [
        r.doc_id for r in sorted(first, key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest()) if r.mix_size]


def test_no_source_is_above_three_times_its_size(spark):
    rows = [(k, "w " * 10, "a") for k in range(50)] + [(100, "w w w", "b"), (101, "w", "c"), (102, "", "d"), (103, None, None)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), n_words(F.col("text")))
    total = {r.source: r.n for r in got.groupBy("source").agg(F.sum("mix_taken").alias("n")).collect()}
    assert total == {"a": 492, "b": 9, "c": 3, "d": 0, None: 0}


def test_taken_text(spark):
    df = spark.createDataFrame([("a b\nc  d", 2, 4), (" a b", 1, 2), ("a b", 2, 2), ("a b", 0, 2)], "text string, k long, n long")
    got = [r[0] for r in df.select(taken_text(F.col("text"), F.col("k"), F.col("n"))).collect()]
    assert [WORD.findall(x) for x in got] == [["a", "b"], ["a"], ["a", "b"], []]
