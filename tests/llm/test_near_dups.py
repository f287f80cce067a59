from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shoplens.llm import near_dups as nd
from shoplens.llm.components import components
from tests.llm.conftest import edited, prose, words


def brute(rows: list, num: int, den: int) -> dict:
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)]))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least: dict = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted((str(doc_id), len(sets[k]), str(least.get(find(k)) if sets[k] else doc_id)) for k, (doc_id, _) in enumerate(rows))


def found(df, num, den):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nd.near_duplicates(df, num, den).collect())


@pytest.mark.parametrize("num", [80, 85])
def test_corpus(docs, corpus, num):
    assert found(docs, num, 100) == brute([r[:2] for r in corpus], num, 100)


def test_families_of_near_copies(spark):
    """Groups far above SHORT: edits of one text, edits of edits, texts around one passage."""
    rnd = random.Random(11)
    rows: list = []
    for size, most in ((120, 5), (60, 12)):
        base = prose(rnd, 12)
        group = [base] * 3 + [edited(rnd, base, rnd.randint(1, most)) for _ in range(size)]
        group += [edited(rnd, rnd.choice(group), rnd.randint(1, 4)) for _ in range(size)]
        rows += group
    passage = " ".join(words(rnd, 150))
    rows += [passage + " " + " ".join(words(rnd, rnd.randint(5, 60))) for _ in range(60)]
    rows += [" ".join(words(rnd, 3)) for _ in range(20)] + ["a b"] * 30
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(df, 85, 100) == brute(rows, 85, 100)
    assert found(df, 80, 100) == brute(rows, 80, 100)


def test_small_sketches_still_find_links(spark):
    rnd = random.Random(5)
    base = [prose(rnd, 30) for _ in range(12)]
    rows = list(enumerate(base + [edited(rnd, b, 2) for b in base]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nd.near_duplicates(df, 85, 100, k=48).collect())
    assert got == brute(rows, 85, 100)


def test_empty_and_flags(docs, empty):
    assert nd.near_duplicates(empty).count() == 0
    rows = nd.near_duplicates(docs, 80, 100)
    assert rows.filter(F.col("kept") != F.col("doc_id").eqNullSafe(F.col("component_id"))).count() == 0


def test_least_shared():
    for k in (48, 96):
        assert 0 < nd.least_shared(k, 80, 100) < nd.least_shared(k, 85, 100) < 0.85 * k


def test_components(spark):
    rnd = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 160)]
    hub = [(500, 500 + k) for k in range(1, 200)]
    some = [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    edges = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in chain + hub + some]
    root: dict = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
