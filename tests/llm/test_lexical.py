from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shoplens.llm import lexical as lx
from shoplens.llm.common import written

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    """Every document scored for every item by the formula."""
    found = [(d, Counter(split(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c, n in found:
            m, score = 100 - 25 + (25 * n * n_docs) // n_terms, 0
            for t in split(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r)))


@pytest.fixture(scope="module")
def case(corpus):
    rnd = random.Random(11)
    docs = [(r[0], r[1]) for r in corpus]
    docs += [(2000 + k, "the same text of many copies, " * 3 + "é" * 20) for k in range(150)]
    docs += [(3000 + k, "the same text of many copies, " * 3 + f"near {k}") for k in range(60)]
    docs += [(None, "the same text of many copies " * 3)] * 2
    docs += [(4000, "x" * 700 + " " + "y" * 256 + " " + "z" * 257), (4001, "a-b_c 1.5 É日本語\u00a0x \x7f\x80"), (4002, "word " * 5000), (4003, "word")]
    items = [(k, " ".join(rnd.sample(split(docs[k][1]) or ["none"], min(12, len(split(docs[k][1])) or 1)))) for k in range(0, 60, 3)]
    items += [(100, "the same text of many copies"), (101, "WORD word, word"), (102, "unknownterm"), (103, ""), (104, None), (105, "---"),
              (106, "x" * 700 + " é " + "z" * 257), (107, "É日本語 5 b"), (100, "the same text of many copies"), (None, "copies near 7"),
              (108, docs[14][1] or "text")]
    return docs, items


def rows(df):
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]
    return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r)))


def index_with(df, bits, docs_a_block):
    """An index whose blocks are as small or as crowded as asked for, built in the workers."""
    def run(batches):
        from shoplens.llm import lexical

        lexical.BITS_A_KEY, lexical.BLOCK_DOCS = bits, docs_a_block
        try:
            yield from lexical._index(batches)
        finally:
            lexical.BITS_A_KEY, lexical.BLOCK_DOCS = 10, 2048

    return written(lx._rows(df).mapInArrow(run, lx.BLOCKS), "slices")


@pytest.mark.parametrize("top,probe,per,bits,docs_a_block", [(20, 64, 256, 10, 2048), (3, 3, 7, 3, 16), (1000, 1, 256, 10, 8)])
def test_search(spark, case, monkeypatch, top, probe, per, bits, docs_a_block):
    """Whatever the false positives (bits a key), the blocks of queries and the probes."""
    docs, items = case
    monkeypatch.setattr(lx, "ITEMS", per)
    df = spark.createDataFrame([(*d, 1, "w", 2) for d in docs], "doc_id long, text string, key int, slices string, q int").repartition(3)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id int")
    assert rows(lx.search(df, index_with(df, bits, docs_a_block), asked, top, probe)) == brute(docs, items, top)


def test_bounds_hold(spark, case):
    """Every bound is at least the exact score, and equal to it for nearly all pairs."""
    docs, items = case
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    blocks = lx.build_index(df).collect()
    q = lx.Queries([t for _, t in items if t])
    found = [(Counter(split(t)), len(split(t))) for _, t in docs if split(t)]
    freq = Counter(t for c, _ in found for t in c)
    q.weigh(len(found), sum(n for _, n in found), np.array([freq[t.decode()] for t in q.term]))
    texts = {}
    for r in df.selectExpr("doc_id", "xxhash64(text) AS key", "text").collect():
        texts[r["doc_id"], r["key"]] = lx.terms(r["text"])
    same = pairs = 0
    for b in blocks:
        lengths = np.array(b["lengths"])
        bound = lx.bounds(q, b["width"], b["levels"], lengths, bytes(b["slices"]))
        for j, key in enumerate(zip(b["doc_ids"], b["keys"])):
            tf, m = Counter(texts[key]), q.length(len(texts[key]))
            assert len(texts[key]) == lengths[j]
            for k, item in enumerate(q.items):
                score = sum(w * lx.factor(tf[q.term[i]], m) for i, w in item if tf[q.term[i]])
                assert bound[k, j] >= score
                pairs += 1
                same += bool(bound[k, j] == score)
    assert pairs > 3000 and same > 0.9 * pairs


def test_terms_and_hashes():
    texts = ["", None, "Ab-c 12_x é日本 a\u00a0b", "\x00q\x00", "w" * 300, "abcdefgh abcdefghi", "ÀÉ k\u212a"]
    found = lx.Terms(texts)
    got = [[] for _ in texts]
    for i, d in enumerate(found.doc.tolist()):
        got[d].append(found.bytes_of(i).decode())
    assert got == [split(t) for t in texts]
    assert [lx.terms(t) for t in texts] == [[x.encode() for x in split(t)] for t in texts]
    again = lx.Terms([" ".join(w for ws in got for w in ws)])
    assert again.hash.tolist() == found.hash.tolist()
    every = lx.Terms([" ".join({"".join(random.Random(k).choices("abé1", k=k % 40 + 1)) for k in range(3000)})])
    assert len(set(every.hash.tolist())) == len(every.hash)


def test_equal_hashes(case, monkeypatch):
    """With a hash that tells no terms apart document frequencies are the same."""
    import pyarrow as pa

    docs, items = case
    q = lx.Queries([t for _, t in items if t])
    q.hash = np.zeros(len(q.term), np.uint64)

    class Sent:
        value = q

    monkeypatch.setattr(lx.Terms, "_hashes", lambda self: np.zeros(len(self.size), np.uint64))
    (got,) = lx._found(Sent)(iter([pa.RecordBatch.from_arrays([pa.array([t for _, t in docs[:120]])], names=["text"])]))
    freq = Counter(t for _, text in docs[:120] for t in set(split(text)))
    want = {i: freq[t.decode()] for i, t in enumerate(q.term) if freq[t.decode()]}
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist())) == want


def test_empty(spark, case):
    docs = spark.createDataFrame(case[0], "doc_id long, text string")
    items = spark.createDataFrame(case[1], "item_id long, text string")
    none, blank = docs.limit(0), spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    for d, i in ((none, items), (blank, items), (docs, items.limit(0)), (docs, items.filter("item_id = 105"))):
        out = lx.search(d, lx.build_index(d), i)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
