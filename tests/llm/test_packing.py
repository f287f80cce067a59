from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoplens.llm.packing import best_fit, pack_documents


@given(st.lists(st.integers(1, 50), max_size=120))
@settings(max_examples=100, deadline=None)
def test_best_fit(sizes):
    where, offset, filled = best_fit(sizes, 50)
    used = defaultdict(list)
    for s, b, o in zip(sizes, where, offset):
        used[b].append((o, s))
    for b, items in used.items():
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
        assert at == filled[b] <= 50
    assert all(x + y > 50 for k, x in enumerate(filled) for y in filled[:k])  # what the merging relies on


def _check(rows, corpus, capacity):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = []
    for doc_id, text, *_ in corpus:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        cut = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc_id, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(cut, cut[1:]))]
    key = lambda x: (x[0] is None, *(v or 0 for v in x))
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for items in used.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(used), -(-sum(r.length for r in rows) // capacity)


def test_pack_documents(spark, docs, corpus, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for parts, capacity in ((1, 256), (11, 256), (40, 1024)):
        rows = pack_documents(docs.repartition(parts), path, "byte", 2, capacity).collect()
        used, least = _check(rows, corpus, capacity)
        assert used <= least * 1.1 + 1
    assert pack_documents(empty, path).count() == 0


def test_many_half_empty_partitions_merge(spark):
    rnd = random.Random(3)
    rows = [(k, "word " * rnd.randint(1, 60)) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)
    out = pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), "byte", 2, 128).collect()
    used, least = _check(out, rows, 128)
    assert used <= least + 3
