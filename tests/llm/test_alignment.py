from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoplens.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@given(st.lists(st.integers(0, 80), max_size=40), st.lists(st.tuples(st.integers(-3, 85), st.integers(0, 60), st.integers(0, 60), st.integers(-4, 60)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_gallop(values, asked):
    x = np.unique(np.array(values, np.int64))
    spans = [(k, *sorted((min(s, len(x)), min(e, len(x)))), at) for k, s, e, at in asked]
    keys, lo, hi, at = (np.array([s[i] for s in spans], np.int64) for i in (0, 1, 2, 3))
    want = [bisect_left(x.tolist(), k, s, e) for k, s, e, _ in spans]
    assert al.gallop(x, keys, at, lo, hi).tolist() == want


def slow_groups(ends_a, ends_b):
    """Groups and links by plain sets of ends."""
    common = sorted(set(ends_a) & set(ends_b))
    groups, was = [], -1
    for e in common:
        groups.append(([i for i, x in enumerate(ends_a) if was < x <= e],
                       [j for j, x in enumerate(ends_b) if was < x <= e]))
        was = e
    links = [(i, j) for i, x in enumerate(ends_a) for j, y in enumerate(ends_b) if x == y]
    return groups, links


@given(st.lists(st.tuples(st.lists(st.integers(0, 4), max_size=8), st.lists(st.integers(0, 4), max_size=8)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_align_any_widths(docs):
    """Ids whose widths are their own values, tokens of no bytes among them."""
    docs = [(a + [1] * max(0, sum(b) - sum(a)), b + [1] * max(0, sum(a) - sum(b))) for a, b in docs]
    width = np.arange(5)
    got = al.align([np.array(a, np.int64) for a, _ in docs], [np.array(b, np.int64) for _, b in docs], width, width)
    _, _, base_a, base_b, (doc, fa, pa, fb, pb), (link_doc, la, lb) = got
    for k, (a, b) in enumerate(docs):
        groups, links = slow_groups(np.cumsum(a).tolist(), np.cumsum(b).tolist())
        mine = [([*range(x - base_a[k], y - base_a[k])], [*range(z - base_b[k], w - base_b[k])])
                for d, x, y, z, w in zip(doc, fa, pa, fb, pb) if d == k]
        assert mine == groups
        assert sorted((x - base_a[k], y - base_b[k]) for d, x, y in zip(link_doc, la, lb) if d == k) == sorted(links)


def brute(rows):
    """Every figure by plain loops over the libraries' own ids."""
    lib_a, lib_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib_a.encode_special_tokens = True
    moved = al.token_bytes(A, "byte")

    def of_b(k):
        p = lib_b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if lib_b.is_byte(k) else p.replace("\u2581", " ").encode()

    every = []
    for doc_id, text in rows:
        a = lib_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = lib_b.encode(text) if text else []
        wa, wb = [moved[k] for k in a], [of_b(k) for k in b]
        if not text or b"".join(wa) != (" " + text).encode() or b"".join(wb) != (" " + text).encode():
            every.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(w) for w in wa]).tolist(), np.cumsum([len(w) for w in wb]).tolist()
        at = {e: j for j, e in enumerate(ends_b)}
        links = [(a[i], b[at[e]]) for i, e in enumerate(ends_a) if e in at]
        groups, i0, j0 = [], 0, 0
        for i, e in enumerate(ends_a):
            if e in at:
                groups.append((a[i0:i + 1], b[j0:at[e] + 1]))
                i0, j0 = i + 1, at[e] + 1
        every.append((doc_id, a, b, groups, links))
    count = Counter(p for *_, links in every for p in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, a, b, groups, links in every:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_query_rows(spark, docs, corpus, empty):
    rnd = random.Random(3)
    odd = [(900 + k, t) for k, t in enumerate(["a<|endoftext|>b", "x\u2581y", "  two  spaces ", "<0x41> <s> </s>", "\x00\x01", "日本語テスト😀", "a" * 3000, " ", "\n\n\tx",
                                               "".join(rnd.choice("aé日 .\n") for _ in range(400))])]
    both = docs.select("doc_id", "text", "key", "n").unionByName(
        spark.createDataFrame([(*r, 1, 2) for r in odd], "doc_id long, text string, key long, n int"))
    rows = [(r[0], r[1]) for r in corpus] + odd
    got = [tuple(r[f] for f in FIELDS) for r in al.alignment(both, A, B).collect()]
    assert _sorted(got) == _sorted(brute(rows))
    none = al.alignment(empty, A, B)
    assert none.count() == 0 and none.columns == FIELDS


def test_bound():
    """The bound on id pairs equals a count by brute force over every 40th token of A."""
    shown_a, shown_b = al.token_bytes(A, "byte"), al.token_bytes(B, "piece")
    some = [t for t in shown_a[::40] if t]
    want = sum(1 for t in some for u in shown_b if u and (t.endswith(u) or u.endswith(t)))
    many_b, ends_b = Counter(filter(None, shown_b)), Counter()
    for u in filter(None, shown_b):
        ends_b.update({u[k:] for k in range(1, len(u))})
    assert want == sum(ends_b[t] + sum(many_b[t[k:]] for k in range(len(t))) for t in some)
    assert al.pair_bound(A, B) < 400_000


def test_more_pairs_than_the_bound(spark):
    counts = spark.createDataFrame([(1, 2, 3), (2, 2, 3)], "a long, b long, n long")
    with pytest.raises(ValueError):
        al.link_figures(spark, None, counts, 1, "<u2")
