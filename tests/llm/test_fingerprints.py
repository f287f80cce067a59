from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shoplens.llm import fingerprints as fp
from tests.llm.conftest import prose


def slow_cuts(raw: bytes) -> set:
    """Places with the easy number of zero bits, by rolling byte by byte."""
    found = set()
    for at in range(len(raw)):
        h = 0
        for b in raw[max(0, at - 31):at + 1]:
            h = ((h << 1) + int(fp._GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - fp.EASY) == 0 and at + 1 < len(raw) and raw[at + 1] & 0xC0 != 0x80:
            found.add(at + 1)
    return found


def test_cuts_against_rolling(monkeypatch):
    raw = prose(random.Random(1), 12).encode()
    assert set(fp._cuts(raw)[1]) == slow_cuts(raw)
    monkeypatch.setattr(fp, "_BLOCK", 100)  # blocks change nothing
    assert set(fp._cuts(raw)[1]) == slow_cuts(raw)


@given(st.text(max_size=600))
@settings(max_examples=150, deadline=None)
def test_chunks_cover_text(text):
    raw = text.encode("utf-8", "surrogatepass")
    ends = fp.chunks(raw)
    assert ends == sorted(set(ends)) and (not raw or ends[-1] == len(raw))
    assert all(e - s <= fp.MOST + 4 for s, e in zip([0, *ends], ends))


def test_shift_resistant():
    text = prose(random.Random(2), 60)
    a, b = fp.fingerprint(text), fp.fingerprint("inserted words " + text)
    assert fp.containment(a, b) > 0.95
    assert fp.containment(a, fp.fingerprint(prose(random.Random(3), 60))) < 0.05
    assert np.array_equal(fp.parsed(fp.shown(a)), a)
    assert fp.containment(fp.fingerprint(""), fp.fingerprint("")) == 1.0
    assert fp.containment(fp.fingerprint(""), a) == 0.0 == fp.containment(a, fp.fingerprint(""))


def test_compare_with_next(spark, docs, corpus, empty):
    order = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    for partitions in (1, 4, 16):
        got = [tuple(r)[:3] + (r.fingerprint,) for r in fp.compare_with_next(docs, partitions).collect()]
        want = []
        for k, r in enumerate(order):
            new = fp.edited(texts[k], texts[(k + 1) % len(order)])
            want.append((r[0], len(texts[k]), hashlib.sha256(new.encode()).hexdigest(), fp.shown(fp.fingerprint(texts[k]))))
        key = lambda x: (x[0] is None, x[0] or 0, x[1:])
        assert sorted(got, key=key) == sorted(want, key=key)
    assert fp.compare_with_next(empty, 4).count() == 0
    assert fp.fingerprints(docs).count() == len(corpus)


def test_likeness_against_brute_force(spark, docs, corpus):
    """near_edited and near_next from the texts' own chunks, as sets of bytes."""
    def pieces(text):
        raw, at, own = text.encode("utf-8"), 0, set()
        for end in fp.chunks(raw):
            own.add(raw[at:end])
            at = end
        return own

    def share(a, b):
        a, b = pieces(a), pieces(b)
        return sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)

    order = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = []
    for k, r in enumerate(order):
        after = texts[(k + 1) % len(order)]
        want.append((str(r[0]), len(texts[k]), round(share(texts[k], fp.edited(texts[k], after)), 9), round(share(texts[k], after), 9)))
    got = [(str(r.doc_id), r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.compare_with_next(docs, 4).collect()]
    assert sorted(got) == sorted(want)
