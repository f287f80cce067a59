from __future__ import annotations

import re

import pytest

from shoplens.llm.line_runs import drop_repeated_runs
from shoplens.llm.units import drop_repeated_runs_of_units, drop_repeated_units, units


def _order(corpus):
    """Distinct (doc_id, text) in the order in which the first occurrence is kept."""
    return sorted(set((r[0], r[1]) for r in corpus if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, ))


def brute_runs(texts: list, window: int) -> list:
    """Texts in order -> removed line numbers of each."""
    seen: dict = {}
    out = []
    for k, text in enumerate(texts):
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone: set = set()
        for s in range(max(1, len(lines) - window + 1) if lines else 0):
            part = lines[s:s + window]
            if tuple(x for _, x in part) in seen:
                gone.update(range(part[0][0], part[-1][0] + 1))
            else:
                seen[tuple(x for _, x in part)] = k
        out.append(gone)
    return out


def test_runs_against_brute_force(spark, docs, corpus, empty):
    from tests.llm.conftest import words  # noqa: F401

    one_id = [r for r in corpus if r[0] != 3]  # the order of different texts with one id is a matter of their hashes
    order = sorted(one_id, key=lambda r: (r[0] is not None, r[0] or 0))
    for window in (1, 2, 3):
        gone = brute_runs([r[1] or "" for r in order], window)
        want = {}
        for r, g in zip(order, gone):
            lines = (r[1] or "").split("\n")
            want[r[0]] = (None if r[1] is None else "\n".join(x for i, x in enumerate(lines) if i not in g), len(g))
        rows = drop_repeated_runs(docs.filter("doc_id IS NULL OR doc_id <> 3"), window)
        got = {r.doc_id: (r.text, r.run_removed) for r in rows.collect()}
        assert got == want
        assert rows.columns[:len(docs.columns)] == docs.columns
    assert drop_repeated_runs(docs).count() == len(corpus)
    assert drop_repeated_runs(empty).count() == 0


def test_alike_rows_are_one_document(spark):
    text = "a b\nc d\ne f\ng h"
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in drop_repeated_runs(df).collect()) == [(1, text), (1, text), (2, "")]


def test_units_against_brute_force(spark, docs, corpus, empty):
    order = sorted((r for r in corpus if r[0] != 3), key=lambda r: (r[0] is not None, r[0] or 0))
    for kind, least in (("line", 5), ("line", 1), ("paragraph", 5)):
        seen: set = set()
        want = {}
        for r in order:
            if r[1] is None:
                want[r[0]] = (None, [])
                continue
            spans, left, at = [], "", 0
            for start, stop, content in units(r[1], kind):
                norm = content.lower().split()
                if len(norm) >= least and tuple(norm) in seen:
                    spans.append((start, stop))
                elif len(norm) >= least:
                    seen.add(tuple(norm))
            for start, stop in spans:
                left, at = left + r[1][at:start], stop
            want[r[0]] = (left + r[1][at:], spans)
        rows = drop_repeated_units(docs.filter("doc_id IS NULL OR doc_id <> 3"), kind, least)
        got = {r.doc_id: (r.text, list(zip(r.unit_starts or [], r.unit_stops or []))) for r in rows.collect()}
        assert got == want
    assert drop_repeated_units(empty).count() == 0
    assert drop_repeated_units(docs).columns == [*docs.columns, "unit_starts", "unit_stops"]


def test_long_lines_are_windows_of_their_own(spark):
    """One or two repeated lines of 50 words go with ``words``; what windows of lines find stays found."""
    long = " ".join(f"a{k}" for k in range(60))
    half = [" ".join(f"{c}{k}" for k in range(30)) for c in "bcde"]
    rows = [(1, "\n".join(["x y", long, "z", *half])), (2, "\n".join(["other", long, "end"])), (3, long),
            (4, "\n".join(["p", half[0], "", half[1], "q"])), (5, "\n".join(["r", half[0], "s"])), (6, "\n".join(half[:3])),
            (7, "z\n" + half[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_repeated_runs(df, 3, 50).collect()}
    assert got == {1: rows[0][1], 2: "other\nend", 3: "", 4: "p\nq", 5: rows[4][1], 6: "", 7: rows[6][1]}
    assert {r.doc_id for r in drop_repeated_runs(df).filter("run_removed > 0").collect()} == {6}


def test_passages_inside_lines_go_by_sentences(spark):
    said = [" ".join(f"{c}{k}" for k in range(20)) + end for c, end in zip("abc", ".!?")]
    passage = " ".join(said)
    texts = ["First line.\n" + passage + " Tail of the first line here.", "It begins inside of this line. " + passage + " And goes on in it."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in drop_repeated_units(df, "sentence").collect()}
    assert got[0].text == texts[0] and got[0].unit_starts is None
    assert got[1].text == "It begins inside of this line. And goes on in it."
    assert "".join(texts[1][a:z] for a, z in zip(got[1].unit_starts, got[1].unit_stops)) == passage + " "
    assert all(r.unit_starts is None for r in drop_repeated_units(df).collect())


def plain_runs(rows, kind, least):
    """The rule of runs by dictionaries, documents by rank."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = [u for u in units(text or "", kind) if u[2].split()]
        norm = [tuple(u[2].lower().split()) for u in own]
        flag = [False] * len(own)
        for k, w in enumerate(norm):
            if len(w) >= least and not seen.setdefault(("alone", w), (doc_id, k)) == (doc_id, k):
                flag[k] = True
            if k + 1 < len(norm) and not seen.setdefault((w, norm[k + 1]), (doc_id, k)) == (doc_id, k):
                flag[k] = flag[k + 1] = True
        gone, at = [], 0
        while at < len(own):
            end = at
            while end < len(own) and flag[end]:
                end += 1
            if sum(map(len, norm[at:end])) >= least:
                gone += own[at:end]
            at = end + 1
        left, at = "", 0
        for start, stop, _ in gone:
            left, at = left + text[at:start], stop
        out[doc_id] = (None if text is None else left + text[at:], [(s, e) for s, e, _ in gone])
    return out


@pytest.mark.parametrize("kind,least", [("clause", 40), ("clause", 12), ("line", 20), ("sentence", 1)])
def test_runs_against_brute_force(spark, docs, corpus, empty, kind, least):
    rows = {(r[0], r[1]) for r in corpus if r[0] is not None and r[0] != 3}  # rows alike are one document
    got = {r.doc_id: (r.text, list(zip(r.unit_starts or [], r.unit_stops or [])))
           for r in drop_repeated_runs_of_units(docs.filter("doc_id <> 3"), kind, least).collect()}
    assert got == plain_runs(rows, kind, least)
    whole = drop_repeated_runs_of_units(docs, kind, least)
    assert whole.columns == [*docs.columns, "unit_starts", "unit_stops"] and whole.count() == docs.count()
    assert drop_repeated_runs_of_units(empty, kind, least).count() == 0


def test_passages_go_and_short_common_units_stay(spark):
    """A passage inside lines, in short lines, as one line; common clauses, hot ids and null ids."""
    words = [f"w{k}" for k in range(60)]
    marked = " ".join(w + ("," if k % 5 == 4 else "") for k, w in enumerate(words))
    lines = "\n".join(" ".join(words[k:k + 3]) for k in range(0, 60, 3))
    rows = [(1, f"It begins, and {marked}. It ends here."), (2, f"Other words come first, {marked}, and go on."),
            (3, f"a\n{lines}\nb"), (4, f"c\n{lines}\nd"), (5, " ".join(words)), (6, "x\n" + " ".join(words) + "\ny")]
    rows += [(10 + k, f"Common words here. And these too. Doc {k} of its own. Common words here. And these too.") for k in range(50)]
    rows += [(7, f"h{k} {k} " + marked) for k in range(20)] + [(None, f"n{k} {k}, " + marked) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = drop_repeated_runs_of_units(df).collect()
    one = {r.doc_id: r for r in got if r.doc_id not in (7, None)}
    assert all(r.unit_starts is None for d, r in one.items() if d >= 10)  # 50 documents of common sentences stay
    assert one[4].text == "c\nd" and one[6].text == "x\ny" and one[3].unit_starts is None and one[5].unit_starts is None
    assert "w10" not in one[1].text and "w10" not in one[2].text and one[2].text.endswith("and go on.")
    nulls = [r for r in got if r.doc_id is None]  # the null id ranks first: one of its rows keeps the passage
    assert len(nulls) == 20 and sum("w10" in r.text for r in nulls) == 1
    assert all(r.unit_starts is None or "w10" not in r.text for r in got if r.doc_id == 7)
