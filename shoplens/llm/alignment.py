"""Operator 12 — alignment of two tokenizers by a galloping intersection.

A text is encoded by tokenizer A (byte-level BPE, with a space put before the
text) and by tokenizer B (sentencepiece BPE, which adds that space itself).
Both give lists of byte offsets at which their tokens end. In every document
the shorter list drives: each of its ends is looked for in the longer one by
exponential steps from the place its rank suggests, then by binary search
between the last two steps (:func:`gallop`, all drivers of a batch in step).
The common ends give index pairs; they cut both lists into groups, and the
differences of their ranks are the runs of tokens that overlap in a group.

An A token and a B token whose ranges end together are *linked*. Of two
tokens that end together one is a suffix of the other, so the pairs that can
ever be linked are counted from the two vocabularies alone
(:func:`pair_bound`: 324,297 for the two public files, whatever the corpus). The table
of corpus-wide counts is therefore sent to all tasks, after its size was held
against that bound. The links themselves are written once, 4 bytes each (8 for vocabularies over
65,536), and read again for the document figures.

Cases: a text that is null or empty, or whose A or B bytes differ from a space
and the text (as U+2581, which B reads as a space), has no tokens: zeros and ''.
Rows with the same doc_id stay separate rows; an empty table gives no rows;
a token of no bytes ends where the one before it does and is linked to all that
end there; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import written
from shoplens.llm.tokens import encoded, encoder, token_bytes

LINKS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary"
FIGURES = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
           "count_sum long, groups_sha256 string")
ROWS = 256  # texts that are aligned in one go


def gallop(x: np.ndarray, keys: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each key the first place in ``x[lo:hi]`` (ascending there) that is
    not under it: exponential steps from ``start``, then binary search."""
    if not len(keys) or not len(x):
        return np.array(lo, np.int64)
    at = np.clip(start, lo, hi)
    below = (at < hi) & (x[np.minimum(at, len(x) - 1)] < keys)  # then the place is to the right
    left, right = np.where(below, at, lo), np.where(below, hi, at)
    step, going = 1, np.arange(len(keys))
    while len(going):
        up = below[going]
        seen = np.where(up, at[going] + step, at[going] - step)
        inside = np.where(up, seen < hi[going], seen >= lo[going])
        going, seen, up = going[inside], seen[inside], up[inside]
        under = x[seen] < keys[going]
        left[going] = np.where(under, seen, left[going])
        right[going] = np.where(under, right[going], seen)
        going, step = going[under == up], step * 2
    # here x[left] < key <= x[right], or left = lo and right = hi untested
    left = np.where(below, left + 1, left)
    todo = np.flatnonzero(left < right)
    while len(todo):
        mid = (left[todo] + right[todo]) >> 1
        under = x[mid] < keys[todo]
        left[todo] = np.where(under, mid + 1, left[todo])
        right[todo] = np.where(under, right[todo], mid)
        todo = todo[left[todo] < right[todo]]
    return left


def intersect(a: np.ndarray, a_of: np.ndarray, b: np.ndarray, b_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal values in the lists ``a[a_of[k]:a_of[k+1]]`` and
    ``b[b_of[k]:b_of[k+1]]`` of every document k; values ascend strictly in a list."""
    n_a, n_b = np.diff(a_of), np.diff(b_of)
    drives = n_a <= n_b  # list A drives
    got_a, got_b = [], []
    for x, x_of, n_x, y, y_of, n_y, mine, swap in ((a, a_of, n_a, b, b_of, n_b, drives, False),
                                                   (b, b_of, n_b, a, a_of, n_a, ~drives, True)):
        docs = np.flatnonzero(mine & (n_x > 0))
        doc = np.repeat(docs, n_x[docs])
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n_x[docs]) - n_x[docs], n_x[docs])
        i, lo, hi = x_of[doc] + k, y_of[doc], y_of[doc + 1]
        at = gallop(y, x[i], lo + k * n_y[doc] // n_x[doc], lo, hi)
        hit = at < hi
        hit[hit] = y[at[hit]] == x[i[hit]]
        got_a.append(at[hit] if swap else i[hit])
        got_b.append(i[hit] if swap else at[hit])
    pa, pb = np.concatenate(got_a), np.concatenate(got_b)
    order = np.argsort(pa, kind="stable")
    return pa[order], pb[order]


def _runs(ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ends of each document: their places (first, one past the last) and documents."""
    new = np.ones(len(ends), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(ends)), doc[first]


def _offsets(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1))


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], len_a: np.ndarray, len_b: np.ndarray):
    """Alignment of some documents, whose tokens all stand for the same bytes.

    Returns the groups as (document, first A, past A, first B, past B) and the
    links as (document, A place, B place), places counted over all documents.
    """
    n = len(ids_a)
    flat, sizes, ends, docs = [], [], [], []
    for ids, width in ((ids_a, len_a), (ids_b, len_b)):
        size = np.array([len(i) for i in ids], np.int64)
        all_ids = np.concatenate(ids) if n else np.zeros(0, np.uint32)
        doc = np.repeat(np.arange(n), size)
        total = np.cumsum(width[all_ids])
        before = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(size)[:-1]])] if n else np.zeros(0, np.int64)
        flat.append(all_ids), sizes.append(size), docs.append(doc)
        ends.append(total - before[doc] if len(doc) else total)
    (fa, la, da), (fb, lb, db) = _runs(ends[0], docs[0]), _runs(ends[1], docs[1])
    pa, pb = intersect(ends[0][fa], _offsets(da, n), ends[1][fb], _offsets(db, n))
    doc = da[pa]
    # a group runs from behind the common end before it to the last token that ends here
    past_a, past_b = la[pa], lb[pb]
    same = np.zeros(len(doc), bool)
    same[1:] = doc[1:] == doc[:-1]
    base_a, base_b = (np.cumsum(s) - s for s in sizes)
    first_a = np.where(same, np.concatenate([[0], past_a[:-1]])[:len(doc)], base_a[doc] if n else 0)
    first_b = np.where(same, np.concatenate([[0], past_b[:-1]])[:len(doc)], base_b[doc] if n else 0)
    # links: every A token that ends at a common end with every B token that does
    wide_a, wide_b = past_a - fa[pa], past_b - fb[pb]
    group = np.repeat(np.arange(len(doc)), wide_a * wide_b)
    k = np.arange(len(group)) - np.repeat(np.cumsum(wide_a * wide_b) - wide_a * wide_b, wide_a * wide_b)
    link_a, link_b = fa[pa][group] + k // np.maximum(wide_b[group], 1), fb[pb][group] + k % np.maximum(wide_b[group], 1)
    return (flat[0], flat[1], base_a, base_b,
            (doc, first_a, past_a, first_b, past_b), (doc[group], link_a, link_b))


def _group_text(flat_a, flat_b, groups, n_docs: int, spelt: list[bytes]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document."""
    doc, fa, pa, fb, pb = groups
    wide_a, wide_b = pa - fa, pb - fb
    # A tokens of a group, then its B tokens, group after group
    start = np.cumsum(wide_a + wide_b) - wide_a - wide_b
    total = int((wide_a + wide_b).sum())
    codes, mark = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for flat, first, wide, at, closing in ((flat_a, fa, wide_a, start, 1), (flat_b, fb, wide_b, start + wide_a, 2)):
        g = np.repeat(np.arange(len(doc)), wide)
        k = np.arange(len(g)) - np.repeat(np.cumsum(wide) - wide, wide)
        codes[at[g] + k] = flat[first[g] + k]
        mark[(at + wide - 1)[wide > 0]] = closing
    if len(doc):
        final = np.append(doc[1:] != doc[:-1], True)
        mark[(start + wide_a + wide_b - 1)[final]] = 3
    shown = list(map(spelt.__getitem__, (codes * 4 + mark).tolist()))
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    edge = np.append(start, total)[cut]
    return [b"".join(shown[s:e]) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())]


def pair_type(path_a: str, path_b: str) -> str:
    """numpy type of one id in a stored link."""
    return "<u2" if max(len(token_bytes(path_a, "byte")), len(token_bytes(path_b, "piece"))) <= 1 << 16 else "<u4"


def _keys(raw: list[bytes], kind: str) -> np.ndarray:
    """Stored links as one number each: A id + 2^32 B id."""
    ids = np.frombuffer(b"".join(raw), kind).astype(np.uint64)
    return ids[0::2] | (ids[1::2] << np.uint64(32))


def _links(path_a: str, path_b: str, kind: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc_a, enc_b = encoder(path_a, "byte", plain=False), encoder(path_b, "piece")
        bytes_a, bytes_b = token_bytes(path_a, "byte"), token_bytes(path_b, "piece")
        len_a, len_b = (np.array(list(map(len, t)), np.int64) for t in (bytes_a, bytes_b))
        spelt = [str(k).encode() + m for k in range(max(len(bytes_a), len(bytes_b))) for m in (b",", b"|", b";", b"")]
        none = np.zeros(0, "<u4")

        def alike(ids: np.ndarray, shown: list[bytes], text: str) -> bool:
            return b"".join(map(shown.__getitem__, ids.tolist())) == b" " + text.encode("utf-8")

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                of_a = [np.frombuffer(i, "<u4") for i in encoded(enc_a, part.column(1), " ")]
                of_b = [np.frombuffer(i, "<u4") for i in encoded(enc_b, part.column(1))]
                for k, t in enumerate(texts):
                    if not t or not alike(of_a[k], bytes_a, t) or not alike(of_b[k], bytes_b, t):
                        of_a[k] = of_b[k] = none
                flat_a, flat_b, _, _, groups, (doc, link_a, link_b) = align(of_a, of_b, len_a, len_b)
                digests = [hashlib.sha256(t).hexdigest() if t else ""
                           for t in _group_text(flat_a, flat_b, groups, len(texts), spelt)]
                pairs = np.stack([flat_a[link_a], flat_b[link_b]], axis=1).astype(kind)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(i) for i in of_a], pa.int64()),
                     pa.array([len(i) for i in of_b], pa.int64()),
                     pa.array(np.bincount(groups[0], minlength=len(texts)), pa.int64()), pa.array(digests, pa.string()),
                     pa.array([pairs[s:e].tobytes() for s, e in zip(cut, cut[1:])], pa.binary())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document its numbers of tokens and groups, the groups' digest, and
    ``pairs``: (A id, B id) of each link in order, in :func:`pair_type`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _links(path_a, path_b, pair_type(path_a, path_b)), LINKS)


def _tally(kind: str):
    def run(batches: Iterator) -> Iterator:
        """Counts of id pairs, added up within the task before the shuffle."""
        import pyarrow as pa

        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 8 * ROWS):
                k, c = np.unique(_keys(b.column(0).slice(at, 8 * ROWS).to_pylist(), kind), return_counts=True)
                keys, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, c]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
             pa.array((keys >> np.uint64(32)).astype(np.int64)), pa.array(counts)], names=["a", "b", "n"])

    return run


def pair_counts(links: DataFrame, kind: str) -> DataFrame:
    """(a, b, n): how many links corpus-wide hold the ids linked."""
    return (links.select("pairs").mapInArrow(_tally(kind), "a long, b long, n long")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))


def pair_bound(path_a: str, path_b: str) -> int:
    """How many id pairs can end together at all: one token is a suffix of the other."""
    many_a, many_b = {}, {}
    for many, shown in ((many_a, token_bytes(path_a, "byte")), (many_b, token_bytes(path_b, "piece"))):
        for t in shown:
            if t:
                many[t] = many.get(t, 0) + 1
    longer_a = sum(c * many_b.get(t[k:], 0) for t, c in many_a.items() for k in range(len(t)))
    longer_b = sum(c * many_a.get(t[k:], 0) for t, c in many_b.items() for k in range(1, len(t)))
    return longer_a + longer_b


def _figures(table, kind: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, counts, best = table.value
        for b in batches:
            raw = b.column(5)
            for at in range(0, b.num_rows, ROWS):
                own = raw.slice(at, ROWS).to_pylist()
                size = np.array(list(map(len, own)), np.int64) // (2 * np.dtype(kind).itemsize)
                flat = _keys(own, kind)
                at_key = np.searchsorted(keys, flat)
                count = counts[at_key] if len(keys) else np.zeros(0, np.int64)
                top = count == best[(flat >> np.uint64(32)).astype(np.int64)] if len(keys) else np.zeros(0, bool)
                edge = np.concatenate([[0], np.cumsum(size)])
                sums, tops = (np.concatenate([[0], np.cumsum(v)]) for v in (count, top))
                part = b.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(4)), pa.array(size), pa.array(np.diff(tops[edge])),
                     pa.array(np.diff(sums[edge]).astype(np.int64)), part.column(4)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def link_figures(spark: SparkSession, links: DataFrame, counts: DataFrame, bound: int, kind: str) -> DataFrame:
    """Per document: n_links, n_best (links whose count is the highest of their
    B id), count_sum (of all links' counts), beside the columns of ``links``."""
    rows = counts.limit(bound + 1).toPandas()  # the limit never cuts: checked next
    if len(rows) > bound:
        raise ValueError("more id pairs than the vocabularies allow")
    a, b = rows["a"].to_numpy(np.uint64), rows["b"].to_numpy(np.uint64)
    keys, n = a | (b << np.uint64(32)), rows["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    best = np.zeros(int(b.max()) + 1 if len(b) else 1, np.int64)
    np.maximum.at(best, b.astype(np.int64), n)
    table = spark.sparkContext.broadcast((keys[order], n[order], best))
    return links.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs").mapInArrow(_figures(table, kind), FIGURES)


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The whole operator: links written once, counted, and summed up by document."""
    links = written(align_documents(docs, path_a, path_b), "links")
    kind = pair_type(path_a, path_b)
    return link_figures(docs.sparkSession, links, pair_counts(links, kind), pair_bound(path_a, path_b), kind)
