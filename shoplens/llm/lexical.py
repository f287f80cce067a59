"""Operator 11 — ranked lexical search over bit-sliced Bloom signatures.

Documents are indexed in *blocks* of equal signature width. A document's
signature is a Bloom filter over (term, level): level ``l`` of a term is set if
the term occurs at least ``LEVELS[l]`` times. A block stores its signatures
sliced, one bitmap over its documents for each bit of the signature. For a query
term and level the AND of its ``HASHES`` slices is a bitmap of documents that
holds every document where the term reaches that level, and a few more. So

    sum over levels of (weighted sum of the terms' bitmaps) x (growth of the
    term factor from the level below to the most occurrences of this level)

is at least the score of every document of the block, in whole numbers.

:func:`search` first scores the documents with the highest bounds exactly; the
lowest of an item's best ``top`` is its threshold. Then every document whose
bound is not under it is scored exactly from its text, and ranked. Documents
left out provably rank behind: their bound is lower, or equal with a higher id.
Queries are taken in blocks of about ``ITEMS``, so that what is sent to the
tasks is bounded by that number and the queries' own terms.

Terms are runs of digits, letters and all code points from U+0080 on, A-Z lower-cased.
In UTF-8 these are runs of single byte values, so that terms are found and hashed
in whole arrays. A hash only ever proposes: document frequencies and scores
compare the terms themselves.

Cases: a null text has no terms; documents without terms are in no block, as
their score is 0; rows with the same doc_id, or alike, are documents of their
own; ties go by doc_id, a null one last, then by a hash of the text; query rows
alike in id and text count once, other rows with one id are ranked each by
itself; queries without a term, or without a match, and empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.llm.common import written

#: occurrences from which a level is set: each number up to 8, then four a doubling
LEVELS = np.array([*range(1, 9), *(2 ** (3 + q // 4) * (4 + q % 4) // 4 for q in range(1, 53))], np.int64)
HASHES, BITS_A_KEY = 6, 10
BLOCK_BITS, BLOCK_DOCS = 1 << 23, 2048
ITEMS = 256
LONG_TERM = 256
CHUNK = 1 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_TERM = np.zeros(256, np.int8)
_IN_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_M1, _M2, _M3 = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
LAST_ID = np.iinfo(np.int64).max

BLOCKS = "width int, levels int, doc_ids array<long>, keys array<long>, lengths array<long>, slices binary"


# ---- terms ------------------------------------------------------------------------


def terms(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode("utf-8").lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Terms:
    """All terms of some texts: ``doc``, ``start``, ``size`` and ``hash`` of each."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8").lower() for t in texts]
        self.raw = b"\0".join(parts) + bytes(9)
        flat = np.frombuffer(self.raw, np.uint8)
        edge = np.diff(_IN_TERM[flat], prepend=np.int8(0))
        self.start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.size = end - self.start
        first = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.doc = np.searchsorted(first, self.start, "right") - 1
        #: eight bytes from every place on
        self.words = np.ndarray((len(self.raw) - 8,), "<u8", self.raw, 0, (1,))
        self.hash = self._hashes()

    def word(self, which: np.ndarray, r: int) -> np.ndarray:
        """Bytes 8r to 8r + 8 of the terms ``which``, those behind the end as zeros."""
        left = np.minimum(self.size[which] - 8 * r, 8).astype(np.uint64)
        return self.words[self.start[which] + 8 * r] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.start[i]:self.start[i] + self.size[i]]

    def _hashes(self) -> np.ndarray:
        import xxhash

        out = self.size.astype(np.uint64) * _M1
        todo = np.flatnonzero(self.size <= LONG_TERM)
        for r in range(LONG_TERM // 8):
            todo = todo[self.size[todo] > 8 * r]
            if not len(todo):
                break
            out[todo] = _mixed(out[todo] ^ self.word(todo, r) + _M1)
        for i in np.flatnonzero(self.size > LONG_TERM).tolist():
            out[i] = xxhash.xxh64_intdigest(self.bytes_of(i))
        return out


def _chunks(column) -> Iterator[tuple[int, list]]:
    """Texts of an Arrow column, about a million characters at a time, with their first row."""
    at, size, own = 0, 0, []
    for row, text in enumerate(column):
        own.append(text.as_py())
        size += len(own[-1] or "") + 1
        if size >= CHUNK:
            yield at, own
            at, size, own = row + 1, 0, []
    if own:
        yield at, own


# ---- the index --------------------------------------------------------------------


def _places(hashes: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """[key, HASHES] slices of (term, level) in signatures of ``width`` bits, a power of two."""
    level = np.atleast_1d(level).astype(np.uint64)
    key = _mixed(hashes + (level + np.uint64(1)) * _M1)
    step = (key >> np.uint64(32)) | np.uint64(1)
    at = key[..., None] + np.arange(HASHES, dtype=np.uint64) * step[..., None]
    return (at & np.uint64(width - 1)).astype(np.int64)


def width_for(keys: int) -> int:
    return 1 << max(6, math.ceil(math.log2(max(1, keys * BITS_A_KEY))))


def _index(batches: Iterator) -> Iterator:
    import pyarrow as pa

    pending: dict[int, list] = {}

    def block(width: int):
        docs = pending.pop(width)
        slices = np.zeros((width, -(-len(docs) // 8)), np.uint8)
        for j, (_, _, _, hashes, level) in enumerate(docs):
            slices[_places(hashes, level, width).ravel(), j >> 3] |= np.uint8(1 << (j & 7))
        top = max(int(d[4].max()) for d in docs) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([top], pa.int32()),
             *(pa.array([[d[k] for d in docs]], pa.list_(pa.int64())) for k in range(3)),
             pa.array([slices.tobytes()], pa.binary())],
            names=["width", "levels", "doc_ids", "keys", "lengths", "slices"])

    for b in batches:
        ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
        for at, texts in _chunks(b.column(2)):
            found = Terms(texts)
            cut = np.searchsorted(found.doc, np.arange(len(texts) + 1)).tolist()
            for j, (s, e) in enumerate(zip(cut, cut[1:])):
                if s == e:
                    continue
                hashes, count = np.unique(found.hash[s:e], return_counts=True)
                n = np.searchsorted(LEVELS, count, "right")
                total = int(n.sum())
                level = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                width = width_for(total)
                own = pending.setdefault(width, [])
                own.append((ids[at + j], keys[at + j], e - s, np.repeat(hashes, n), level))
                if len(own) >= max(1, min(BLOCK_DOCS, BLOCK_BITS // width)):
                    yield block(width)
    for width in sorted(pending):
        yield block(width)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: a document is known by its id and a hash of its text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(text).alias("key"), text.alias("text"))


def build_index(docs: DataFrame) -> DataFrame:
    """The blocks of all ``docs`` (doc_id, text), written once."""
    return written(_rows(docs).mapInArrow(_index, BLOCKS), "slices")


# ---- queries ----------------------------------------------------------------------


class Queries:
    """A block of queries against a corpus of N documents and L terms.

    ``term`` are the distinct terms in the order of their hashes; ``items`` has
    for each query its terms' places and weights (repeats added up)."""

    def __init__(self, texts: list[str]):
        self.counts = [Counter(terms(t)) for t in texts]
        self.term = sorted({t for c in self.counts for t in c})
        found = Terms([t.decode("utf-8") for t in self.term])
        order = np.argsort(found.hash, kind="stable")
        self.term = [self.term[i] for i in order.tolist()]
        self.hash = found.hash[order]
        self.place = {t: i for i, t in enumerate(self.term)}

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
        self.items = [[(self.place[t], n * w[self.place[t]]) for t, n in c.items()] for c in self.counts]
        table = np.zeros((len(self.items), len(self.term)), np.int64)
        for q, item in enumerate(self.items):
            for i, v in item:
                table[q, i] = v
        # sums below 2^24 are whole in single precision
        self.weight = table.astype(np.float32 if table.sum(axis=1).max(initial=0) < 1 << 24 else np.float64)

    def length(self, n):
        """The contract's m of documents with ``n`` terms."""
        return 75 + (25 * n * self.n_docs) // max(self.n_terms, 1)


def factor(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def bounds(q: Queries, width: int, levels: int, lengths: np.ndarray, slices: bytes) -> np.ndarray:
    """[query, document]: no score of a document of the block is above this."""
    n = len(lengths)
    table = np.frombuffer(slices, np.uint8).reshape(width, -(-n // 8))
    m = q.length(lengths)
    out, below = np.zeros((len(q.items), n), np.int64), np.zeros(n, np.int64)
    active, held = np.arange(len(q.term)), None
    for level in range(levels):
        places = _places(q.hash[active], level, width)
        bits = table[places[:, 0]]
        for k in range(1, HASHES):
            bits &= table[places[:, k]]
        if held is not None:
            bits &= held
        some = bits.any(axis=1)
        active, held = active[some], bits[some]
        if not len(active):
            break
        most = lengths if level + 1 >= len(LEVELS) else np.minimum(LEVELS[level + 1] - 1, lengths)
        grown = factor(most, m)
        shown = np.unpackbits(held, axis=1, count=n, bitorder="little")
        sums = q.weight[:, active] @ shown.astype(q.weight.dtype)
        out += sums.astype(np.int64) * (grown - below)
        below = grown
    return out


def _blocks(batches: Iterator) -> Iterator[tuple]:
    for b in batches:
        for row in range(b.num_rows):
            width, levels, ids, keys, lengths, slices = (c[row].as_py() for c in b.columns)
            yield width, levels, ids, keys, np.array(lengths, np.int64), slices


def _order(ids: list) -> np.ndarray:
    return np.array([LAST_ID if i is None else i for i in ids], np.int64)


def _highest(queries, n: int):
    """Of each query the ``n`` documents with the highest bounds in this task."""

    def run(batches: Iterator) -> Iterator:
        q = queries.value
        best = [[] for _ in q.items]  # (bound, -id, key, id)
        for width, levels, ids, keys, lengths, slices in _blocks(batches):
            bound, by = bounds(q, width, levels, lengths, slices), _order(ids)
            for k, own in enumerate(best):
                least = own[0][0] if len(own) == n else 1
                some = np.flatnonzero(bound[k] >= least)
                if len(some) > n:  # highest bounds, then lowest ids
                    some = some[np.lexsort((by[some], -bound[k, some]))[:n]]
                for j in some.tolist():
                    row = (int(bound[k, j]), -int(by[j]), keys[j], ids[j])
                    if len(own) < n:
                        heapq.heappush(own, _Row(row))
                    elif own[0] < _Row(row):
                        heapq.heapreplace(own, _Row(row))
        rows = [(k, r[3], r[2], r[0]) for k, own in enumerate(best) for r in own]
        yield _table(rows, ("q", "doc_id", "key", "bound"))

    return run


class _Row(tuple):
    """Ordered by its first three fields; the fourth may be null."""

    def __lt__(self, other):
        return self[:3] < other[:3]


def _table(rows: list[tuple], names: tuple):
    import pyarrow as pa

    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=list(names))


def _possible(queries, threshold):
    """(query, document) pairs whose bound doesn't exclude them."""

    def run(batches: Iterator) -> Iterator:
        q, (least, last) = queries.value, threshold.value
        for width, levels, ids, keys, lengths, slices in _blocks(batches):
            bound, by = bounds(q, width, levels, lengths, slices), _order(ids)
            which, j = np.nonzero((bound > least[:, None]) | ((bound == least[:, None]) & (by[None, :] <= last[:, None]) & (bound > 0)))
            yield _table([(a, ids[b], keys[b]) for a, b in zip(which.tolist(), j.tolist())], ("q", "doc_id", "key"))

    return run


def _scores(queries, top: int):
    """Exact scores of a text for its list of queries; a task keeps its best ``top`` of each."""

    def run(batches: Iterator) -> Iterator:
        q = queries.value
        best: dict[int, list] = {}
        for b in batches:
            for row in range(b.num_rows):
                doc_id, key, text, which = (c[row].as_py() for c in b.columns)
                found = terms(text)
                tf, m = Counter(found), q.length(len(found))
                for k in which:
                    score = 0
                    for i, w in q.items[k]:
                        n = tf.get(q.term[i])
                        if n:
                            score += w * factor(n, m)
                    if score <= 0:
                        continue
                    own, new = best.setdefault(k, []), _Row((score, -(LAST_ID if doc_id is None else doc_id), -key, doc_id))
                    if len(own) < top:
                        heapq.heappush(own, new)
                    elif own[0] < new:
                        heapq.heapreplace(own, new)
        yield _table([(k, r[3], -r[2], r[0]) for k, own in best.items() for r in own], ("q", "doc_id", "key", "score"))

    return run


def _found(queries):
    """How many documents of this task hold each query term; equal hashes are held against the bytes."""

    def run(batches: Iterator) -> Iterator:
        q = queries.value
        sizes = np.array([len(t) for t in q.term], np.int64)
        own = Terms([t.decode("utf-8") for t in q.term])  # in the same order
        df, alike = np.zeros(len(q.term), np.int64), int(np.unique(q.hash, return_counts=True)[1].max())
        for b in batches:
            for _, texts in _chunks(b.column(0)):
                seen = Terms(texts)
                near = np.searchsorted(q.hash, seen.hash)
                for k in range(alike):  # terms of one hash stand side by side
                    at = np.minimum(near + k, len(q.hash) - 1)
                    hit = np.flatnonzero((near + k < len(q.hash)) & (q.hash[at] == seen.hash) & (sizes[at] == seen.size))
                    same, term = np.ones(len(hit), bool), at[hit]
                    for r in range(-(-int(sizes.max()) // 8)):
                        some = np.flatnonzero(sizes[term] > 8 * r)
                        if not len(some):
                            break
                        same[some] &= seen.word(hit[some], r) == own.word(term[some], r)
                    pairs = np.unique(seen.doc[hit[same]] * len(q.term) + term[same])
                    df += np.bincount(pairs % len(q.term), minlength=len(q.term))
        some = np.flatnonzero(df)
        yield _table(list(zip(some.tolist(), df[some].tolist())), ("term", "df"))

    return run


def _weighed(spark: SparkSession, docs: DataFrame, blocks: DataFrame, q: Queries) -> None:
    sent = spark.sparkContext.broadcast(q)
    found = (docs.select("text").mapInArrow(_found(sent), "term long, df long")
             .groupBy("term").agg(F.sum("df").alias("df")).collect())  # a row a query term at most
    df = np.zeros(len(q.term), np.int64)
    for r in found:
        df[r["term"]] = r["df"]
    sums = blocks.agg(F.sum(F.size("lengths")).alias("n"),
                      F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    q.weigh(sums["n"] or 0, sums["l"] or 0, df)


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "key")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _scored(docs: DataFrame, pairs: DataFrame, queries, top: int, few: bool) -> DataFrame:
    """Exact scores of ``pairs`` (q, doc_id, key), the best ``top`` of each query and task."""
    # a document has at most as many queries as the block of queries
    asked = (pairs.groupBy("doc_id", "key").agg(F.collect_set("q").alias("qs"))
             .select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "qs"))
    asked = F.broadcast(asked) if few else asked
    rows = docs.join(asked, (docs["key"] == F.col("k")) & docs["doc_id"].eqNullSafe(F.col("id")))
    return rows.select("doc_id", "key", "text", "qs").mapInArrow(_scores(queries, top), "q long, doc_id long, key long, score long")


def search(docs: DataFrame, blocks: DataFrame, items: DataFrame, top: int = 20, probe: int = 64) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the ``top`` documents.

    ``blocks`` is :func:`build_index` of the same ``docs``. ``probe`` documents
    of the highest bounds an item give its threshold; more make it tighter and
    change no result.
    """
    spark, rows = docs.sparkSession, _rows(docs)
    items = (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .filter("text IS NOT NULL").distinct())
    n = -(-items.count() // ITEMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(n):  # each block of queries is a pass over the index
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        q = Queries([r["text"] for r in mine])
        if not q.term:
            continue
        _weighed(spark, rows, blocks, q)
        sent = spark.sparkContext.broadcast(q)
        high = blocks.mapInArrow(_highest(sent, probe), "q long, doc_id long, key long, bound long")
        order = W.partitionBy("q").orderBy(F.desc("bound"), F.col("doc_id").asc_nulls_last(), "key")
        high = written(high.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= probe).drop("r"), "probe")
        # at most probe rows a query are sent to the tasks
        first = _ranked(_scored(rows, high, sent, top, few=True), top).filter(F.col("rank") == top).collect()
        least, last = np.zeros(len(mine), np.int64), np.full(len(mine), LAST_ID)
        for r in first:
            least[r["q"]], last[r["q"]] = r["score"], LAST_ID if r["doc_id"] is None else r["doc_id"]
        limit = spark.sparkContext.broadcast((least, last))
        pairs = written(blocks.mapInArrow(_possible(sent, limit), "q long, doc_id long, key long"), "possible")
        best = _ranked(_scored(rows, pairs, sent, top, few=False), top)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], "q long, item_id long")
        out = out.unionByName(best.join(F.broadcast(ids), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
