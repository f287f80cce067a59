"""Operator 1 — document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk may end where its leading bits
are zero. Normalised chunking asks for more zero bits before the expected
length than after it, so lengths crowd around it. Boundaries depend only on
the 32 bytes before them, so an edit changes the chunks around it and no
others. A fingerprint is the set of chunk digests, each with its length, as a
sorted hex string (48 bits of digest, 16 bits of length: 16 digits a chunk).

Likeness of a fingerprint to another is containment weighted by length: the
share of its own chunk bytes whose digests the other one has.

Cases: a null text is an empty one; an empty text has the empty fingerprint,
like another empty one (1.0) and unlike any other text (0.0); very long texts
are hashed in blocks; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MIDDLE, MOST = 24, 64, 256
HARD, EASY = 8, 4  # zero bits asked for before and after MIDDLE bytes
_BLOCK = 1 << 20
_WINDOW = 32

#: a random 32-bit number for each byte value, by rule
_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little")
                  for b in range(256)], np.uint32)


def _cuts(raw: bytes) -> tuple[list[int], list[int]]:
    """Places where a chunk may end: by the hard and by the easy rule."""
    data = np.frombuffer(raw, np.uint8)
    hard, easy = [], []
    for at in range(0, len(data), _BLOCK):
        lead = min(at, _WINDOW)
        h = _GEAR[data[at - lead:at + _BLOCK]]
        for step in (1, 2, 4, 8, 16):  # sums of the last 2, 4, ... 32 bytes, each shifted by its age
            h[step:] = h[step:] + (h[:-step] << np.uint32(step)) if len(h) > step else h[step:]
        found = np.flatnonzero(h[lead:] < np.uint32(1 << (32 - EASY)))
        strict = h[lead:][found] < np.uint32(1 << (32 - HARD))
        found = found + at + 1
        inside = found < len(data)
        found, strict = found[inside], strict[inside]
        whole = (data[found] & 0xC0) != 0x80  # not within a character
        easy.append(found[whole])
        hard.append(found[whole & strict])
    return np.concatenate(hard).tolist(), np.concatenate(easy).tolist()


def chunks(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``."""
    n, start, ends = len(raw), 0, []
    if n > LEAST:
        hard, easy = _cuts(raw)
        i = j = 0
        n_hard, n_easy = len(hard), len(easy)
        while n - start > LEAST:
            i = bisect_left(hard, start + LEAST, i)
            if i < n_hard and hard[i] < start + MIDDLE:
                end = hard[i]
            else:
                j = bisect_left(easy, start + MIDDLE, j)
                if j < n_easy and easy[j] <= start + MOST:
                    end = easy[j]
                else:
                    end = min(n, start + MOST)
                    while end < n and raw[end] & 0xC0 == 0x80:
                        end += 1
            ends.append(end)
            start = end
    if start < n:
        ends.append(n)
    return ends


def fingerprint(text: str) -> np.ndarray:
    """Sorted distinct 64-bit numbers: digest << 16 | length."""
    import xxhash

    raw = text.encode("utf-8")
    ends = chunks(raw)
    if not ends:
        return np.zeros(0, np.uint64)
    starts, digest = [0, *ends[:-1]], xxhash.xxh3_64_intdigest
    codes = np.fromiter([digest(raw[s:e]) for s, e in zip(starts, ends)], np.uint64, len(ends))
    lengths = (np.asarray(ends) - np.asarray(starts)).astype(np.uint64)
    return np.unique((codes & np.uint64(0xFFFFFFFFFFFF0000)) | lengths)


def shown(print_: np.ndarray) -> str:
    return print_.astype(">u8").tobytes().hex()


def parsed(text: str) -> np.ndarray:
    """The fingerprint that :func:`shown` wrote."""
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of ``a``'s chunk bytes that ``b`` has too."""
    if not len(a):
        return 1.0 if not len(b) else 0.0
    length = np.uint64(0xFFFF)
    both = np.intersect1d(a, b, assume_unique=True)
    return float((both & length).sum()) / float((a & length).sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([shown(fingerprint(t)) for t in texts], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


# ---- comparison with the next document and with an edited text ------------------


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first characters of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


_PAIRS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _dealt(bounds: list, also: dict):
    """Map side: each row with its bucket, and the first row of a bucket to the
    bucket before it once more (``ahead``)."""
    cut = np.asarray(bounds, np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids = b.column(0)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = len(cut) - np.searchsorted(cut, values, side="right")
            bucket[ids.is_null().to_numpy(zero_copy_only=False)] = len(cut)
            rows = [(pa.array(bucket, pa.int32()), pa.array(np.zeros(len(ids), bool)), b)]
            for k in np.flatnonzero(np.isin(values, [x for x in also if x is not None])).tolist() + (
                    np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)).tolist() if None in also else []):
                doc_id = ids[k].as_py()
                if doc_id in also:
                    rows.append((pa.array([also[doc_id]], pa.int32()), pa.array([True]), b.slice(k, 1)))
            for where, ahead, part in rows:
                yield pa.RecordBatch.from_arrays([where, ahead, *part.columns],
                                                 names=["bucket", "ahead", "doc_id", "text"])

    return run


def _heads(bounds: list):
    """Highest doc_id of each bucket in each batch (null: only null ids)."""
    cut = np.asarray(bounds, np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids = b.column(0)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            values = ids.drop_null().to_numpy(zero_copy_only=False)
            bucket = len(cut) - np.searchsorted(cut, values, side="right")
            found = {int(k): int(values[bucket == k].max()) for k in np.unique(bucket)}
            if none.any():
                found.setdefault(len(cut), None)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
                                             names=["bucket", "doc_id"])

    return run


def _compared(batches: Iterator) -> Iterator:
    """Reduce side: rows in order; each is compared with the one after it."""
    import pyarrow as pa

    def rows():
        for b in batches:
            for doc_id, text, ahead in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                yield doc_id, text.as_py() or "", ahead

    def compared():
        last = None
        for doc_id, text, ahead in rows():
            own = fingerprint(text)
            if last is not None:
                before, text_before, print_before = last
                new = edited(text_before, text)
                print_new = fingerprint(new)
                yield (before, len(text_before), hashlib.sha256(new.encode("utf-8")).hexdigest(), shown(print_before),
                       shown(print_new), containment(print_before, print_new), containment(print_before, own))
            if ahead:
                return
            last = doc_id, text, own

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kept: list = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names=names)

    for row in compared():
        kept.append(row)
        if len(kept) == 500:
            yield batch()
            kept = []
    if kept:
        yield batch()


def compare_with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness.

    The next document is the one with the next lower doc_id (rows with the
    same id by text, null ids last; after the last row comes the first). The
    ids are cut into ranges at quantiles; each range is one task, which also
    gets the first row of the next range. So the texts move once, in ranges,
    and only quantiles and one id a range come to the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shares = [k / partitions for k in range(1, partitions)]
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", shares, 0.1 / partitions)}) if shares else []
    first = (rows.select("doc_id").mapInArrow(_heads(bounds), "bucket int, doc_id long")
             .groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect())
    also = {row.doc_id: first[k - 1].bucket for k, row in enumerate(first)}  # the first row follows the last
    return (rows.mapInArrow(_dealt(bounds, also), "bucket int, ahead boolean, doc_id long, text string")
            .repartitionById(len(bounds) + 1, F.col("bucket"))
            .sortWithinPartitions("ahead", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")))
            .select("doc_id", "text", "ahead").mapInArrow(_compared, _PAIRS))
