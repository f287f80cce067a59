"""Operator 2 — token ids as fixed-width packed bits.

Each id takes ``bits = ceil(log2(vocabulary))`` bits. A *segment* is a run of
whole documents of about ``segment_ids`` ids, in one payload:

    magic "PKB1" | bits u32 | ids a block u32 | blocks u32 | ids u64
    | byte offset of each block, u64 each | blocks

A block holds ``BLOCK_IDS`` ids (the last may hold fewer), its first id in the
low bits of its first byte; blocks begin on a byte, so that the offsets allow
any id to be reached by unpacking one block (:func:`id_at`), and a block is
unpacked with whole-array numpy operations (:func:`unpack`).

Segments are the rows of a Parquet table (shard, segment, first id within the
shard, the documents' ids and their offsets, payload). Spark's committer
writes it, so that a task that is run again leaves nothing behind, and any
store that Spark reaches can hold it. Shard ``k`` holds lower ids than shard
``k + 1``; the ids before a shard are the sum of a few numbers a shard.

Cases: a null text is an empty one (only the end id); null doc_ids come first;
rows with the same doc_id stay separate, in the order of their texts; an empty
table gives empty files; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.llm.common import shuffle_partitions
from shoplens.llm.tokens import encoded, encoder

MAGIC, HEAD, BLOCK_IDS = b"PKB1", struct.Struct("<4sIIIQ"), 4096

SEGMENTS = ("shard int, segment int, first_id long, n_ids long, doc_ids array<long>, "
            "doc_starts array<long>, payload binary")


def bits_for(vocabulary: int) -> int:
    """Least number of bits that can hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The payload of one segment."""
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    if n and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    body = []
    for at in range(0, n, BLOCK_IDS):
        part = ids[at:at + BLOCK_IDS].astype(np.uint32)
        if bits in (8, 16, 32):
            body.append(part.astype(f"<u{bits // 8}").tobytes())
        else:
            shown = (part[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
            body.append(np.packbits(shown.astype(np.uint8).ravel(), bitorder="little").tobytes())
    sizes = [len(b) for b in body]
    start = HEAD.size + 8 * blocks
    offsets = start + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if blocks else np.zeros(0)
    return (HEAD.pack(MAGIC, bits, BLOCK_IDS, blocks, n)
            + offsets.astype("<u8").tobytes() + b"".join(body))


def _head(payload: bytes) -> tuple[int, int, int, np.ndarray]:
    magic, bits, per, blocks, n = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of packed ids")
    return bits, per, n, np.frombuffer(payload, "<u8", blocks, HEAD.size)


def _block(payload: bytes, bits: int, at: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, at).astype("<u4")
    raw = np.frombuffer(payload, np.uint8, -(-n * bits // 8), at)
    shown = np.unpackbits(raw, bitorder="little", count=n * bits).reshape(n, bits)
    return (shown.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def unpack(payload: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a segment; reads only their blocks."""
    bits, per, n, offsets = _head(payload)
    last = n if count is None else min(n, first + count)
    if first >= last:
        return np.zeros(0, "<u4")
    a, b = first // per, -(-last // per)
    got = [_block(payload, bits, int(offsets[k]), min(per, n - k * per)) for k in range(a, b)]
    return np.concatenate(got)[first - a * per:last - a * per]


def id_at(payload: bytes, k: int) -> int:
    """Random access: the ``k``-th id, from one block."""
    return int(unpack(payload, k, 1)[0])


def _segments(path: str, kind: str, end_id: int, segment_ids: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(path, kind)
        bits, end = bits_for(enc.vocab), np.array([end_id], "<u4").tobytes()
        ids, docs, starts, n, first, segment = [], [], [], 0, 0, 0

        def batch():
            payload = pack(np.frombuffer(b"".join(ids), "<u4"), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()),
                 pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())),
                 pa.array([payload], pa.binary())],
                names=["shard", "segment", "first_id", "n_ids", "doc_ids", "doc_starts", "payload"])

        for b in batches:
            for doc_id, own in zip(b.column(0).to_pylist(), encoded(enc, b.column(1))):
                docs.append(doc_id)
                starts.append(n)
                ids.append(own)
                ids.append(end)
                n += len(ids[-2]) // 4 + 1
                if n >= segment_ids:
                    yield batch()
                    first, segment = first + n, segment + 1
                    ids, docs, starts, n = [], [], [], 0
        if n:
            yield batch()

    return run


def write_packed(docs: DataFrame, path: str, tokenizer: str, kind: str = "space", end_id: int = 2,
                 segment_ids: int = 1 << 18, shards: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) into a folder of packed segments.

    One shuffle of the texts puts them in doc_id order; the range bounds come
    from a sample of the ids alone.
    """
    shards = shards or shuffle_partitions(docs.sparkSession)
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .repartitionByRange(shards, F.col("doc_id"))
     .sortWithinPartitions("doc_id", "text")
     .mapInArrow(_segments(tokenizer, kind, end_id, segment_ids), SEGMENTS)
     .write.parquet(path))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, shard_start): ids in all shards before it; one row a shard."""
    sums = read_segments(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return sums.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))


def _documents(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        for row in range(b.num_rows):
            shard, first, docs, starts, payload = (b.column(k)[row].as_py() for k in range(5))
            ids = unpack(payload).astype("<u4", copy=False)
            ends = [*starts[1:], len(ids)]
            crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()),
                 pa.array([first + s for s in starts], pa.int64()),
                 pa.array([e - s for s, e in zip(starts, ends)], pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    read = read_segments(spark, path).select("shard", "first_id", "doc_ids", "doc_starts", "payload")
    rows = read.mapInArrow(_documents, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(shard_starts(spark, path))  # a row a shard: as many as the writer had partitions
    return rows.join(starts, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
