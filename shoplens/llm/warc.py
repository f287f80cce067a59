"""Operator 13 — WARC archives as seekable Zstandard bundles.

A *bundle* is a ``.warc.zst`` file: a run of independent Zstandard frames, each
with whole records of about ``frame_bytes`` together, and at the end a
skippable frame with the sizes of all frames (the public "seekable format"). A
reader finds a record from its frame and its offset within that frame, and
decompresses that frame alone (:func:`frame_at`); any Zstandard tool unpacks the
whole file. Frame 0 holds the bundle's ``warcinfo`` record.

Bundles are the rows of a table, beside arrays that map each record's id to
its frame and offset; Spark's committer writes it, so that a task that is run
again leaves nothing behind and any store that Spark reaches can hold it.
:func:`export_bundles` writes them out as files on a shared folder.

Equal payloads of at least ``least`` bytes are stored once: the record of the
smallest page_id (a null id last, then by the hash of url and payload, then the
first of rows alike) is a ``response``, all others are ``revisit`` records that
refer to it. Rows are dealt by payload digest, so that a group meets its
response in one sorted task, which streams. The at most ``HEAVY`` largest groups
are dealt by record instead, as their response is known from an aggregate
beforehand: what is left holds at most 1 / HEAVY of all rows in a group.

Cases: a null html is an empty payload; payloads under ``least`` bytes are all
responses; a null url gives the record's own id as target; a null page_id
stays null, and ``refers_to`` is null where the response's page_id is; rows
alike in all columns are records of their own, in one task; control
characters in a url are percent-encoded; an empty table gives no bundles;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import shuffle_partitions

#: magic numbers of the Zstandard skippable frame and seek table: fixed values
SKIPPABLE, SEEK_TABLE = 0x184D2A5E, 0x8F92EAB1
#: WARC 1.1 revisit profile: a fixed value
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAVY = 1000

BUNDLES = ("bundle string, n_records long, data binary, page_ids array<long>, record_ids array<string>, "
           "refers_to array<string>, frames array<int>, offsets array<long>, lengths array<long>")
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, record_id string")
_NAME = re.compile(r"<tag:shoplens,2025:page/(-?\d*)/")
_CONTROL = re.compile("[\x00-\x20\x7f]")


# ---- frames and records -------------------------------------------------------


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: (compressed, plain) size of each frame, as a skippable frame."""
    body = b"".join(struct.pack("<II", c, p) for c, p in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_TABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_sizes(data: bytes) -> list[tuple[int, int]]:
    """(compressed, plain) sizes from the footer of a bundle."""
    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_TABLE:
        raise ValueError("no seek table at the end")
    width = 12 if descriptor & 0x80 else 8  # with or without a checksum a frame
    at = len(data) - 9 - n * width
    return [struct.unpack_from("<II", data, at + k * width) for k in range(n)]


def frame_at(data: bytes, k: int, sizes: list[tuple[int, int]] | None = None) -> bytes:
    """Random access: the plain bytes of frame ``k`` alone."""
    import zstandard

    sizes = sizes or frame_sizes(data)
    start = sum(c for c, _ in sizes[:k])
    return zstandard.ZstdDecompressor().decompress(data[start:start + sizes[k][0]], max_output_size=sizes[k][1])


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def parse(plain: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: its fields, its block, and where the next one begins."""
    if plain[at:at + 10] != b"WARC/1.1\r\n":
        raise ValueError("no record here")
    body = plain.index(b"\r\n\r\n", at) + 4
    fields = dict(line.split(": ", 1) for line in plain[at + 10:body - 4].decode("utf-8").split("\r\n"))
    end = body + int(fields["Content-Length"])
    if plain[end:end + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return fields, plain[body:end], end + 4


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(frame, offset, fields, block) of every record of a bundle."""
    sizes = frame_sizes(data)
    start = 0
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for k, (packed, plain_size) in enumerate(sizes):
        plain, at = unpack.decompress(data[start:start + packed], max_output_size=plain_size), 0
        if len(plain) != plain_size:
            raise ValueError("a frame's size is not the one in the seek table")
        while at < len(plain):
            fields, block, after = parse(plain, at)
            yield k, at, fields, block
            at = after
        start += packed


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields and payload of a response's block."""
    end = block.index(b"\r\n\r\n")
    lines = block[:end].decode("latin-1").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines), block[end + 4:]


def page_of(record_id: str) -> int | None:
    found = _NAME.match(record_id)
    if not found:
        raise ValueError(f"not a record id of this writer: {record_id}")
    return int(found[1]) if found[1] else None


class _Bundle:
    """Frames of one bundle as they grow."""

    def __init__(self, name: str, frame_bytes: int, level: int, date: str):
        import zstandard

        self.name, self.frame_bytes = name, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.data, self.sizes, self.plain, self.rows = bytearray(), [], bytearray(), []
        info = b"software: shoplens\r\nformat: WARC File Format 1.1\r\n"
        self.plain += record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<tag:shoplens,2025:bundle/{name}>"),
                              ("WARC-Date", date), ("WARC-Filename", f"{name}.warc.zst"),
                              ("Content-Type", "application/warc-fields")], info)

    def close_frame(self) -> None:
        if self.plain:
            packed = self.packer.compress(bytes(self.plain))
            self.data += packed
            self.sizes.append((len(packed), len(self.plain)))
            self.plain = bytearray()

    def add(self, page_id, record_id: str, refers: str | None, whole: bytes) -> None:
        self.rows.append((page_id, record_id, refers, len(self.sizes), len(self.plain), len(whole)))
        self.plain += whole
        if len(self.plain) >= self.frame_bytes:
            self.close_frame()

    def batch(self):
        import pyarrow as pa

        self.close_frame()
        cols = list(zip(*self.rows))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([self.name]), pa.array([len(self.rows)], pa.int64()),
             pa.array([bytes(self.data) + seek_table(self.sizes)], pa.binary()),
             *(pa.array([list(c)], pa.list_(t)) for c, t in zip(cols, kinds))],
            names=["bundle", "n_records", "data", "page_ids", "record_ids", "refers_to", "frames", "offsets", "lengths"])


def _record_id(page_id, name: int, digest: str, copy: int) -> str:
    shown = "" if page_id is None else page_id
    return f"<tag:shoplens,2025:page/{shown}/{name & (1 << 64) - 1:016x}{digest[:16]}/{copy}>"


def _writer(least: int, frame_bytes: int, bundle_bytes: int, level: int, date: str):
    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, seq, out = TaskContext.get().partitionId(), 0, None
        group = response = last = None
        copy = 0
        for b in batches:
            for row in range(b.num_rows):
                page_id, name, url, html, digest, heavy, first_id, first_name = (c[row].as_py() for c in b.columns)
                payload = (html or "").encode("utf-8")
                copy = copy + 1 if last == (digest, page_id, name) else 0
                last = (digest, page_id, name)
                own = _record_id(page_id, name, digest, copy)
                if len(payload) < least:
                    refers = None
                elif heavy:
                    known = _record_id(first_id, first_name, digest, 0)
                    refers = None if own == known else known
                else:
                    if digest != group:
                        group, response = digest, own
                    refers = None if own == response else response
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                target = own[1:-1] if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
                fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", own), ("WARC-Date", date),
                          ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
                if refers:
                    fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers)]
                fields.append(("Content-Type", "application/http; msgtype=response"))
                if out is None:
                    out = _Bundle(f"{part:06d}-{seq:06d}", frame_bytes, level, date)
                out.add(page_id, own, refers, record(fields, http if refers else http + payload))
                if len(out.data) >= bundle_bytes:
                    yield out.batch()
                    out, seq = None, seq + 1
        if out is not None:
            yield out.batch()

    return run


# ---- Spark jobs ------------------------------------------------------------------


def write_bundles(pages: DataFrame, path: str, least: int = 100, frame_bytes: int = 1 << 18,
                  bundle_bytes: int = 1 << 24, level: int = 3, date: str = "2025-01-01T00:00:00Z",
                  partitions: int | None = None) -> None:
    """Archive ``pages`` (page_id, url, html) into a table of bundles at ``path``."""
    url, html = F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.sha2(html, 256)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64(url, digest).alias("name"),
                        url.alias("url"), html.alias("html"), digest.alias("digest"))
    large = F.octet_length("html") >= least
    first = F.min(F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "name"))
    heavy = (rows.filter(large).groupBy(F.col("digest").alias("of")).agg(F.count("*").alias("n"), first.alias("first"))
             .filter("n > 1").orderBy(F.desc("n"), "of").limit(HEAVY)
             .select("of", F.col("first.page_id").alias("first_id"), F.col("first.name").alias("first_name")))
    rows = rows.join(F.broadcast(heavy), F.col("digest") == F.col("of"), "left")  # at most HEAVY rows are sent
    by_record = F.col("of").isNotNull() | ~large
    dealt = F.when(by_record, F.xxhash64("page_id", "name")).otherwise(F.xxhash64("digest"))
    (rows.withColumn("dealt", dealt)
     .repartition(partitions or shuffle_partitions(pages.sparkSession), "dealt")
     .sortWithinPartitions("digest", F.col("page_id").isNull(), "page_id", "name")
     .select("page_id", "name", "url", "html", "digest", F.col("of").isNotNull().alias("heavy"), "first_id", "first_name")
     .mapInArrow(_writer(least, frame_bytes, bundle_bytes, level, date), BUNDLES)
     .write.option("compression", "none").parquet(path))  # frames are packed already


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLES).parquet(path)


def _read(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        for data in b.column(0):
            cols: list[list] = [[] for _ in range(7)]
            for _, _, fields, block in records(data.as_py()):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                own, digest = fields["WARC-Record-ID"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                http, payload = payload_of(block)
                refers = fields.get("WARC-Refers-To")
                if not refers and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"the payload of {own} is not the one that was written")
                target = fields["WARC-Target-URI"]
                for c, v in zip(cols, (page_of(own), None if f"<{target}>" == own else target, int(http["Content-Length"]), digest,
                                       fields["WARC-Type"], page_of(refers) if refers else None, own)):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record, read back from the bundles; stored payloads are held against
    their digests. A revisit's size stands in its HTTP header."""
    return read_bundles(spark, path).select("data").mapInArrow(_read, RECORDS)


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row a record: page_id, record_id, refers_to, bundle, frame, offset, length.
    The bundles' data is not read."""
    arrays = ["page_ids", "record_ids", "refers_to", "frames", "offsets", "lengths"]
    names = ["page_id", "record_id", "refers_to", "frame", "offset", "length"]
    each = read_bundles(spark, path).select("bundle", F.explode(F.arrays_zip(*arrays)).alias("r"))
    return each.select("bundle", *(F.col(f"r.{a}").alias(n) for a, n in zip(arrays, names)))


def _fetch(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        for row in range(b.num_rows):
            data, wanted = b.column(0)[row].as_py(), b.column(1)[row].as_py()
            sizes, ids, payloads, frame, plain = frame_sizes(data), [], [], None, b""
            for want in sorted(wanted, key=lambda w: (w["frame"], w["offset"])):
                if want["frame"] != frame:
                    frame = want["frame"]
                    plain = frame_at(data, frame, sizes)
                fields, block, _ = parse(plain, want["offset"])
                ids.append(fields["WARC-Record-ID"])
                payloads.append(payload_of(block)[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(payloads, pa.binary())],
                                             names=["record_id", "payload"])


def fetch_payloads(spark: SparkSession, path: str, page_ids: DataFrame) -> DataFrame:
    """(page_id, record_id, payload) of the pages asked for (column ``page_id``,
    repeats count once); a revisit gives the payload it refers to. Only frames
    that hold a record asked for are decompressed."""
    every = index(spark, path)
    asked = (every.join(page_ids.select(F.col("page_id").cast("long").alias("asked")).distinct(),
                        F.col("page_id").eqNullSafe(F.col("asked")))
             .select("page_id", F.col("record_id").alias("own"), F.coalesce("refers_to", "record_id").alias("record_id")))
    places = (every.join(asked.select("record_id").distinct(), "record_id")
              .groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("wanted")))  # as long as a bundle
    found = (read_bundles(spark, path).select("bundle", "data").join(places, "bundle").select("data", "wanted")
             .mapInArrow(_fetch, "record_id string, payload binary"))
    return asked.join(found, "record_id").select("page_id", F.col("own").alias("record_id"), "payload")


def _export(folder: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                data = data.as_py()
                at = f"{folder}/{name}.warc.zst"
                with open(f"{at}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                    f.write(data)
                os.replace(f.name, at)  # whole or not at all, whichever attempt is last
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([len(data)], pa.int64())], names=["file", "bytes"])

    return run


def export_bundles(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write each bundle as ``folder/<bundle>.warc.zst`` when the result is read.
    ``folder`` must be a folder that all executors share, by the same path."""
    return read_bundles(spark, path).select("bundle", "data").mapInArrow(_export(folder), "file string, bytes long")
