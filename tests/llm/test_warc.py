from __future__ import annotations

import hashlib
import random
import tempfile

import pytest
import zstandard

from shoplens.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    """Copies of a third of all rows, short payloads, nulls, repeated rows, odd urls, a long page."""
    rnd = random.Random(5)
    hot, twin = "<p>" + "hot " * 60, "<p>" + "twin é " * 30
    rows = [(k, f"http://x/{k}", hot) for k in range(200, 80, -1)]
    rows += [(k, f"http://y/{k}", twin) for k in (7, 5, 9)]
    rows += [(300 + k, f"u{k}", "short") for k in range(20)]
    rows += [(400 + k, f"u{k}", "".join(rnd.choice("ab é<>\n\r") for _ in range(rnd.randint(0, 900)))) for k in range(60)]
    rows += [(500, None, None), (501, "", ""), (502, "a b\r\nWARC-Type: x\x00", "x" * 200), (503, "u", "long " * 100_000)]
    rows += [(None, "n1", "of no id " * 20), (None, "n2", "of no id " * 20), (600, "n3", "of no id " * 20), (None, "only", "without an id " * 20)]
    rows += [(700, "same", "alike " * 40)] * 3 + [(700, "other", "another text of the id " * 9)]
    return rows, spark.createDataFrame([(*r, "x", 1, True) for r in rows],
                                       "page_id long, url string, html string, digest string, n int, heavy boolean").repartition(4)


def brute(rows, least=100):
    first, out = {}, []
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        again = len(payload) >= least and digest in first
        out.append((page_id, len(payload), digest, "revisit" if again else "response", first[digest] if again else None))
        first.setdefault(digest, page_id)
    return out


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("heavy,frame,bundle,partitions", [(1000, 1 << 18, 1 << 24, 3), (1, 1, 1, 7), (0, 2000, 5000, 1)])
def test_records(spark, pages, heavy, frame, bundle, partitions, monkeypatch):
    monkeypatch.setattr(warc, "HEAVY", heavy)
    rows, df = pages
    path = tempfile.mkdtemp() + "/b"
    warc.write_bundles(df, path, frame_bytes=frame, bundle_bytes=bundle, partitions=partitions)
    read = warc.read_records(spark, path).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert len({r["record_id"] for r in read}) == len(rows)
    urls = {(r["page_id"], r["url"]) for r in read}
    assert (500, None) in urls and (501, "") in urls and (502, "a%20b%0D%0AWARC-Type:%20x%00") in urls
    # every payload by random access; a revisit gives the payload that it refers to
    asked = df.select("page_id").filter("page_id IS NULL OR page_id % 2 = 0")
    found = warc.fetch_payloads(spark, path, asked).collect()
    want = [(r[0], (r[2] or "").encode()) for r in rows if r[0] is None or r[0] % 2 == 0]
    assert sorted(((r["page_id"], bytes(r["payload"])) for r in found), key=key) == sorted(want, key=key)


def test_bundle_is_a_file_for_any_reader(spark, pages):
    rows, df = pages
    path, folder = tempfile.mkdtemp() + "/b", tempfile.mkdtemp()
    warc.write_bundles(df, path, frame_bytes=4000, bundle_bytes=5000, partitions=2)
    files = warc.export_bundles(spark, path, folder).collect()
    assert len(files) == warc.read_bundles(spark, path).count() > 2
    places = {(r["bundle"], r["frame"], r["offset"]): r for r in warc.index(spark, path).collect()}
    assert len(places) == len(rows)
    seen = 0
    for f in files:
        with open(f["file"], "rb") as file:
            data = file.read()
        assert len(data) == f["bytes"]
        plain, at = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(), 0
        sizes = warc.frame_sizes(data)
        assert sum(p for _, p in sizes) == len(plain) and len(sizes) > 1
        kinds = []
        while at < len(plain):
            fields, _, at = warc.parse(plain, at)
            kinds.append(fields["WARC-Type"])
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1
        for frame, offset, fields, block in list(warc.records(data))[1:]:
            own = places[f["file"].split("/")[-1].removesuffix(".warc.zst"), frame, offset]
            one, same, end = warc.parse(warc.frame_at(data, frame), offset)
            assert own["record_id"] == fields["WARC-Record-ID"] == one["WARC-Record-ID"] and same == block
            assert end - offset == own["length"] and own["refers_to"] == fields.get("WARC-Refers-To")
            seen += 1
    assert seen == len(rows)


def test_damage_is_found(spark, pages):
    _, df = pages
    path = tempfile.mkdtemp() + "/b"
    warc.write_bundles(df.filter("page_id = 502"), path)
    data = warc.read_bundles(spark, path).first()["data"]
    with pytest.raises(ValueError):
        warc.frame_sizes(bytes(data[:-1]))
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")
    plain = warc.frame_at(bytes(data), 0)
    broken = plain.replace(b"xxxxx", b"yyyyy", 1)
    packed = zstandard.ZstdCompressor().compress(broken)
    bundle = packed + warc.seek_table([(len(packed), len(broken))])
    import pyarrow as pa

    with pytest.raises(ValueError, match="not the one that was written"):
        list(warc._read(iter([pa.RecordBatch.from_arrays([pa.array([bundle], pa.binary())], names=["data"])])))


def test_empty(spark, pages):
    path = tempfile.mkdtemp() + "/b"
    warc.write_bundles(pages[1].limit(0), path)
    assert warc.read_records(spark, path).count() == 0 and warc.index(spark, path).count() == 0
