import base64
import hashlib
import io
import struct

import zstandard

from logloom.llm import warc as w

PAGES = "page_id long, url string, html string, payload_digest int"


def pages(spark):
    rows = [(i, f"http://a/{i}\r\n%", f"<p>{'word ' * (i % 17)}</p>", 1) for i in range(300)]
    rows += [(900, None, None, 1), (901, "u", "", 1), (None, "n", "only null", 1), (None, "n", "<p></p>", 1), (950, "u", "é😀" * 50_000, 1), (960, "t", "tie", 1), (960, "t", "tie", 1)]
    return rows, spark.createDataFrame(rows, PAGES)


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows, df = pages(spark)
    out = w.read_archives(w.write_archives(df)).collect()
    assert len(out) == len(rows)
    largest = {}
    for i, _, t, _ in rows:
        if i is not None:
            largest[t or ""] = max(largest.get(t or "", -1), i)
    want = []
    for i, url, t, _ in rows:
        first = largest.get(t or "")
        refers = None if first is None or i == first else first
        want.append((i, url, len((t or "").encode()), sha1(t), "response" if refers is None else "revisit", refers))
    got = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = {r["payload_digest"]: r["payload"] for r in out if r["record_type"] == "response"}
    assert all(bytes(kept[sha1(t)]).decode() == (t or "") for _, _, t, _ in rows)


def test_smaller_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    out = {r["page_id"]: r["refers_to"] for r in w.read_archives(w.write_archives(df, min_payload=3)).collect()}
    assert out == {1: None, 2: None, 3: 4, 4: None}


def test_empty_table(spark):
    _, df = pages(spark)
    assert w.read_archives(w.write_archives(df.limit(0))).count() == 0


def test_archive_layout():
    records = [w.build_record(i, "u", b"payload %d " % i * 40, w.digest(b"payload %d " % i * 40), None) for i in range(200)]
    data = w.encode_archive(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    at, frames = 8 + size, []
    while at < len(data):  # each record is a frame of its own
        d = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        frames.append(d.decompress(data[at:]))
        at = len(data) - len(d.unused_data)
    assert frames == records
    assert [f["WARC-Record-ID"] for _, f, _ in w.decode_archive(io.BytesIO(data))] == [w.record_id(i) for i in range(200)]
    plain = sum(len(zstandard.ZstdCompressor(level=w.LEVEL).compress(r)) for r in records)
    assert len(data) - size < plain


def test_tiny_archives_have_untrained_dictionaries():
    for n in (1, 2):
        records = [w.build_record(i, None, b"", w.digest(b""), None) for i in range(n)]
        assert len(list(w.decode_archive(io.BytesIO(w.encode_archive(records))))) == n
