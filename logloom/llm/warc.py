"""WARC archives whose records are single Zstandard frames under an embedded dictionary.

An archive opens with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from
records of that archive; every record follows as a frame of its own, compressed with it, so a
record can be read alone once the dictionary is. Records with equal payloads of ``min_payload``
bytes or more are stored once: the one with the largest page_id is a response, the others are
revisits that name it and carry no payload.

Archives lie in a folder that driver and executors share. Their names hold the task attempt, so
a lost task's files are never read: only archives that the manifest names count.

Defined results: a null html is an empty payload; a null url is written as ``urn:none`` and read
as null; a null page_id is read as null, never is what others refer to unless all of its group
are null, in which case each is a response; repeated rows of the largest page_id are all
responses; a very long page is one record, in memory once; an empty table gives no archives. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import bounded_batches, materialize, shared_dir, table

SKIPPABLE_MAGIC = 0x184D2A5D
DICT_BYTES = 64 << 10
#: Records that a dictionary is built from: the first of its archive, up to so many and so many bytes.
DICT_RECORDS, DICT_SAMPLE_BYTES = 2_000, 8 << 20
ARCHIVE_BYTES = 32 << 20
LEVEL = 6
BROADCAST_DIGESTS = 100_000
#: Tasks that archives are read by at most, and the archives that each then reads one after another.
MOST_READERS = 100_000
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
MANIFEST = "path string, task int, number int, n_records long, raw_bytes long, stored_bytes long"
RECORDS = "archive string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(record: str | None) -> int | None:
    name = (record or "").rstrip(">").rpartition(":")[2]
    return int(name) if name and name != "none" else None


def _header_value(text: str) -> str:
    return "".join(c if c not in "\r\n%" else f"%{ord(c):02X}" for c in text)


def _from_header(text: str) -> str:
    for c in "\r\n":
        text = text.replace(f"%{ord(c):02X}", c)
    return text.replace("%25", "%")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its HTTP message, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "urn:none" if url is None else _header_value(url)),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + _END


def build_dictionary(records: list[bytes], size: int = DICT_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary, or where the sample is too small for training its bytes as they are."""
    sample, total = [], 0
    for r in records[:DICT_RECORDS]:
        if total >= DICT_SAMPLE_BYTES:
            break
        sample.append(r[: DICT_SAMPLE_BYTES - total])
        total += len(sample[-1])
    if not total:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 4)), sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def encode_archive(records: list[bytes]) -> bytes:
    """The bytes of an archive."""
    words = build_dictionary(records)
    raw = words.as_bytes() if words else b""
    out = BytesIO()
    out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue()


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def decode_archive(source) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the inflated stream, WARC fields, block) of each record of an open archive."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    stream = zstandard.ZstdDecompressor(dict_data=_dictionary(source.read(size))).stream_reader(source, read_across_frames=True, read_size=1 << 20)
    buffer, at, done = b"", 0, 0

    def need(n: int) -> bool:
        nonlocal buffer, at
        while len(buffer) - at < n:
            more = stream.read(max(1 << 20, n - (len(buffer) - at)))
            if not more:
                return False
            buffer, at = buffer[at:] + more, 0
        return True

    while need(1):
        while (end := buffer.find(_END, at)) < 0:
            if not need(len(buffer) - at + 1):
                raise ValueError("a record ends inside its header")
        lines = buffer[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        begin, head = done, end + 4 - at
        at = end + 4
        if not need(size + 4):
            raise ValueError("a record ends inside its block")
        block = buffer[at : at + size]
        if buffer[at + size : at + size + 4] != _END:
            raise ValueError("a record is longer than it says")
        at += size + 4
        done += head + size + 4
        yield begin, fields, block


def _storage(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_partition(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        held, size, n = [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal held, size, n
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n}.warc.zst"
            data = encode_archive(held)
            store, path = _storage(folder)
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}") as f:
                f.write(data)
            out = pd.DataFrame({"path": [f"{folder}/{name}"], "task": [task.partitionId()], "number": [n], "n_records": [len(held)], "raw_bytes": [size], "stored_bytes": [len(data)]})
            held, size, n = [], 0, n + 1
            return out

        for pdf in batches:
            for page_id, url, html, sha1, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["sha1"], pdf["refers_to"], strict=True):
                own, other = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                payload = (html or "").encode()
                held.append(build_record(own, url, payload, sha1, other))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return write


def write_archives(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Archives the pages (page_id, url, html); returns the manifest of the archives written."""
    bounded_batches(pages.sparkSession)
    folder = folder or shared_dir(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("hex"), F.octet_length(html).alias("size"))
    # digests that repeat; up to BROADCAST_DIGESTS of them no page is shuffled, beyond that a hot digest's side can be split
    firsts = materialize(keyed.filter(F.col("size") >= min_payload).groupBy("hex").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hex", "first"))
    few = firsts.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    rows = keyed.join(F.broadcast(firsts) if few else firsts, "hex", "left").select(
        "page_id", "url", "html", _base32(F.col("hex")).alias("sha1"),
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )
    return materialize(rows.mapInPandas(_write_partition(folder), MANIFEST))


def _base32(digest_hex):
    """RFC 4648 base32 of 40 hex digits: each 5 digits are 4 letters of 5 bits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(8):
        v = F.conv(F.substring(digest_hex, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(letters), (F.shiftright(v, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _read_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for uri in pdf["path"]:
            store, path = _storage(uri)
            with store.open_input_stream(path) as f:
                rows, size = [], 0
                for offset, fields, block in decode_archive(f):
                    head, _, payload = block.partition(_END)
                    length = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (len(payload) != length or digest(payload) != sha1):
                        raise ValueError(f"{uri}: the payload of {fields['WARC-Record-ID']} is not what was written")
                    url = fields["WARC-Target-URI"]
                    rows.append((uri, offset, _page_of(fields["WARC-Record-ID"]), None if url == "urn:none" else _from_header(url), length, sha1, kind, _page_of(fields.get("WARC-Refers-To")), payload if kind == "response" else None))
                    size += len(payload)
                    if size >= 4 << 20 or len(rows) >= 2_000:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")])
    for c in ("page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives that the manifest names, their payloads verified against the digests; one task an archive."""
    tasks, numbers = manifest.agg(F.max("task") + 1, F.max("number") + 1).first()
    n = min((tasks or 1) * (numbers or 1), MOST_READERS)
    place = F.pmod(F.col("task") + F.col("number").cast("bigint") * (tasks or 1), F.lit(n)).cast("int")
    return manifest.select("path", place.alias("place")).repartitionById(n, "place").mapInPandas(_read_partition, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), min_payload=0)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle_sql() -> str:
    five = "('0x' || substr(h, 5 * i::INTEGER + 1, 5))::BIGINT"
    letter = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({five} >> {s}) & 31)::INTEGER + 1, 1)" for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: {letter}), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""
