"""Readers and writers of the store's private binary layouts: log files and run files, little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.bloom import FNV_PRIME, BloomConfig, seed_state

RECORDS = "path string, pos long, op byte, ts long, key binary, value binary"
HEADERS = "path string, id long, level int, created_at long, min_key binary, max_key binary, n_records long, n_index long, n_bits long"
#: Fixed values of the run layout.
DATA_START = 22
INDEX_STEP = 20
_HEAD = struct.Struct("<BqI")
_LENGTH = struct.Struct("<I")


def encode_record(op: int, ts: int, key: bytes, value: bytes = b"") -> bytes:
    return _HEAD.pack(op, ts, len(key)) + key + _LENGTH.pack(len(value)) + value


def decode_records(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(offset, op, ts, key, value); a record that the end cuts off ends the scan."""
    end = len(data) if end is None else end
    while at + _HEAD.size <= end:
        op, ts, n = _HEAD.unpack_from(data, at)
        value_at = at + _HEAD.size + n
        if value_at + 4 > end:
            return
        (m,) = _LENGTH.unpack_from(data, value_at)
        stop = value_at + 4 + m
        if stop > end:
            return
        yield at, op, ts, data[at + _HEAD.size : value_at], data[value_at + 4 : stop]
        at = stop


def bloom_mask(keys: list[bytes], config: BloomConfig) -> bytes:
    mask = bytearray((config.m + 7) // 8)
    for key in keys:
        for i in range(config.k):
            h = seed_state(i)
            for b in key:
                h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
            mask[h % config.m // 8] |= 1 << h % config.m % 8
    return bytes(mask)


def encode_run(run_id: int, level: int, created_at: int, records: list[tuple[int, int, bytes, bytes]], config: BloomConfig) -> bytes:
    """A run file of (op, ts, key, value) records."""
    data, index, last = b"", b"", DATA_START
    records = sorted(records, key=lambda r: r[2])
    for i, (op, ts, key, value) in enumerate(records):
        last = DATA_START + len(data)
        if i % INDEX_STEP == 0:
            index += _LENGTH.pack(len(key)) + key + struct.pack("<Q", last)
        data += encode_record(op, ts, key, value)
    head = struct.pack("<QHqI", run_id, level, created_at, len(data))
    return head + data + struct.pack("<QI", last, len(index)) + index + bloom_mask([r[2] for r in records], config)


def decode_run(data: bytes) -> dict:
    """id, level, created_at, min_key, max_key, records, index and mask of a run file."""
    run_id, level, created_at, size = struct.unpack_from("<QHqI", data)
    end = DATA_START + size
    last, index_size = struct.unpack_from("<QI", data, end)
    index, at = [], end + 12
    bloom_at = at + index_size
    while at < bloom_at:
        (n,) = _LENGTH.unpack_from(data, at)
        index.append((data[at + 4 : at + 4 + n], struct.unpack_from("<Q", data, at + 4 + n)[0]))
        at += 12 + n
    records = list(decode_records(data, DATA_START, end))
    max_key = next(decode_records(data, last, end))[3] if records else None
    return {"id": run_id, "level": level, "created_at": created_at, "min_key": records[0][3] if records else None, "max_key": max_key, "records": records, "index": index, "mask": data[bloom_at:]}


def _rows(batches: Iterator[pd.DataFrame], runs: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, data in zip(pdf["path"], pdf["content"], strict=True):
            found = decode_run(data)["records"] if runs else list(decode_records(data))
            yield pd.DataFrame([(path, i, op, ts, key, value) for i, (_, op, ts, key, value) in enumerate(found)], columns=["path", "pos", "op", "ts", "key", "value"])


def _encoded(pdf: pd.DataFrame, runs: bool, level: int, config: BloomConfig | None) -> pd.DataFrame:
    texts = [[(x or "").encode() for x in pdf[c]] for c in ("k", "v")]
    records = sorted(zip(pdf["seq"], pdf["op"], pdf["ts"], *texts, strict=True))
    seg = int(pdf["seg"].iloc[0])
    if runs:
        return pd.DataFrame({"path": [f"sst_{seg}"], "content": [encode_run(seg, level, int(records[-1][0]), [r[1:] for r in records], config)]})
    return pd.DataFrame({"path": [f"wal_{seg}.log"], "content": [b"".join(encode_record(*r[1:]) for r in records)]})


def log_files(segments: DataFrame) -> DataFrame:
    """path and content of the log file of each segment (seg, k, v, ts, seq, op), in log order; a segment has the store's flush size."""
    return segments.select("seg", "k", "v", "ts", "seq", "op").groupBy("seg").applyInPandas(lambda pdf: _encoded(pdf, False, 0, None), "path string, content binary")


def run_files(runs: DataFrame, config: BloomConfig, level: int = 0) -> DataFrame:
    """path and content of the run file of each run (seg, k, v, ts, seq, op); a run has the store's flush size."""
    return runs.select("seg", "k", "v", "ts", "seq", "op").groupBy("seg").applyInPandas(lambda pdf: _encoded(pdf, True, level, config), "path string, content binary")


def records_of(files: DataFrame, runs: bool = False) -> DataFrame:
    """The records of log or run files (path, content), in file order."""
    return files.select("path", "content").mapInPandas(lambda b: _rows(b, runs), RECORDS)


def run_headers(files: DataFrame) -> DataFrame:
    """Of each run file (path, content): id, level, created_at, key range, records, indexed keys and set bits of the mask."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [decode_run(data) for data in pdf["content"]]
            yield pd.DataFrame([(path, r["id"], r["level"], r["created_at"], r["min_key"], r["max_key"], len(r["records"]), len(r["index"]), int.from_bytes(r["mask"], "little").bit_count()) for path, r in zip(pdf["path"], found, strict=True)], columns=[c.split()[0] for c in HEADERS.split(", ")])

    return files.select("path", "content").mapInPandas(heads, HEADERS)


def newest_file(spark: SparkSession, path: str, pattern: str = "wal_*.log") -> DataFrame:
    """path of the file that was changed last, of equal ones the last by name; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return listed.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def read_logs(spark: SparkSession, path: str, pattern: str = "wal_*.log") -> DataFrame:
    """Records of log files, in file order; files are bounded by the store's flush size."""
    return records_of(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def read_runs(spark: SparkSession, path: str, pattern: str = "sst_*") -> DataFrame:
    return records_of(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path), runs=True)
