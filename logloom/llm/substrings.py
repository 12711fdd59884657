"""Removal of repeated passages: super-k-mer partitioning of windows of K words.

A window's minimiser is the smallest hash of its M consecutive words. Consecutive windows of one
document that share it travel as one packed string, a super-k-mer, to the bucket of that
minimiser; equal windows have equal minimisers, so they meet there. In the bucket the windows are
sorted by hash and equal neighbours compared byte by byte, which tells for each window the
smallest doc_id that has it. A word goes when a window that covers it also starts in a document
with a smaller doc_id.

Equal super-k-mers are combined before the shuffle, in pieces of PIECE bytes: of their documents
the smallest alone travels, the others' windows are settled on the spot. A bucket that still
exceeds BUCKET_LIMIT bytes is dealt out again, under another order of minimisers, and at last by
the windows' own hashes, so that nothing but copies of one window must share a bucket.
Many buckets share a partition and are settled one after another; workers give memory back after each.

Defined results: a null or empty text has no words and keeps the SHA-256 of nothing; rows with a
null doc_id count as larger than any other and never as smaller than each other; rows that repeat
a doc_id are no smaller than each other, so each keeps its words; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import tokens
from logloom.llm.common import bounded_batches, materialize, table

K, M = 50, 3
PIECE = 10 << 20
#: Bytes of packed strings that a bucket is planned to hold, and may hold.
BUCKET_BYTES, BUCKET_LIMIT = 4 << 20, 20 << 20
#: Bytes of packed strings, before compression, of a partition, and its most partitions: sorting spills beyond.
PARTITION_BYTES, MOST_PARTITIONS = 32 << 20, 100_000
#: Bytes of super-k-mers for each byte of input files, for planning.
EXPANSION = 4
LEVELS = 4
UNKNOWN = 1 << 56
NO_ID = np.iinfo(np.int64).max
KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])
SETTLED = "bucket int, packed binary, doc long, row_hash long, first int, last int"


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, by doubling."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[:n], v[w - span : w - span + n])


def normalised(data: np.ndarray, w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with a space behind each, and where each word begins."""
    length = w.end - w.start
    begin = np.cumsum(length + 1) - (length + 1)
    out = np.full(int(begin[-1] + length[-1] + 1) if len(begin) else 0, 32, np.uint8)
    total = int(length.sum())
    shift_in = np.repeat(w.start - (np.cumsum(length) - length), length)
    shift_out = np.repeat(begin - (np.cumsum(length) - length), length)
    at = np.arange(total)
    out[at + shift_out] = data[at + shift_in]
    return out, begin


def super_kmers(h: np.ndarray, w: tokens.Words, k: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window and number of windows of each super-k-mer, and its minimiser."""
    at = tokens.within_rows(w, k)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    if level == LEVELS - 1:  # each window by itself
        return at, np.ones(len(at), np.int64), tokens.window_hashes(h, k)[at]
    m = min(M, k)
    grams = tokens.mix(tokens.window_hashes(h, m) ^ np.uint64(level * 0x51ED270B))
    least = sliding_min(grams, k - m + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    new[1:] |= w.row[at[1:]] != w.row[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), least[first]


class Packer:
    """Combines equal super-k-mers and packs them by bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.size = buckets, 0
        self.entries: dict[bytes, list] = {}
        self.settled: list[tuple[int, int, int, int]] = []

    def add(self, text: bytes, bucket: int, doc: int, row: int, pos: int, n: int) -> None:
        """One super-k-mer of n words, from word pos of a row of document doc."""
        old = self.entries.get(text)
        if old is None:
            self.entries[text] = [bucket, doc, n, [(row, pos)]]
            self.size += len(text)
        elif doc == old[1]:
            old[3].append((row, pos))
        elif doc > old[1]:
            self.settled.append((doc, row, pos, pos + n))
        else:
            self.settled += [(old[1], r, p, p + n) for r, p in old[3]]
            old[1], old[3] = doc, [(row, pos)]

    def flush(self) -> pa.RecordBatch:
        by_bucket: dict[int, list] = {}
        for text, (bucket, doc, n, places) in self.entries.items():
            by_bucket.setdefault(bucket, []).append((text, doc, n, places))
        zip_ = zstandard.ZstdCompressor(level=3)
        out = {"bucket": [], "packed": []}
        for bucket, items in by_bucket.items():
            head = np.array([(doc, n, len(places), len(text)) for text, doc, n, places in items], np.int64)
            places = np.array([p for x in items for p in x[3]], np.int64)
            raw = b"".join([np.array([len(items), len(places)], np.int64).tobytes(), head.tobytes(), places.tobytes(), *[x[0] for x in items]])
            out["bucket"].append(bucket)
            out["packed"].append(zip_.compress(raw))
        settled = self.settled
        self.entries, self.settled, self.size = {}, [], 0
        n = len(out["bucket"])
        cols = [pa.array(out["bucket"] + [None] * len(settled), pa.int32()), pa.array(out["packed"] + [None] * len(settled), pa.binary())]
        for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32())):
            cols.append(pa.array([None] * n + [s[i] for s in settled], kind))
        return pa.RecordBatch.from_arrays(cols, names=["bucket", "packed", "doc", "row_hash", "first", "last"])


def _pack(packer: Packer, data: np.ndarray, w: tokens.Words, doc: np.ndarray, row: np.ndarray, pos: np.ndarray, k: int, level: int) -> None:
    """Adds the super-k-mers of texts to packer; doc, row and pos (of the first word) are given for each text."""
    h = tokens.word_hashes(data, w.start, w.end)
    first, n, least = super_kmers(h, w, k, level)
    if not len(first):
        return
    text, begin = normalised(data, w)
    buf = text.tobytes()
    last = first + n + k - 2
    text_row = w.row[first]
    lo = begin[first].tolist()
    hi = (begin[last] + (w.end - w.start)[last]).tolist()
    bucket = (tokens.mix(least) % np.uint64(packer.buckets)).astype(np.int64).tolist()
    at = (pos[text_row] + first - w.first[text_row]).tolist()
    for args in zip(lo, hi, bucket, doc[text_row].tolist(), row[text_row].tolist(), at, (n + k - 1).tolist(), strict=True):
        packer.add(buf[args[0] : args[1]], *args[2:])


def _pack_documents(buckets: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, size = Packer(buckets), 0
        for batch in batches:
            doc = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            row = batch.column(1).to_numpy(zero_copy_only=False)
            for b in tokens.blocks(batch.column(2)):
                _pack(packer, b.data, tokens.words(b), doc[b.lo : b.hi], row[b.lo : b.hi], np.zeros(b.n, np.int64), k, 0)
                size += len(b.data)
                if size >= PIECE:
                    yield packer.flush()
                    tokens.release()
                    size = 0
        yield packer.flush()
        packer = batch = b = None
        tokens.release()

    return run


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    head = np.frombuffer(raw, np.int64, 4 * n, 16).reshape(n, 4)
    places = np.frombuffer(raw, np.int64, 2 * m, 16 + 32 * n).reshape(m, 2)
    return head, places, raw[16 + 32 * n + 16 * m :]


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether length bytes from a and from b are the same."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    out = np.ones(len(a), bool)
    some = np.arange(len(a))
    done = 0
    while len(some):
        x = eight[a[some] + done] ^ eight[b[some] + done]
        rest = length[some] - done
        short = rest < 8
        x[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[some[x != 0]] = False
        some = some[(x == 0) & (rest > 8)]
        done += 8
    return out


def smallest_holders(data: np.ndarray, w: tokens.Words, h: np.ndarray, at: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """For the window at each of ``at``, the smallest doc among windows of the same words."""
    keys = tokens.window_hashes(h, k)[at]
    order = np.argsort(keys)
    keys = keys[order]
    own = doc[order]
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    start = w.start[at[order]]
    length = w.end[at[order] + k - 1] - start
    later = np.flatnonzero(~new)
    same = (length[later] == length[later - 1]) & True
    check = later[same]
    ok = np.zeros(len(later), bool)
    ok[same] = _equal_bytes(data, start[check], start[check - 1], length[check])
    group = np.cumsum(new) - 1
    if not ok.all():  # equal hashes of unequal words: such groups are told apart by their bytes
        mixed = np.isin(group, group[later[~ok]])
        names: dict[bytes, int] = {}
        base = int(group[-1]) + 1
        for i in np.flatnonzero(mixed):
            group[i] = base + names.setdefault(data[start[i] : start[i] + length[i]].tobytes(), len(names))
        again = np.argsort(group, kind="stable")
        order, own, group = order[again], own[again], group[again]
        new = np.ones(len(order), bool)
        new[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(own, first) if len(first) else own
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def _settle_bucket(items: list[tuple[np.ndarray, np.ndarray, bytes]], k: int) -> list[np.ndarray]:
    """doc, row_hash, first and last word of each run of words that goes."""
    head = np.concatenate([x[0] for x in items])
    places = np.concatenate([x[1] for x in items])
    data = np.frombuffer(b"".join(x[2] for x in items), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(head[:, 3])])
    block = tokens.Block(0, len(head), data, offsets)
    w = tokens.words(block)
    h = tokens.word_hashes(data, w.start, w.end)
    at = tokens.within_rows(w, k)
    doc = head[w.row[at], 0]
    gone = at[smallest_holders(data, w, h, at, doc, k) < doc]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + k, -1)
    covered = np.cumsum(cover)[:-1] > 0
    edge = np.zeros(len(h), bool)
    edge[w.first[:-1][np.diff(w.first) > 0]] = True
    before = np.append(False, covered[:-1]) & ~edge
    after = np.append(covered[1:] & ~edge[1:], False)
    begin = np.flatnonzero(covered & ~before)
    end = np.flatnonzero(covered & ~after) + 1
    text = w.row[begin]
    begin, end = begin - w.first[text], end - w.first[text]
    n = head[:, 2]
    base = np.cumsum(n) - n
    which = np.repeat(np.arange(len(text)), n[text])
    place = places[np.repeat(base[text] - (np.cumsum(n[text]) - n[text]), n[text]) + np.arange(len(which))]
    return [head[text[which], 0], place[:, 0], place[:, 1] + begin[which], place[:, 1] + end[which]]


def _settle(buckets: int, k: int, level: int):
    """Settles the buckets of a partition, one after another; too large ones are packed anew."""

    def of(items: list, packer: Packer | None) -> Iterator[pa.RecordBatch]:
        if packer is not None:
            yield packer.flush()
        elif items:
            doc, row, first, last = _settle_bucket(items, k)
            none = pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.binary())
            cols = [*none, pa.array(doc), pa.array(row), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "packed", "doc", "row_hash", "first", "last"])

    def repack(packer: Packer, item) -> None:
        head, places, text = item
        data = np.frombuffer(text, np.uint8)
        w = tokens.words(tokens.Block(0, len(head), data, np.concatenate([[0], np.cumsum(head[:, 3])])))
        n = head[:, 2]
        base = np.cumsum(n) - n
        _pack(packer, data, w, head[:, 0], places[base, 0], places[base, 1], k, level + 1)
        for i in np.flatnonzero(n > 1):  # the other places of a document's own repeats
            one = tokens.words(tokens.Block(0, 1, own := data[(lo := int(head[:i, 3].sum())) : lo + int(head[i, 3])], np.array([0, len(own)])))
            for r, p in places[base[i] + 1 : base[i] + n[i]]:
                _pack(packer, own, one, head[i : i + 1, 0], np.array([r]), np.array([p]), k, level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items, size, done, packer = None, [], 0, 0, None
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    yield from of(items, packer)
                    now, items, done, size, packer = bucket, [], done + size, 0, None
                    if done >= PIECE:
                        done = 0
                        tokens.release()
                item = _unpack(packed.as_py())
                size += len(item[2])
                if packer is None and size > BUCKET_LIMIT and level + 1 < LEVELS:
                    packer = Packer(buckets)
                    for x in items:
                        repack(packer, x)
                    items = []
                if packer is None:
                    items.append(item)
                else:
                    repack(packer, item)
                    if packer.size >= 2 * PIECE:
                        yield packer.flush()
        yield from of(items, packer)
        items = []
        tokens.release()

    return run


def planned(docs: DataFrame) -> tuple[int, int]:
    """Buckets and partitions, from the size that the optimizer knows of the input, and the session's shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > UNKNOWN:  # what the optimizer says of rows that come from no files
        size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, min(math.ceil(EXPANSION * size / PARTITION_BYTES), MOST_PARTITIONS))
    return max(partitions, math.ceil(EXPANSION * size / BUCKET_BYTES)), partitions


def _runs(keyed: DataFrame, k: int, buckets: int, partitions: int) -> DataFrame:
    """doc, row_hash, first and last of runs of words that go; runs of a row may overlap."""
    packed = keyed.mapInArrow(_pack_documents(buckets, k), SETTLED)
    out = None
    for level in range(LEVELS):
        # settled runs ride along, so that documents are packed once
        dealt = packed.repartitionById(partitions, F.pmod(F.coalesce(F.col("bucket"), F.hash("row_hash")), F.lit(partitions)))
        done = materialize(dealt.sortWithinPartitions("bucket").mapInArrow(_split(_settle(buckets, k, level)), SETTLED))
        runs = done.filter(F.col("bucket").isNull()).select("doc", "row_hash", "first", "last")
        out = runs if out is None else out.unionByName(runs)
        packed = done.filter(F.col("bucket").isNotNull())
        if level + 1 == LEVELS or packed.isEmpty():
            return out
    return out


def _split(settle):
    """Lets rows that are settled already pass, and gives the others to settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                is_run = b.column(0).is_null()
                if is_run.true_count:
                    passed.append(b.filter(is_run))
                if is_run.true_count < len(b):
                    yield b.filter(pc.invert(is_run))

        for out in settle(packed()):
            yield from passed
            passed.clear()
            yield out
        yield from passed

    return run


@F.pandas_udf(KEPT)
def _kept(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = []
    for text, spans in zip(texts, runs, strict=True):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        n = len(words)
        if spans is not None and len(spans):
            gone = np.zeros(n + 1, np.int64)
            for s in spans:
                gone[s["first"]] += 1
                gone[s["last"]] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:n]) == 0).tolist()]
        left = b" ".join(words)
        out.append((n, n - len(words), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass")))
    texts = runs = words = None
    tokens.release()
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, k: int = K, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, one space apart) of each row."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    runs = _runs(keyed, k, *((buckets, buckets) if buckets else planned(docs.select("text"))))
    # a document repeats neither a place nor a run, so a list is no longer than its words
    spans = runs.distinct().groupBy("doc", "row_hash").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rows = keyed.withColumn("doc", F.coalesce("doc_id", F.lit(int(NO_ID)))).join(spans, ["doc", "row_hash"], "left")
    return rows.withColumn("k_", _kept("text", "runs")).select("doc_id", "k_.n_words", "k_.n_removed", "k_.kept_sha256", "k_.kept")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def oracle_sql(k: int = K) -> str:
    return rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p + 1, p + {k}), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - {k} + 1)) AS p FROM d)),
low AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT doc_id, list(DISTINCT p ORDER BY p) AS ps FROM win JOIN low USING (h) WHERE m < doc_id GROUP BY doc_id),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + {k})) AS i FROM (SELECT doc_id, unnest(ps) AS p FROM gone)),
n AS (SELECT doc_id, list(i) AS cs, count(*) AS n_removed FROM cov GROUP BY doc_id),
words AS (SELECT d.doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.i) AS t FROM words LEFT JOIN cov ON cov.doc_id = words.doc_id AND cov.i = words.i WHERE cov.i IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""
