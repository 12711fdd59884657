import hashlib
import random
import re

import pyarrow as pa

from logloom.llm import substrings as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    order = [s.NO_ID if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(order, words, strict=True):
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for (doc, _), d, w in zip(rows, order, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(map(repr, out))


def run(spark, rows, k, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row_hash string, doc int")
    out = s.remove_repeats(df, k, **more).select("doc_id", "n_words", "n_removed", "kept_sha256")
    return sorted(repr(tuple(r)) for r in out.collect())


def texts(seed, n=60):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefg") * rng.randint(1, 12) for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i, i, 3]), rng.choice([" ", "\n", "\t "]).join(parts)))
    return rows


def test_equals_brute_force(spark):
    for seed, k in ((1, 8), (2, 5), (3, 50)):
        rows = texts(seed)
        assert run(spark, rows, k, buckets=5) == brute(rows, k)


def test_edges(spark):
    long = " ".join(f"v{i % 700}" for i in range(20_000))
    rows = [(None, None), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "x a b c d e f y"), (1, ""), (2, " \n\t "), (3, long), (4, long), (7, "a\xa0b c d e f"), (8, "a\x1cb c d e f")]
    assert run(spark, rows, 5, buckets=3) == brute(rows, 5)
    assert run(spark, [(i, "only these six words are here") for i in (3, 1, 2)], 6, buckets=2) == brute([(i, "only these six words are here") for i in (3, 1, 2)], 6)
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_buckets_are_dealt_again(monkeypatch):
    """In one process, so that the limit can be lowered."""
    monkeypatch.setattr(s, "BUCKET_LIMIT", 2_000)
    rows = [r for r in texts(5) if r[0] != 3]
    rows.append((1000, rows[0][1] + " " + rows[1][1]))
    k, buckets = 8, 3
    runs = []
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], names=["d", "r", "t"])
    now = list(s._pack_documents(buckets, k)(iter([batch])))
    levels = 0
    for level in range(s.LEVELS):
        table = pa.Table.from_batches(now)
        runs += [r for r in table.to_pylist() if r["bucket"] is None]
        packed = table.filter(pa.compute.is_valid(table["bucket"])).sort_by("bucket")
        if not len(packed):
            break
        levels += 1
        now = list(s._settle(buckets, k, level)(iter(packed.to_batches())))
    runs += [r for r in pa.Table.from_batches(now).to_pylist() if r["bucket"] is None and level + 1 == s.LEVELS]
    assert levels > 1
    gone = {d: set() for d, _ in rows}
    for r in runs:
        gone[r["doc"]] |= set(range(r["first"], r["last"]))
    got = []
    for d, t in rows:
        w = WORD.findall(t)
        left = " ".join(x for i, x in enumerate(w) if i not in gone[d])
        got.append((d, len(w), len(gone[d]), hashlib.sha256(left.encode()).hexdigest()))
    assert sorted(map(repr, got)) == brute(rows, k)
