import zlib
from collections import Counter, defaultdict

from logloom.llm import sharding as s

DOCS = "doc_id long, text string, shard string, region_ int"


def docs(spark, n=3000):
    return spark.createDataFrame([(i, f"text {i % 50}", "x", 1) for i in range(n)], DOCS)


def placed(df, tree):
    return {r["doc_id"]: r["out"] for r in s.assign_shards(df, tree, "out").select("doc_id", "out").collect()}


def test_growth_takes_rows_only_into_the_new_shard(spark):
    df = docs(spark)
    tree = s.build_tree(40)
    for _ in range(3):
        more = s.grown(tree)
        new = max(x.shard for x in s.leaves(more))
        a, b = placed(df, tree), placed(df, more)
        moved = [i for i in a if a[i] != b[i]]
        assert moved and all(b[i] == new for i in moved)
        tree = more


def test_the_shard_count_decides():
    assert s.build_tree(42) == s.grown(s.grown(s.build_tree(40)))


def test_weight_changes_stay_in_their_subtree(spark):
    leaf = lambda i, w=1.0: s.Node(f"s{i}", w, shard=i)
    rack = lambda name, *x: s.Node(name, 2.0, x)
    tree = lambda w: s.Node("root", 8.0, (s.Node("r0", 4.0, (rack("k0", leaf(0, w), leaf(1)), rack("k1", leaf(2), leaf(3)))), s.Node("r1", 4.0, (rack("k2", leaf(4), leaf(5)), rack("k3", leaf(6), leaf(7))))))
    df = docs(spark)
    a, b = placed(df, tree(1.0)), placed(df, tree(3.0))
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    assert moved and set(moved) == {(1, 0)}


def test_shares_follow_weights(spark):
    n = Counter(placed(docs(spark, 8000), s.build_tree(40)).values())
    assert set(n) == set(range(40))
    assert 120 < min(n.values()) and max(n.values()) < 290


def test_report(spark):
    rows = [(None, None), (None, "a"), (7, None), (7, None), (8, "é" * 10), (9, "")] + [(i, "same") for i in range(100, 400)]
    out = s.shard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    assert got == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    seven = [r["shard"] for r in out if r["doc_id"] == 7]
    assert len(set(seven)) == 1


def test_repeated_and_null_ids_are_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 64)
    rows = [(7, "same")] * 1000 + [(None, f"text {i}") for i in range(300)] + [(8, "w " * 2_000_000), (7, "other")]
    out = s.shard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter((r["doc_id"], r["text_crc32"]) for r in out) == Counter((i, zlib.crc32(t.encode())) for i, t in rows)


def test_empty_and_clashing_columns(spark):
    assert s.shard_report(docs(spark).limit(0)).count() == 0
    out = s.assign_shards(docs(spark, 10), s.build_tree(), "shard")
    assert out.columns == ["doc_id", "text", "shard", "region_"] and dict(out.dtypes)["shard"] == "int"
    assert out.filter("region_ = 1").count() == 10
