"""Hand-built logs and random operation sequences against a plain dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import bloom, bloom_slices
from logloom.operators import runs as ops
from logloom.plans import logs, queries
from logloom.sources import binary, requests
from logloom.sources.config import StoreConfig, load_config
from logloom.sources.store import Store

LOG = "seq long, k string, v string, ts long, op int"


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize(
    ("rows", "live"),
    [
        ([(1, "a", "x", 10, 0), (2, "a", None, 20, 1)], {}),
        ([(1, "a", "x", 10, 0), (2, "a", None, 20, 1), (3, "a", "y", 30, 0)], {"a": "y"}),
        ([(1, "a", "x", 10, 0), (2, "a", "y", 10, 0)], {"a": "y"}),
        ([(1, "a", "x", 20, 0), (2, "a", "y", 10, 0)], {"a": "x"}),
        ([(1, "a", None, 10, 1)], {}),
        ([(1, "a", "", 10, 0)], {"a": ""}),
    ],
)
def test_live_view(spark, rows, live):
    assert {r["k"]: r["v"] for r in ops.live(frame(spark, rows)).collect()} == live


def test_replay_goes_by_log_position(spark):
    out = ops.replayed(frame(spark, [(1, "a", "x", 20, 0), (2, "a", "y", 10, 0)]))
    assert [(r["k"], r["v"]) for r in out.collect()] == [("a", "y")]
    assert [(r["k"], r["v"]) for r in ops.replayed(out).collect()] == [("a", "y")]


def test_keys_sort_as_bytes(spark):
    rows = [(i, k, "v", 1, 0) for i, k in enumerate(["10", "9", "é", "z"])]
    out = ops.with_positions(frame(spark, rows).withColumn("seg", F.lit(0))).orderBy("pos")
    assert [r["k"] for r in out.collect()] == ["10", "9", "z", "é"]


@pytest.mark.parametrize(("n", "flush", "merge"), [(1, [0], []), (20, [0], []), (21, [0, 20], [20]), (41, [0, 20, 40], [20, 40])])
def test_index_positions(spark, n, flush, merge):
    runs = frame(spark, [(i, f"{i:03d}", "v", 1, 0) for i in range(n)]).withColumn("seg", F.lit(0))
    assert sorted(r["pos"] for r in ops.sparse_index(runs).collect()) == flush
    assert sorted(r["pos"] for r in ops.merged(runs).filter("pos % 20 = 0 and pos > 0").collect()) == merge
    m = ops.manifest(runs).first()
    assert (m["min_key"], m["max_key"], m["n_records"]) == ("000", f"{n - 1:03d}", n)


def test_block_scan_at_the_edges(spark):
    runs = frame(spark, [(i, f"{i:03d}", "v", 1, int(i == 20)) for i in range(10, 52)]).withColumn("seg", F.lit(0))
    found = {r["probe"]: (r["pos"], r["op"]) for r in ops.block_scan(runs, ["009", "010", "020", "030", "051", "052", "0205"]).collect()}
    assert found == {"010": (0, 0), "020": (10, 1), "030": (20, 0), "051": (41, 0)}


def test_tombstones_stay_while_an_older_run_may_hold_the_key(spark):
    rows = [(1, "a", "x", 1, 0, 0), (2, "a", None, 2, 1, 4), (3, "b", None, 3, 1, 4)]
    runs = spark.createDataFrame(rows, LOG + ", seg long")
    assert sorted((r["g"], r["k"], r["op"]) for r in ops.merged_without_tombstones(runs).collect()) == [(0, "a", 0), (1, "a", 1)]


def test_segments_are_those_of_one_running_sum(spark):
    rows = [(3 * i, f"k{i % 9}", "v" * (i % 50), i, 0) for i in range(500)]
    got = {r["seq"]: r["seg"] for r in logs.segmented(frame(spark, rows), 300).collect()}
    total, want = 0, {}
    for s, k, v, _, _ in rows:
        want[s] = total // 300
        total += 9 + len(k) + len(v)
    assert got == want
    assert logs.segmented(frame(spark, [])).count() == 0


def test_long_logs_have_pieces_of_bounded_size(spark, monkeypatch):
    rows = [(3 * i, f"k{i % 9}", "v" * (i % 50), i, 0) for i in range(500)]
    want = sorted(map(tuple, logs.segmented(frame(spark, rows), 300).collect()))
    monkeypatch.setattr(logs, "_PIECE_ROWS", 5)
    assert sorted(map(tuple, logs.segmented(frame(spark, rows), 300).collect())) == want


def test_one_segment_alone(spark):
    segment = frame(spark, [(1, "a", "x", 1, 0), (2, "a", None, 2, 1), (3, "b", "y", 1, 0)])
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert {tuple(r) for r in ops.lookup_segment(segment, keys).collect()} == {("a", True, None, 2, 1), ("b", True, "y", 1, 0), ("c", False, None, None, None)}


def test_newest_file(spark, tmp_path):
    for i, name in enumerate(["wal_2.log", "wal_1.log", "wal_0.log", "other"]):
        (tmp_path / name).write_bytes(b"x")
        __import__("os").utime(tmp_path / name, (1000 + min(i, 1), 1000 + min(i, 1)))
    assert binary.newest_file(spark, str(tmp_path)).first()["path"].endswith("/wal_1.log")


def test_bloom_matches_bytes_and_has_no_false_negatives(spark):
    config = bloom.optimal(50, 0.02)
    keys = ["", "a", "é", "key 10", "z" * 300] + [str(i) for i in range(45)]
    df = spark.createDataFrame([(k.encode(),) for k in keys], "key binary")
    mask = binary.bloom_mask([k.encode() for k in keys], config)
    bits = {r["p"] for r in df.select(F.explode(bloom.positions(F.col("key"), config)).alias("p")).collect()}
    assert bits == {i for i in range(config.m) if mask[i // 8] >> i % 8 & 1}
    masks = bloom.masks(df, "key", config)
    probes = spark.createDataFrame([(k.encode(),) for k in keys + [f"no{i}" for i in range(200)]], "key binary")
    hits = {bytes(r["key"]).decode() for r in bloom.maybe_contains(probes, "key", masks, config).collect()}
    assert set(keys) <= hits and len(hits) < len(keys) + 30
    assert bloom.optimal(100, 2) == bloom.optimal(100, 0.01)
    assert bloom.optimal(5_000_000, 0.005) == bloom.BloomConfig(55_138_767, 8)


def test_requests(spark):
    assert [tuple(r) for r in requests.parse_puts(spark.createDataFrame([('{"KEY":"a","Value":"b"}',)], "body string")).select("key", "value", "status").collect()] == [("a", "b", 200)]
    bodies = ['{"key":"a","value":"b"}', "{bad", '{"key":"","value":"b"}', '{"key":"a"}', ""]
    out = requests.parse_puts(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [(r["status"], r["error"]["message"] if r["error"] else None) for r in out] == [(200, None), (400, "invalid JSON"), (400, "empty parametr"), (400, "empty parametr"), (400, "invalid JSON")]
    live = spark.createDataFrame([("a", "x" * 100, 1)], "k string, v string, ts long")
    got = {r["k"]: (r["status"], r["body"]) for r in requests.get_responses(live, spark.createDataFrame([("a",), ("b",)], "k string")).collect()}
    assert got["b"] == (404, '{"message":"Not Found","error":"Not Found","code":404}') and "\n" not in got["a"][1] and got["a"][0] == 200
    assert [tuple(r) for r in requests.load_rows(spark, 200, 2).collect()] == [("200", "value_200"), ("201", "value_201")]


def test_binary_layouts(spark, tmp_path):
    assert binary.encode_record(0, 1, b"ab", b"c") == bytes([0]) + (1).to_bytes(8, "little") + (2).to_bytes(4, "little") + b"ab" + (1).to_bytes(4, "little") + b"c"
    log = b"".join(binary.encode_record(i % 2, i, f"k{i}".encode(), b"v" * i) for i in range(5))
    (tmp_path / "wal_1.log").write_bytes(log + b"\x00\x01torn")
    rows = binary.read_logs(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["op"], r["ts"], bytes(r["key"]), bytes(r["value"])) for r in rows] == [(i % 2, i, f"k{i}".encode(), b"v" * i) for i in range(5)]
    config = bloom.optimal(41, 0.01)
    data = binary.encode_run(7, 2, 99, [(0, i, f"{i:03d}".encode(), b"x") for i in reversed(range(41))], config)
    run = binary.decode_run(data)
    assert (run["id"], run["level"], run["created_at"], run["min_key"], run["max_key"]) == (7, 2, 99, b"000", b"040")
    assert [k for k, _ in run["index"]] == [b"000", b"020", b"040"] and len(run["mask"]) == (config.m + 7) // 8
    assert all(next(binary.decode_records(data, at))[3] == k for k, at in run["index"])
    (tmp_path / "sst_7").write_bytes(data)
    assert binary.read_runs(spark, str(tmp_path)).count() == 41


def test_store_equals_a_dictionary(spark, tmp_path):
    rng = random.Random(11)
    store = Store(spark, f"file://{tmp_path}/store", StoreConfig(fan_in=2))
    model, ts = {}, 0
    for step in range(9):
        keys = [f"k{rng.randint(0, 12)}" for _ in range(4)]
        ts += 1
        if step % 3 == 2:
            store.delete(spark.createDataFrame([(k, ts) for k in set(keys)], "k string, ts long"))
            for k in keys:
                model.pop(k, None)
        else:
            rows = {k: f"{step}-{rng.random()}" for k in keys}
            store.put(spark.createDataFrame([(k, v, ts) for k, v in rows.items()], "k string, v string, ts long"))
            model |= rows
        if step in (1, 3, 5, 7):
            assert store.flush()
        if step in (4, 8):
            store.compact(0)
        store = Store(spark, store.path, store.config)  # reopened: state is on disk alone
        assert {r["k"]: r["v"] for r in store.live().collect()} == model
    assert store.get_one("nowhere") is None
    k = next(iter(model))
    assert store.get_one(k) == model[k]
    wanted = spark.createDataFrame([(f"k{i}",) for i in range(15)], "k string")
    assert {r["k"]: r["v"] for r in store.get(wanted).collect()} == {f"k{i}": model.get(f"k{i}") for i in range(15)}
    assert store.gc() == []  # young files stay
    assert store.gc(min_age=0)
    assert {r["k"]: r["v"] for r in store.live().collect()} == model
    with pytest.raises(ValueError):
        store.put(spark.createDataFrame([("", "v", 1)], "k string, v string, ts long"))


def test_store_commits_do_not_overwrite_each_other(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put(spark.createDataFrame([("a", "1", 1)], "k string, v string, ts long"))
    asked = spark.createDataFrame([("a",)], "k string")
    assert [r["found"] for r in store.get_unflushed(asked).collect()] == [True]
    seen = store.version()
    store.flush()
    with pytest.raises(RuntimeError):
        store._commit(store.manifest(), seen)
    assert store.get_one("a") == "1"


def test_writers_at_once(spark, tmp_path):
    """Of two writers that saw the same state one commits; positions in the log are never given twice."""
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, f"file://{tmp_path}/s")
    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(lambda i: store._create("claims/x", str(i)), range(6)))
        assert sum(made) == 1 and store._content("claims/x") == str(made.index(True))
        store._fs.delete(store._at("claims/x"), False)
        list(pool.map(lambda i: store.put(spark.createDataFrame([(f"k{i}", f"{i}", 1), ("all", f"{i}", 1)], "k string, v string, ts long")), range(6)))
    rows = store.records().collect()
    assert len(rows) == 12 == len({r["seq"] for r in rows})
    store.flush()
    assert {r["k"] for r in store.live().collect()} == {"all", *(f"k{i}" for i in range(6))}


def test_store_flushes_and_compacts_by_itself(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", StoreConfig(flush_bytes=1, fan_in=2, auto=True))
    for i in range(4):
        store.put(spark.createDataFrame([(f"k{i}", "v", i)], "k string, v string, ts long"))
    assert not store.unflushed()
    assert [(r["level"], r["n_runs"]) for r in store.info().collect()] == [(2, 1)]
    stop = store.start_gc(0.1, 0)
    for _ in range(100):
        if len(store._names("runs")) == 1 and not [n for n in store._names("log") if n.startswith("seg-")]:
            break
        __import__("time").sleep(0.2)
    stop.set()
    assert len(store._names("runs")) == 1 and store.live().count() == 4


def test_masks_take_more_keys(spark):
    config = bloom.optimal(50_000, 0.01)
    keys = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").cast("binary").alias("key"))
    both = bloom.union_masks(bloom.masks(keys.filter("key < '2'"), "key", config, "g"), bloom.masks(keys.filter("key >= '2'"), "key", config, "g"), "g")
    whole = {(r["g"], r["bucket"]): bytes(r["bitmap"]) for r in bloom.masks(keys, "key", config, "g").collect()}
    assert {(r["g"], r["bucket"]): bytes(r["bitmap"]) for r in both.collect()} == whole
    assert bloom.maybe_contains(keys, "key", both, config, "g").count() == 300


def test_config(tmp_path, monkeypatch):
    (tmp_path / "config.yaml").write_text("flush_bytes: 1024  # small\nfan_in: 3\nother: 1\n")
    monkeypatch.setenv("CONFIG_DIR", str(tmp_path))
    assert load_config() == StoreConfig(flush_bytes=1024, fan_in=3)
    nested = tmp_path / "nested.yaml"
    nested.write_text("memtable:\n  maxSize: 2048 # bytes\n\nsstmanager:\n  flushSize: 6\n  clearTime: 7\n  bloom:\n    expectedElements: 1000\n    falsePositiveRate: 0.01\nwal:\n  walPrefix: \"w_\"\nsstPrefix: s_\n")
    monkeypatch.setenv("CONFIG_DIR", str(nested))
    got = load_config()
    assert got == StoreConfig(flush_bytes=2048, fan_in=6, gc_period=7.0, bloom_keys=1000, bloom_fpr=0.01, log_prefix="w_", run_prefix="s_")
    assert got.bloom == bloom.optimal(1000, 0.01)
    monkeypatch.delenv("CONFIG_DIR")
    assert load_config() == StoreConfig()


def test_lookup_of_all_keys_leaves_no_user_out(spark, sf_dir):
    got = sorted(map(tuple, queries.QUERIES["lookup_newest"](spark, sf_dir).collect()))
    assert got == sorted(map(tuple, queries.QUERIES["live_view_user"](spark, sf_dir).collect()))


def _pruned_by_hand(rows, config):
    """k, v, ts and n_runs of each key of rows (seg, k, v, ts, seq, op), its filters made byte by byte."""
    runs = {}
    for r in rows:
        runs.setdefault(r[0], {})[r[1]] = r
    masks = {seg: int.from_bytes(binary.bloom_mask([k.encode() for k in recs], config), "little") for seg, recs in runs.items()}
    out = set()
    for k in {r[1] for r in rows}:
        own = int.from_bytes(binary.bloom_mask([k.encode()], config), "little")
        asked = [s for s, recs in runs.items() if min(recs, key=str.encode).encode() <= k.encode() <= max(recs, key=str.encode).encode() and masks[s] & own == own]
        last = max((runs[s][k] for s in asked if k in runs[s]), key=lambda r: (r[3], r[4]))
        if last[5] == 0:
            out.add((k, last[2], last[3], len(asked)))
    return out


@pytest.mark.parametrize("config", [bloom.optimal(8, 0.3), bloom.optimal(100, 0.01), bloom.BloomConfig(40_000, 3), bloom.BloomConfig(600_000, 3)])
def test_pruned_lookup_equals_filters_byte_by_byte(spark, monkeypatch, config):
    monkeypatch.setattr(bloom_slices, "BLOCK", 128)
    monkeypatch.setattr(bloom_slices, "STRIPE", 64)
    monkeypatch.setattr(bloom_slices, "KEYS", 50)
    rng = random.Random(5)
    names = ["", "é", "z" * 300, "￿", "𐀀"] + [str(i) for i in range(150)]
    rows, seq = [], 0
    for seg in [*range(150), 1000]:  # blocks of two stripes of 64: a full one, a part, and one far off
        for k in rng.sample(names, rng.randint(1, 12)):
            seq += 1
            op = int(rng.random() < 0.2)
            rows.append((seg, k, None if op else f"v{seq}", rng.randint(1, 500), seq, op))
    runs = spark.createDataFrame([*rows, (3, None, "x", 1, 0, 0)], "seg long, k string, v string, ts long, seq long, op int")
    keys = spark.createDataFrame([(k,) for k in [*names, None, "absent", names[0]]], "k string")
    got = ops.lookup_pruned(runs, keys, config)
    assert got.columns == ["k", "v", "ts", "n_runs"]
    assert {tuple(r) for r in got.collect()} == _pruned_by_hand(rows, config)


def _most_rows(node):
    """The largest number of rows that an operator of a plan that has run put out."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _most_rows(node.executedPlan())
    below = [_most_rows(node.plan())] if kind.endswith("QueryStageExec") else [_most_rows(node.children().apply(i)) for i in range(node.children().size())]
    own = node.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *below])


def test_pruned_lookup_makes_no_row_for_each_pair_of_key_and_run(spark, tmp_path):
    record = [(F.col("id") % 600).alias("seg"), (F.col("id") * 7919 % 601).cast("string").alias("k"), F.lit("v").alias("v"), F.lit(1).cast("bigint").alias("ts"), F.col("id").alias("seq"), F.lit(0).alias("op")]
    spark.range(6000).select(*record).write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    out = ops.lookup_pruned(runs, runs.select("k").distinct(), bloom.optimal(100, 0.01))
    assert len(out.collect()) == 601
    assert _most_rows(out._jdf.queryExecution().executedPlan()) < 3 * 6000  # 600 runs and 601 keys are 360,600 pairs
