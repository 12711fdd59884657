"""The store's queries by name, each with the SQL that DuckDB answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import bloom
from logloom.operators import runs as ops
from logloom.plans import logs
from logloom.sources import binary, requests
from logloom.sources.storage import shared_dir
from logloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_SQL: list[tuple[str, str | Callable[[], str]]] = []

PROBES = ["0000000777", "0000005000"]
BLOOM = bloom.optimal(1000, 0.01)


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            _SQL.append((name, sql))
        return f

    return add


def _user(with_seg: bool = True) -> str:
    return f"WITH {logs.SQL_LOG_USER}" + (f", {logs.SQL_SEG}" if with_seg else "")


def _event() -> str:
    return f"WITH {logs.SQL_LOG_EVENT}, {logs.SQL_SEG}"


_NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) AS rn FROM log) WHERE rn = 1)"


# live views


@query("live_view_user", f"{_user(False)} SELECT k, v, ts FROM {_NEWEST} WHERE op = 0")
def live_view_user(spark, sf_dir):
    return ops.live(logs.log_user(spark, sf_dir)).select("k", "v", "ts")


@query("live_view_event", f"WITH {logs.SQL_LOG_EVENT} SELECT k, v, ts FROM {_NEWEST} WHERE op = 0")
def live_view_event(spark, sf_dir):
    return ops.live(logs.log_event(spark, sf_dir)).select("k", "v", "ts")


@query("live_view_order", f"WITH {logs.SQL_LOG_ORDER} SELECT k, v, ts FROM {_NEWEST} WHERE op = 0")
def live_view_order(spark, sf_dir):
    return ops.live(logs.log_order(spark, sf_dir)).select("k", "v", "ts")


@query("put_after_delete", f"{_user(False)}, w AS (SELECT *, lag(op) OVER (PARTITION BY k ORDER BY ts, seq) AS before FROM log) SELECT k, count(*)::BIGINT AS n FROM w WHERE op = 0 AND before = 1 GROUP BY k")
def put_after_delete(spark, sf_dir):
    from pyspark.sql.window import Window

    log = logs.log_user(spark, sf_dir)
    return log.withColumn("before", F.lag("op").over(Window.partitionBy("k").orderBy("ts", "seq"))).filter("op = 0 and before = 1").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


# gets, puts and responses


@query("get_one", f"{_user(False)} SELECT k, v FROM {_NEWEST} WHERE op = 0 AND k = '77'")
def get_one(spark, sf_dir):
    return ops.live(logs.log_user(spark, sf_dir).filter(F.col("k") == "77")).select("k", "v")


@query("get_many", f"{_user(False)}, keys AS (SELECT range::VARCHAR AS k FROM range(0, 200)) SELECT keys.k, l.v, (CASE WHEN l.k IS NULL THEN 404 ELSE 200 END)::INTEGER AS status FROM keys LEFT JOIN (SELECT * FROM {_NEWEST} WHERE op = 0) l ON keys.k = l.k")
def get_many(spark, sf_dir):
    keys = spark.range(0, 200).select(F.col("id").cast("string").alias("k"))
    live = ops.live(logs.log_user(spark, sf_dir).join(keys, "k", "left_semi")).select("k", "v", F.lit(200).alias("status"))
    return keys.join(live, "k", "left").select("k", "v", F.coalesce("status", F.lit(404)).alias("status"))


@query("get_after_delete", f"{_user(False)} SELECT k, ts FROM {_NEWEST} WHERE op = 1")
def get_after_delete(spark, sf_dir):
    return logs.newest(logs.log_user(spark, sf_dir), "k").filter("op = 1").select("k", "ts")


@query(
    "response_json_base64",
    f"""{_user(False)}, keys AS (SELECT range::VARCHAR AS k FROM range(0, 200))
SELECT keys.k, (CASE WHEN l.k IS NULL THEN 404 ELSE 200 END)::INTEGER AS status,
  CASE WHEN l.k IS NULL THEN '{{"message":"Not Found","error":"Not Found","code":404}}' ELSE '{{"key":"' || keys.k || '","value":"' || base64(encode(l.v)) || '"}}' END AS body
FROM keys LEFT JOIN (SELECT * FROM {_NEWEST} WHERE op = 0) l ON keys.k = l.k""",
)
def response_json_base64(spark, sf_dir):
    keys = spark.range(0, 200).select(F.col("id").cast("string").alias("k"))
    return requests.get_responses(ops.live(logs.log_user(spark, sf_dir)), keys)


@query(
    "validate_put",
    """WITH b AS (SELECT event_id AS id, event_id % 5 AS m, event_type AS v FROM events)
SELECT id, CASE WHEN m = 3 THEN NULL WHEN m = 1 THEN '' ELSE id::VARCHAR END AS key, CASE WHEN m = 3 THEN NULL WHEN m = 2 THEN '' ELSE v END AS value,
  (CASE WHEN m IN (1, 2, 3) THEN 400 ELSE 200 END)::INTEGER AS status, CASE WHEN m = 3 THEN 'invalid JSON' WHEN m IN (1, 2) THEN 'empty parametr' END AS message FROM b""",
)
def validate_put(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.col("event_id") % 5
    key = F.when(m == 1, F.lit("")).otherwise(F.col("event_id").cast("string"))
    value = F.when(m == 2, F.lit("")).otherwise(F.col("event_type"))
    body = F.when(m == 3, F.lit('{"key": ')).otherwise(F.to_json(F.struct(key.alias("key"), value.alias("value"))))
    return requests.parse_puts(e.select(F.col("event_id").alias("id"), body.alias("body"))).select("id", "key", "value", "status", F.col("error.message").alias("message"))


@query("loadgen_rows", "SELECT range::VARCHAR AS key, 'value_' || range::VARCHAR AS value FROM range(200, 400)")
def loadgen_rows(spark, sf_dir):
    return requests.load_rows(spark)


@query("loadgen_summary", "SELECT count(*) FILTER (WHERE event_type <> 'error')::BIGINT AS ok, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failed, count(*)::DOUBLE / (max(floor(epoch(ts))) - min(floor(epoch(ts)))) AS per_second FROM events")
def loadgen_summary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_timestamp("ts")
    return e.agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("failed"), (F.count(F.lit(1)).cast("double") / (F.max(t) - F.min(t))).alias("per_second"))


# segments, memtables, runs and their metadata


@query("memtable_latest", f"{_user()} SELECT seg, k, v, ts, seq, op FROM lat")
def memtable_latest(spark, sf_dir):
    return logs.runs(logs.log_user(spark, sf_dir)).select("seg", "k", "v", "ts", "seq", "op")


@query("memtable_bytes", f"{_user()} SELECT seg, sum(9 + strlen(k) + CASE WHEN op = 1 THEN 0 ELSE strlen(v) END)::BIGINT AS bytes, count(*)::BIGINT AS n_keys FROM lat GROUP BY seg")
def memtable_bytes(spark, sf_dir):
    size = F.lit(logs.ENTRY_OVERHEAD) + F.octet_length("k") + F.when(F.col("op") == 1, 0).otherwise(F.octet_length("v"))
    return logs.runs(logs.log_user(spark, sf_dir)).groupBy("seg").agg(F.sum(size).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("n_keys"))


_SIZE = "17 + strlen(k) + CASE WHEN op = 1 THEN 0 ELSE strlen(v) END"
_POS = f"pos AS (SELECT seg, k, v, ts, seq, op, (row_number() OVER (PARTITION BY seg ORDER BY k) - 1)::BIGINT AS pos, coalesce(sum({_SIZE}) OVER (PARTITION BY seg ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM lat)"
_MANIFEST = f"man AS (SELECT seg, min(k) AS min_key, max(k) AS max_key, count(*)::BIGINT AS n_records, sum(op)::BIGINT AS n_tombstones, sum({_SIZE})::BIGINT AS data_bytes, max(seq) AS created_seq FROM lat GROUP BY seg)"
_INDEX = "idx AS (SELECT seg, pos, k FROM pos WHERE pos % 20 = 0)"


@query("run_sorted_pos", f'{_user()}, {_POS} SELECT seg, k, pos, "offset" FROM pos')
def run_sorted_pos(spark, sf_dir):
    return ops.with_positions(logs.runs(logs.log_user(spark, sf_dir))).select("seg", "k", "pos", "offset")


@query("run_last_offset", f'{_user()}, {_POS} SELECT seg, max("offset")::BIGINT AS last_record_offset FROM pos GROUP BY seg')
def run_last_offset(spark, sf_dir):
    return ops.with_positions(logs.runs(logs.log_user(spark, sf_dir))).groupBy("seg").agg(F.max("offset").alias("last_record_offset"))


@query("run_manifest", f"{_user()}, {_MANIFEST} SELECT * FROM man")
def run_manifest(spark, sf_dir):
    return ops.manifest(logs.runs(logs.log_user(spark, sf_dir)))


@query("segment_stats", f"{_user()} SELECT seg, min(k) AS min_key, max(k) AS max_key, count(*)::BIGINT AS n, count(DISTINCT k)::BIGINT AS n_keys, sum(op)::BIGINT AS n_tombstones FROM seg GROUP BY seg")
def segment_stats(spark, sf_dir):
    seg = logs.segmented(logs.log_user(spark, sf_dir))
    return seg.groupBy("seg").agg(F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("n_keys"), F.sum("op").cast("bigint").alias("n_tombstones"))


@query("sparse_index_flush", f"{_user()}, {_POS}, {_INDEX} SELECT * FROM idx")
def sparse_index_flush(spark, sf_dir):
    return ops.sparse_index(logs.runs(logs.log_user(spark, sf_dir)))


_MERGED = "mer AS (SELECT g, (row_number() OVER (PARTITION BY g ORDER BY k, ts DESC, seq DESC) - 1)::BIGINT AS pos, k, v, ts, seq, op FROM (SELECT *, floor(seg / 4)::BIGINT AS g FROM lat))"
_DEDUP = "ded AS (SELECT g, k, v, ts, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY ts DESC, seq DESC) AS rn FROM (SELECT *, floor(seg / 4)::BIGINT AS g FROM lat)) WHERE rn = 1)"


@query("sparse_index_merge", f"{_user()}, {_MERGED} SELECT g, pos, k FROM mer WHERE pos % 20 = 0 AND pos > 0")
def sparse_index_merge(spark, sf_dir):
    return ops.merged(logs.runs(logs.log_user(spark, sf_dir))).filter("pos % 20 = 0 and pos > 0").select("g", "pos", "k")


@query("store_info", f"{_user()}, {_MANIFEST} SELECT 0 AS level, count(*)::BIGINT AS n_runs, sum(n_records)::BIGINT AS n_records, sum(n_tombstones)::BIGINT AS n_tombstones, sum(data_bytes)::BIGINT AS data_bytes FROM man")
def store_info(spark, sf_dir):
    rows = ops.manifest(logs.runs(logs.log_user(spark, sf_dir))).withColumn("level", F.lit(0))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_records").alias("n_records"), F.sum("n_tombstones").alias("n_tombstones"), F.sum("data_bytes").alias("data_bytes"))


# pruning and lookup


@query("prune_minmax", f"{_event()}, {_MANIFEST} SELECT seg, min_key, max_key FROM man WHERE min_key <= '{PROBES[1]}' AND max_key >= '{PROBES[1]}'")
def prune_minmax(spark, sf_dir):
    return ops.pruned(ops.manifest(logs.runs(logs.log_event(spark, sf_dir))), PROBES[1]).select("seg", "min_key", "max_key")


_FLOOR = f"flo AS (SELECT p AS probe, i.seg, max(pos) AS pos FROM idx i JOIN man m ON i.seg = m.seg, (SELECT unnest({PROBES}) AS p) WHERE i.k <= p AND min_key <= p AND p <= max_key GROUP BY p, i.seg)"


@query("index_floor_lookup", f"{_event()}, {_POS}, {_INDEX}, {_MANIFEST}, {_FLOOR} SELECT * FROM flo")
def index_floor_lookup(spark, sf_dir):
    return ops.index_floor(logs.runs(logs.log_event(spark, sf_dir)), PROBES)


@query("block_scan", f"{_event()}, {_POS}, {_INDEX}, {_MANIFEST}, {_FLOOR} SELECT probe, r.seg, r.pos, v, ts, seq, op FROM flo JOIN pos r ON r.seg = flo.seg AND r.pos >= flo.pos AND r.pos < flo.pos + 20 AND r.k = probe")
def block_scan(spark, sf_dir):
    return ops.block_scan(logs.runs(logs.log_event(spark, sf_dir)), PROBES)


@query("lookup_newest", f"{_user()} SELECT k, v, ts FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) AS rn FROM lat) WHERE rn = 1 AND op = 0")
def lookup_newest(spark, sf_dir):
    log = logs.log_user(spark, sf_dir)
    return ops.lookup_newest(logs.runs(log), log.select("k").distinct())


RUN_BLOOM = bloom.optimal(100, 0.01)


@query(
    "lookup_pruned",
    lambda: f"""{_user()}, {_MANIFEST}, {_seeds(RUN_BLOOM)}, bits AS (SELECT DISTINCT seg, {_position(RUN_BLOOM.m)} AS p FROM (SELECT seg, k FROM lat), starts s),
asks AS (SELECT m.seg, u.k FROM (SELECT DISTINCT k FROM log) u JOIN man m ON u.k >= m.min_key AND u.k <= m.max_key),
probe AS (SELECT seg, k, {_position(RUN_BLOOM.m)} AS p FROM asks, starts s),
hits AS (SELECT probe.seg, probe.k FROM probe LEFT JOIN bits ON probe.seg = bits.seg AND probe.p = bits.p GROUP BY probe.seg, probe.k HAVING count(*) = count(bits.p)),
n AS (SELECT k, count(*)::BIGINT AS n_runs FROM hits GROUP BY k)
SELECT l.k, v, ts, n_runs FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) AS rn FROM lat) l JOIN n ON l.k = n.k WHERE rn = 1 AND op = 0""",
)
def lookup_pruned(spark, sf_dir):
    """Every key of the log against the runs that range and filter leave for it."""
    log = logs.log_user(spark, sf_dir)
    path = shared_dir(spark)
    logs.runs(log).write.parquet(path)  # as a flush leaves them: made once, then read by manifest, filters and probes
    return ops.lookup_pruned(spark.read.parquet(path), log.select("k").distinct(), RUN_BLOOM)


@query("lookup_oldest_run_first", f"{_user()} SELECT k, seg, v, ts, op FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seg) AS rn FROM lat) WHERE rn = 1")
def lookup_oldest_run_first(spark, sf_dir):
    return ops.lookup_oldest_run(logs.runs(logs.log_user(spark, sf_dir)))


@query("memtable_lookup", f"{_user()} SELECT u.k, l.k IS NOT NULL AS found, v, ts, op FROM (SELECT DISTINCT k FROM log) u LEFT JOIN (SELECT * FROM lat WHERE seg = (SELECT max(seg) FROM seg)) l ON u.k = l.k")
def memtable_lookup(spark, sf_dir):
    """Every key of the log, asked of the open segment alone."""
    log = logs.log_user(spark, sf_dir)
    seg = logs.segmented(log)
    return ops.lookup_segment(seg.filter(F.col("seg") == seg.agg(F.max("seg")).scalar()), log.select("k").distinct())


# merges and clean-up


@query("compact_keep_all", f"{_user()}, {_MERGED} SELECT * FROM mer")
def compact_keep_all(spark, sf_dir):
    return ops.merged(logs.runs(logs.log_user(spark, sf_dir)))


@query("compact_dedup", f"{_user()}, {_DEDUP} SELECT * FROM ded")
def compact_dedup(spark, sf_dir):
    return ops.merged_newest(logs.runs(logs.log_user(spark, sf_dir)))


@query("compact_drop_tombstones", f"{_user()}, {_DEDUP} SELECT ded.* FROM ded JOIN (SELECT k, min(seg) AS oldest FROM lat GROUP BY k) o ON ded.k = o.k WHERE op = 0 OR oldest < g * 4")
def compact_drop_tombstones(spark, sf_dir):
    return ops.merged_without_tombstones(logs.runs(logs.log_user(spark, sf_dir)))


@query("compaction_candidates", f"{_user()}, {_MANIFEST} SELECT * FROM (SELECT seg, seg % 2 AS level, created_seq, row_number() OVER (PARTITION BY seg % 2 ORDER BY created_seq DESC, seg DESC)::BIGINT AS rank FROM man) WHERE rank <= 4")
def compaction_candidates(spark, sf_dir):
    rows = ops.manifest(logs.runs(logs.log_user(spark, sf_dir))).select("seg", (F.col("seg") % 2).alias("level"), "created_seq")
    return ops.candidates(rows)


@query("orphan_gc", f"{_user()} SELECT DISTINCT 'sst_' || seg::VARCHAR AS path FROM lat WHERE seg % 7 IN (2, 5)")
def orphan_gc(spark, sf_dir):
    files = logs.runs(logs.log_user(spark, sf_dir)).select("seg").distinct().select("seg", F.concat(F.lit("sst_"), F.col("seg").cast("string")).alias("path"))
    return ops.orphans(files.select("path"), files.filter("seg % 7 not in (2, 5)").select("path"))


@query("level_remove_runs", f"{_user()}, {_MANIFEST} SELECT seg, n_records FROM man WHERE seg >= 4")
def level_remove_runs(spark, sf_dir):
    rows = ops.manifest(logs.runs(logs.log_user(spark, sf_dir))).select("seg", "n_records")
    return rows.join(rows.filter("seg < 4").select("seg"), "seg", "left_anti")


# Bloom filters

#: Stated for SQL by itself: salts of the hashes, and FNV-1a over their eight little-endian bytes.
def _seeds(config) -> str:
    fold = "(xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT"
    return f"""salts AS (SELECT i::INTEGER AS i, (i::HUGEINT * [11400714819323198485::HUGEINT, 13787848793156543929::HUGEINT, 10723151780598845931::HUGEINT, 6910470480331203605::HUGEINT][i % 4 + 1]) % 18446744073709551616::HUGEINT AS salt FROM range(0, {config.k}) t(i)),
starts AS (SELECT i, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, 8), lambda j: (salt >> (8 * j)::INTEGER) & 255::HUGEINT)), lambda h, b: {fold}) AS start FROM salts)"""


def _position(m: int) -> str:
    return f"""((list_reduce(list_prepend(s.start::HUGEINT, list_transform(range(1, length(k) + 1), lambda p: ascii(substr(k, p::INTEGER, 1))::HUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)) % {m})::BIGINT"""


_POSITION, _SEEDS = _position(BLOOM.m), _seeds(BLOOM)
_KEYS = f"{_user(False)}, {_SEEDS}, keys AS (SELECT DISTINCT k FROM log), bits AS (SELECT DISTINCT {_POSITION} AS p FROM keys, starts s)"
_HITS = f"hits AS (SELECT k FROM (SELECT k, {_POSITION} AS p FROM (SELECT DISTINCT o_custkey::VARCHAR AS k FROM orders), starts s) q GROUP BY k HAVING bool_and(p IN (SELECT p FROM bits)))"


def _user_keys(spark, sf_dir):
    return logs.log_user(spark, sf_dir).select("k", F.col("k").cast("binary").alias("key")).distinct()


def _bits(masks):
    places = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BLOOM.m - 1).cast("bigint")))
    bits = masks.select("bitmap", places.alias("p"), "bucket").filter(F.bitmap_bucket_number(F.col("p") + 1) == F.col("bucket"))
    return bits.filter(bloom.is_set(F.col("bitmap"), F.col("p"))).select("p")


@query("bloom_params", "WITH c AS (SELECT 1000::BIGINT AS n, unnest([0.01, 0.005, 0.5, 1.5]) AS p), q AS (SELECT n, p, CASE WHEN p > 0 AND p < 1 THEN p ELSE 0.01 END AS own FROM c), r AS (SELECT n, p, floor(-n * ln(own) / pow(ln(2), 2))::BIGINT AS m FROM q) SELECT n, p::DOUBLE AS p, m, ceil(m::DOUBLE / n * ln(2))::BIGINT AS k FROM r")
def bloom_params(spark, sf_dir):
    rates = (0.01, 0.005, 0.5, 1.5)
    sizes = [(1000, p, c.m, c.k) for p in rates for c in [bloom.optimal(1000, p)]]
    return spark.createDataFrame(sizes, "n long, p double, m long, k long")


@query("bloom_positions", f"{_KEYS} SELECT k, i, {_POSITION} AS p FROM keys, starts s")
def bloom_positions(spark, sf_dir):
    return _user_keys(spark, sf_dir).select("k", F.posexplode(bloom.positions(F.col("key"), BLOOM)).alias("i", "p"))


@query("bloom_mask_bits", f"{_KEYS} SELECT p FROM bits")
def bloom_mask_bits(spark, sf_dir):
    return _bits(bloom.masks(_user_keys(spark, sf_dir), "key", BLOOM))


@query("bloom_maybe_contains", f"{_KEYS}, {_HITS} SELECT k FROM hits")
def bloom_maybe_contains(spark, sf_dir):
    probes = logs.log_order(spark, sf_dir).select(F.col("k").cast("binary").alias("key")).distinct()
    hits = bloom.maybe_contains(probes, "key", bloom.masks(_user_keys(spark, sf_dir), "key", BLOOM), BLOOM)
    return hits.select(F.col("key").cast("string").alias("k"))


@query("bloom_false_positives", f"{_KEYS}, {_HITS} SELECT count(*)::BIGINT AS n FROM hits WHERE k NOT IN (SELECT k FROM keys)")
def bloom_false_positives(spark, sf_dir):
    return bloom_maybe_contains(spark, sf_dir).join(_user_keys(spark, sf_dir).select("k"), "k", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("bloom_add", f"{_user(False)}, {_SEEDS}, keys AS (SELECT DISTINCT k FROM log UNION SELECT DISTINCT o_custkey::VARCHAR FROM orders) SELECT DISTINCT {_POSITION} AS p FROM keys, starts s")
def bloom_add(spark, sf_dir):
    """Bits of the users' filter after the customers of the orders have been added to it."""
    more = logs.log_order(spark, sf_dir).select(F.col("k").cast("binary").alias("key")).distinct()
    return _bits(bloom.union_masks(bloom.masks(_user_keys(spark, sf_dir), "key", BLOOM), bloom.masks(more, "key", BLOOM)))


# recovery and streaming


@query("wal_replay", f"WITH {logs.SQL_LOG_ORDER} SELECT k, v, ts, op FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1")
def wal_replay(spark, sf_dir):
    return ops.replayed(logs.log_order(spark, sf_dir)).select("k", "v", "ts", "op")


_LAST = "(SELECT max(seg) FROM seg) - 3"


@query("wal_unflushed_segments", f"{_user()} SELECT seg, count(*)::BIGINT AS n FROM seg WHERE seg > {_LAST} GROUP BY seg")
def wal_unflushed_segments(spark, sf_dir):
    """Segments without a manifest row, where all but the last three are flushed."""
    seg = logs.segmented(logs.log_user(spark, sf_dir))
    flushed = seg.select("seg").distinct().filter(F.col("seg") <= seg.agg(F.max("seg") - 3).scalar())
    return seg.join(flushed, "seg", "left_anti").groupBy("seg").agg(F.count(F.lit(1)).alias("n"))


@query("wal_replay_unflushed", f"{_user()} SELECT k, v, ts, op FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM seg WHERE seg > {_LAST}) WHERE rn = 1")
def wal_replay_unflushed(spark, sf_dir):
    seg = logs.segmented(logs.log_user(spark, sf_dir))
    return ops.replayed(seg.filter(F.col("seg") > seg.agg(F.max("seg") - 3).scalar())).select("k", "v", "ts", "op")


@query("binary_log_records", f"{_user()} SELECT 'wal_' || seg::VARCHAR || '.log' AS path, (row_number() OVER (PARTITION BY seg ORDER BY seq) - 1)::BIGINT AS pos, op, ts, k, v FROM seg")
def binary_log_records(spark, sf_dir):
    """What a scan decodes of the segments' binary log files."""
    found = binary.records_of(binary.log_files(logs.segmented(logs.log_user(spark, sf_dir))))
    return found.select("path", "pos", F.col("op").cast("int").alias("op"), "ts", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query("binary_run_headers", lambda: f"{_user()}, {_MANIFEST}, {_seeds(RUN_BLOOM)}, bits AS (SELECT seg, count(DISTINCT {_position(RUN_BLOOM.m)})::BIGINT AS n_bits FROM lat, starts s GROUP BY seg) SELECT 'sst_' || man.seg::VARCHAR AS path, man.seg AS id, created_seq AS created_at, min_key, max_key, n_records, ceil(n_records / 20.0)::BIGINT AS n_index, n_bits FROM man JOIN bits ON man.seg = bits.seg")
def binary_run_headers(spark, sf_dir):
    """Metadata, index and filter sizes as read back from the runs' binary files."""
    found = binary.run_headers(binary.run_files(logs.runs(logs.log_user(spark, sf_dir)), RUN_BLOOM))
    return found.select("path", "id", "created_at", F.col("min_key").cast("string").alias("min_key"), F.col("max_key").cast("string").alias("max_key"), "n_records", "n_index", "n_bits")


@query("newest_wal", "SELECT arg_max('wal_' || o_orderkey::VARCHAR || '.log', (o_orderdate, o_orderkey)) AS path FROM orders")
def newest_wal(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.agg(F.max_by(F.format_string("wal_%d.log", "o_orderkey"), F.struct("o_orderdate", "o_orderkey")).alias("path"))


@query("stream_ingest_live_view", f"{_user(False)} SELECT k, v, ts FROM {_NEWEST} WHERE op = 0")
def stream_ingest_live_view(spark, sf_dir):
    """The live view over runs that a stream of the log has written."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(static.schema).parquet(sf_dir, pathGlobFilter="events.parquet", recursiveFileLookup=True)
    log = stream.select(F.col("user_id").cast("string").alias("k"), F.col("event_type").alias("v"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("op"))
    path = shared_dir(spark)
    ingest.ingest(log, f"{path}/runs", f"{path}/checkpoint")
    return ops.live(ingest.read_runs(spark, f"{path}/runs")).select("k", "v", "ts")


# the durable store


def _store(spark, **settings):
    from logloom.sources.config import StoreConfig
    from logloom.sources.store import Store

    return Store(spark, f"{shared_dir(spark)}/store", StoreConfig(**settings))


def _filled(spark, sf_dir, parts: int = 4, **settings):
    """The user log, written to a store in parts of its seq range, a flush after each but the last."""
    log = logs.log_user(spark, sf_dir)
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    store = _store(spark, **settings)
    part = F.floor((F.col("seq") - low) * parts / (high - low + 1))
    for i in range(parts):
        store.write(log.filter(part == i).repartitionByRange("seq").sortWithinPartitions("seq").select("k", "v", "ts", "op"))
        if i + 1 < parts:
            store.flush()
    return store


_STORE_SQL = f"{_user(False)} SELECT k, v, ts FROM {_NEWEST} WHERE op = 0"


@query("store_put_get", f"{_user(False)} SELECT u.k, l.v FROM (SELECT DISTINCT k FROM log) u LEFT JOIN (SELECT * FROM {_NEWEST} WHERE op = 0) l ON u.k = l.k")
def store_put_get(spark, sf_dir):
    """Every key of the log, asked of a store that has flushed runs and an open segment."""
    return _filled(spark, sf_dir).get(logs.log_user(spark, sf_dir).select("k").distinct())


@query("store_compact", _STORE_SQL)
def store_compact(spark, sf_dir):
    """The live view after flushes and compactions that the store starts by itself."""
    return _filled(spark, sf_dir, 5, fan_in=2, auto=True).live().select("k", "v", "ts")


@query("store_gc", "SELECT 4::BIGINT AS n_segments_gone, 4::BIGINT AS n_runs_gone, count(*)::BIGINT AS n_live FROM (" + _STORE_SQL + ")")
def store_gc(spark, sf_dir):
    """What one sweep removes after four flushes and a compaction, and the keys that are left."""
    store = _filled(spark, sf_dir)
    store.flush()
    store.compact()
    gone = store.gc(0)
    n = [sum(x.startswith(f) for x in gone) for f in ("log/", "runs/")]
    return store.live().agg(F.lit(n[0]).cast("bigint").alias("n_segments_gone"), F.lit(n[1]).cast("bigint").alias("n_runs_gone"), F.count(F.lit(1)).alias("n_live"))


ORACLE_SQL |= {name: sql if isinstance(sql, str) else sql() for name, sql in _SQL}
