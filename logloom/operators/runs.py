"""Runs and their metadata: manifest, sparse index, pruning, lookup, merge and clean-up.

A run table has columns seg, k, v, ts, seq and op; seg orders runs from old to new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.functions import bloom, bloom_slices
from logloom.plans.logs import FAN_IN, INDEX_STEP, RECORD_OVERHEAD, last_by, newest

#: Probes' runs that are broadcast at most; more are joined by shuffle.
BROADCAST_PROBES = 100_000


def live(log: DataFrame) -> DataFrame:
    """Newest record of each key, then without tombstones."""
    return newest(log, "k").filter("op = 0")


def replayed(log: DataFrame) -> DataFrame:
    """The last record of each key by log position, tombstones too."""
    return last_by(log, ("seq",), "k")


def with_positions(runs: DataFrame) -> DataFrame:
    """Each record's position in its sorted run, and the byte offset of its encoding in the data section."""
    w = Window.partitionBy("seg").orderBy("k")
    size = F.lit(RECORD_OVERHEAD) + F.octet_length("k") + F.when(F.col("op") == 1, 0).otherwise(F.octet_length("v"))
    return runs.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).withColumn("offset", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))


def manifest(runs: DataFrame) -> DataFrame:
    size = F.lit(RECORD_OVERHEAD) + F.octet_length("k") + F.when(F.col("op") == 1, 0).otherwise(F.octet_length("v"))
    return runs.groupBy("seg").agg(
        F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.count(F.lit(1)).alias("n_records"),
        F.sum("op").cast("bigint").alias("n_tombstones"), F.sum(size).cast("bigint").alias("data_bytes"), F.max("seq").alias("created_seq"),
    )


def sparse_index(runs: DataFrame) -> DataFrame:
    """Every INDEX_STEP-th record of each run, the first included."""
    return with_positions(runs).filter(F.col("pos") % INDEX_STEP == 0).select("seg", "pos", "k")


def merged(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """All versions of groups of consecutive runs, by key and newest first, with positions."""
    w = Window.partitionBy("g").orderBy("k", F.desc("ts"), F.desc("seq"))
    grouped = runs.withColumn("g", F.floor(F.col("seg") / fan_in).cast("bigint"))
    return grouped.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).select("g", "pos", "k", "v", "ts", "seq", "op")


def merged_newest(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The newest version of each key of groups of consecutive runs."""
    return newest(runs.withColumn("g", F.floor(F.col("seg") / fan_in).cast("bigint")), "g", "k").select("g", "k", "v", "ts", "seq", "op")


def merged_without_tombstones(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """As merged_newest, less the tombstones whose key no run older than the group holds: only those are safe to drop."""
    oldest = runs.groupBy("k").agg(F.min("seg").alias("oldest_"))
    return merged_newest(runs, fan_in).join(oldest, "k").filter((F.col("op") == 0) | (F.col("oldest_") < F.col("g") * fan_in)).select("g", "k", "v", "ts", "seq", "op")


def candidates(manifest_rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The newest runs of each level, as many as a compaction takes."""
    w = Window.partitionBy("level").orderBy(F.desc("created_seq"), F.desc("seg"))
    return manifest_rows.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= fan_in)


def orphans(files: DataFrame, live_files: DataFrame) -> DataFrame:
    """Files that no manifest row names."""
    return files.join(live_files, "path", "left_anti")


def pruned(manifest_rows: DataFrame, probe: str) -> DataFrame:
    """Runs whose key range holds the probe."""
    return manifest_rows.filter((F.col("min_key") <= probe) & (F.col("max_key") >= probe))


def _probed(runs: DataFrame, probes: list[str]) -> DataFrame:
    """The records, with positions, of runs whose range holds a probe, and the probe; other runs are never sorted."""
    keys = F.explode(F.array(*[F.lit(p) for p in probes])).alias("probe")
    ranges = manifest(runs).select("seg", "min_key", "max_key", keys).filter("min_key <= probe and probe <= max_key").select("seg", "probe")
    few = ranges.limit(BROADCAST_PROBES + 1).count() <= BROADCAST_PROBES
    asked = F.broadcast(ranges) if few else ranges
    return with_positions(runs.join(asked.select("seg").distinct(), "seg", "left_semi")).join(asked, "seg")


def index_floor(runs: DataFrame, probes: list[str]) -> DataFrame:
    """probe, seg and the last indexed position not after the probe, in runs whose range holds it."""
    hits = _probed(runs, probes).filter((F.col("pos") % INDEX_STEP == 0) & (F.col("k") <= F.col("probe")))
    return hits.groupBy("probe", "seg").agg(F.max("pos").alias("pos"))


def block_scan(runs: DataFrame, probes: list[str]) -> DataFrame:
    """The records that the probes' index blocks hold for them."""
    rows = _probed(runs, probes)
    start = F.max(F.when((F.col("pos") % INDEX_STEP == 0) & (F.col("k") <= F.col("probe")), F.col("pos"))).over(Window.partitionBy("seg", "probe"))
    rows = rows.withColumn("start", start)
    return rows.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + INDEX_STEP) & (F.col("k") == F.col("probe"))).select("probe", "seg", "pos", "v", "ts", "seq", "op")


def lookup_newest(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """v, ts of each key that the newest record over all runs does not delete."""
    return newest(runs.join(keys, "k"), "k").filter("op = 0").select("k", "v", "ts")


def lookup_segment(segment: DataFrame, keys: DataFrame) -> DataFrame:
    """k, found, v, ts, op of each key in one segment's newest records alone; a tombstone is found too, and tells not to look further."""
    return keys.join(newest(segment, "k").select("k", "v", "ts", "op", F.lit(True).alias("found")), "k", "left").select("k", F.coalesce("found", F.lit(False)).alias("found"), "v", "ts", "op")


def lookup_oldest_run(runs: DataFrame) -> DataFrame:
    """What a probe of runs from old to new answers first: each key's record in its oldest run."""
    return runs.groupBy("k").agg(F.min(F.struct("seg", "v", "ts", "op")).alias("r_")).select("k", "r_.*")


def _asked(runs: DataFrame, keys: DataFrame, config: bloom.BloomConfig) -> DataFrame:
    """seg and k of each key and the runs whose range holds it and whose filter may."""
    ranges = manifest(runs).select("seg", "min_key", "max_key")
    inside = (F.col("k") >= F.col("min_key")) & (F.col("k") <= F.col("max_key"))
    if config.m <= bloom_slices.MAX_BITS:
        hits = bloom_slices.maybe_contains(keys, runs.select(F.col("seg").alias("g"), "k"), config)
        return hits.withColumnRenamed("g", "seg").join(ranges, "seg").filter(inside).select("seg", "k")
    probes = keys.join(ranges, inside).select("seg", F.col("k").cast("binary").alias("key"))
    masks = bloom.masks(runs.select("seg", F.col("k").cast("binary").alias("key")), "key", config, "seg")
    return bloom.maybe_contains(probes, "key", masks, config, "seg").select("seg", F.col("key").cast("string").alias("k"))


def lookup_pruned(runs: DataFrame, keys: DataFrame, config: bloom.BloomConfig) -> DataFrame:
    """As lookup_newest, but of each key only runs are read whose range holds it and whose filter may.

    keys has k; a run has one record of each of its keys. Returns k, v, ts, and n_runs, the runs that were probed. Keys meet the filters of many
    runs at once, bit by bit; only the pairs that are left meet the runs' ranges, then their records by
    run and key. Filters of more than bloom_slices.MAX_BITS bits are met pair by pair, after the ranges.
    """
    asked = _asked(runs, keys.select("k").filter("k is not null").distinct(), config)
    found = runs.select("seg", "k", F.struct("ts", "seq", "v", "op").alias("r_"))
    best = asked.join(found, ["seg", "k"], "left").groupBy("k").agg(F.max("r_").alias("r_"), F.count(F.lit(1)).alias("n_runs"))
    return best.filter("r_.op = 0").select("k", "r_.v", "r_.ts", "n_runs")
