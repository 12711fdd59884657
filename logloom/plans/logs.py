"""The three change logs derived from the tables, and what the store's parity queries share.

A log has columns k, v (strings), ts (seconds), seq (log position) and op (0 put, 1 delete).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the store's format and default configuration.
FLUSH_BYTES = 1024
INDEX_STEP = 20
FAN_IN = 4
RECORD_OVERHEAD = 17
ENTRY_OVERHEAD = 9

#: Pieces that a log's running sum is cut into at least, and the log positions of a piece at most.
_PIECES, _PIECE_ROWS = 64, 1 << 18


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _is_delete(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).alias("op")


def log_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("k"), F.col("event_type").alias("v"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), _is_delete(F.col("event_type") == "error"))


def log_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.lpad(F.col("event_id").cast("string"), 10, "0").alias("k"), F.col("event_type").alias("v"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), _is_delete(F.col("event_type") == "error"))


def log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_custkey").cast("string").alias("k"), F.col("o_orderpriority").alias("v"), F.unix_timestamp("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), _is_delete(F.col("o_orderstatus") == "P"))


SQL_LOG_USER = "log AS (SELECT user_id::VARCHAR AS k, event_type AS v, floor(epoch(ts))::BIGINT AS ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op FROM events)"
SQL_LOG_EVENT = "log AS (SELECT lpad(event_id::VARCHAR, 10, '0') AS k, event_type AS v, floor(epoch(ts))::BIGINT AS ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op FROM events)"
SQL_LOG_ORDER = "log AS (SELECT o_custkey::VARCHAR AS k, o_orderpriority AS v, floor(epoch(o_orderdate))::BIGINT AS ts, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS op FROM orders)"
SQL_SEG = f"""sz AS (SELECT *, {ENTRY_OVERHEAD} + strlen(k) + strlen(v) AS b FROM log),
seg AS (SELECT *, floor((sum(b) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - b) / {FLUSH_BYTES})::BIGINT AS seg FROM sz),
lat AS (SELECT seg, k, v, ts, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY seg, k ORDER BY ts DESC, seq DESC) AS rn FROM seg) WHERE rn = 1)"""


def segmented(log: DataFrame, budget: int = FLUSH_BYTES) -> DataFrame:
    """log with ``seg``, the number of the byte budget that a row's start falls into, in seq order.

    The running sum has two levels: rows are summed inside pieces of the seq range, and the pieces'
    totals are summed before them. A piece spans _PIECE_ROWS positions at most, and no two rows
    share one, so no task holds the whole log whatever its size. Rows and totals are dealt by piece
    alike, so the join adds no shuffle of rows.
    """
    sized = log.withColumn("b_", (F.lit(ENTRY_OVERHEAD) + F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))).cast("bigint"))
    width = F.greatest(F.lit(1), F.least(F.lit(_PIECE_ROWS), F.ceil((F.max("seq") - F.min("seq") + 1) / _PIECES)))
    ends = log.agg(F.struct(F.min("seq").alias("low"), width.alias("width")).alias("e")).scalar()
    pieces = sized.withColumn("piece_", F.floor((F.col("seq") - ends["low"]) / ends["width"]))
    before = Window.orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("piece_").agg(F.sum("b_").alias("sum_")).select("piece_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("before_"))
    inside = Window.partitionBy("piece_").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum("b_").over(inside), F.lit(0)) + F.col("before_")
    return pieces.join(offsets, "piece_").withColumn("seg", F.floor(run / F.lit(budget)).cast("bigint")).drop("b_", "piece_", "before_")


def newest(log: DataFrame, *keys: str) -> DataFrame:
    """The newest record of each key by (ts, seq): a maximum, so versions are combined before the shuffle and nothing is sorted by time."""
    return last_by(log, ("ts", "seq"), *keys)


def last_by(log: DataFrame, order: tuple[str, ...], *keys: str) -> DataFrame:
    """The row of each key that is largest by the columns of order."""
    rest = [c for c in log.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("r_")
    return log.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"r_.{c}").alias(c) for c in log.columns])


def runs(log: DataFrame, budget: int = FLUSH_BYTES) -> DataFrame:
    """What a flush of each segment writes: the newest record of each of its keys."""
    return newest(segmented(log, budget), "seg", "k")
