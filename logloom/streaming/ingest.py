"""Continuous ingest: a stream of log rows, each micro-batch written as one sorted run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.plans.logs import newest


def write_run(batch: DataFrame, batch_id: int, path: str) -> None:
    """One run a micro-batch: the newest record of each key, sorted. A retried batch replaces its run."""
    newest(batch, "k").repartitionByRange("k").sortWithinPartitions("k").write.mode("overwrite").parquet(f"{path}/run={batch_id}")


def ingest(log: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in what the streaming log has now, and returns."""
    query = log.writeStream.foreachBatch(lambda df, i: write_run(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs, with ``run`` in order of ingest."""
    return spark.read.parquet(path)
