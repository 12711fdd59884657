"""A training corpus from ``documents``: reject, deduplicate, decontaminate, mix and shard.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of docs. ``run`` writes each stage as Parquet and reads it again.
Rejecting stages keep every row that they have no reason to drop; nulls, repeated rows and extra
columns are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from logloom.llm.common import free_name, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or the learned decision list rejects go."""
    return quality_rules.reject_bad(docs, table(spark, sf_dir, "labels")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays."""
    return ngram_join.one_of_each_group(docs).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by Poisson counts to the sources' target weights, and shuffled."""
    copy_no, key = free_name(docs, "copy_no"), free_name(docs, "shuffle_key")
    return mixing.mix_sources(docs, mixing.TARGETS, mixing.EPOCHS, copy_no=copy_no, shuffle_key=key).select(docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard, in a column after those of docs."""
    return sharding.assign_shards(docs, sharding.build_tree(sharding.N_SHARDS), free_name(docs, "shard"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("mixing", mixture),
    ("sharding", shards),
]

#: The first stage learns its rules from labels, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
