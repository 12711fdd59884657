"""Filters of many groups, turned on their side: for each bit, the groups that set it.

A key meets a whole block of groups at once. The AND of the few rows of its bits is the set of groups
whose filter may hold it, 64 groups a machine word, so pairs of key and group are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.bloom import FNV_PRIME, BloomConfig, seed_state

#: Groups of a block, bits of its slices and groups whose members one task takes together at most; keys that meet a block in one part (about), keys tested at a time, and hits of a batch.
BLOCK, BLOCK_BITS, STRIPE, KEYS, STEP, HITS = 8192, 1 << 25, 512, 1 << 16, 1 << 10, 1 << 16
#: Bits of a filter at most: the slices of a block of 64 groups are BLOCK_BITS then.
MAX_BITS = BLOCK_BITS // 64


def positions(keys: pa.Array, config: BloomConfig) -> np.ndarray:
    """Bit positions of every key's bytes, one row for each hash."""
    keys = keys.cast(pa.large_binary())
    ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")  # longest first: those that have a byte j come before the others
    starts = ends[:-1][order]
    longer = len(keys) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
    state = np.repeat(np.array([seed_state(i) for i in range(config.k)], np.uint64)[:, None], len(keys), axis=1)
    for j, n in enumerate(longer):
        state[:, :n] = (state[:, :n] ^ data[starts[:n] + j]) * np.uint64(FNV_PRIME)
    out = np.empty(state.shape, np.int64)
    out[:, order] = state % np.uint64(config.m)
    return out


def _widths(config: BloomConfig) -> tuple[int, int]:
    """Groups of a block, and of the stripes that a block is made of; both are multiples of 64."""
    width = min(BLOCK, max(64, BLOCK_BITS // config.m // 64 * 64))
    stripe = min(STRIPE, width)
    return width // stripe * stripe, stripe


def _slices(batches: Iterator[pa.RecordBatch], config: BloomConfig, width: int) -> Iterator[pa.RecordBatch]:
    """stripe and slices from stripe, g and k in order of stripe."""

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([at], pa.int64()), pa.array([np.packbits(bits, axis=1, bitorder="little").tobytes()], pa.binary())], ["stripe", "slices"])

    at, bits = None, None
    for batch in batches:
        stripes, groups = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        places = positions(batch.column(2), config)
        for a, b in pairwise([*np.flatnonzero(np.diff(stripes, prepend=stripes[:1] - 1)), len(stripes)]):
            if stripes[a] != at:
                if at is not None:
                    yield row()
                at, bits = int(stripes[a]), np.zeros((config.m, width), bool)
            bits[places[:, a:b], groups[a:b] - at * width] = True
    if at is not None:
        yield row()


def _hits(batches: Iterator[pa.RecordBatch], config: BloomConfig, width: int, stripe: int) -> Iterator[pa.RecordBatch]:
    """g and k from block, part, k, stripe and slices in that order; the rows with slices come first in each part of a block."""
    at, slices = None, None
    for batch in batches:
        blocks, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = [*np.flatnonzero(batch.column(2).is_null().to_numpy(zero_copy_only=False)), len(blocks)]
        for a, b in pairwise([-1, *rows]):
            if a >= 0:
                if at != (blocks[a], parts[a]):
                    at, slices = (int(blocks[a]), int(parts[a])), np.zeros((config.m, width // 64), np.uint64)
                word = (batch.column(3)[int(a)].as_py() * stripe - at[0] * width) // 64
                slices[:, word : word + stripe // 64] = np.frombuffer(batch.column(4)[int(a)].as_buffer(), np.uint64).reshape(config.m, -1)
            for c in range(a + 1, b, STEP):
                keys = batch.column(2).slice(c, min(STEP, b - c))
                first, *others = positions(keys, config)
                words = slices[first]
                for p in others:
                    words &= slices[p]
                key, word = np.nonzero(words)
                hit, bit = np.nonzero(np.unpackbits(words[key, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                groups, key = at[0] * width + word[hit] * 64 + bit, key[hit]
                for d in range(0, len(groups), HITS):
                    yield pa.record_batch([pa.array(groups[d : d + HITS], pa.int64()), keys.take(pa.array(key[d : d + HITS]))], ["g", "k"])


def maybe_contains(keys: DataFrame, members: DataFrame, config: BloomConfig) -> DataFrame:
    """g and k of each key (k) and the groups (g) whose filter, of all their members (g, k), may hold it.

    A filter has MAX_BITS bits at most. Keys are distinct; they meet only blocks of groups whose
    range of members holds them.
    """
    width, stripe = _widths(config)
    members = members.filter("k is not null").select(F.floor(F.col("g") / stripe).cast("bigint").alias("stripe"), "g", "k")
    block = F.floor(F.col("stripe") / (width // stripe)).cast("bigint").alias("block")
    slices = members.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(lambda b: _slices(b, config, stripe), "stripe long, slices binary")
    spans = members.groupBy(block).agg(F.min("k").alias("low"), F.max("k").alias("high"))
    parts = keys.agg(F.greatest(F.lit(1), F.ceil(F.count("k") / KEYS)).alias("n")).scalar()
    asked = keys.join(F.broadcast(spans), F.col("k").between(F.col("low"), F.col("high")))
    asked = asked.select("block", F.pmod(F.xxhash64("k"), parts).alias("part"), "k", F.lit(None).cast("bigint").alias("stripe"), F.lit(None).cast("binary").alias("slices"))
    dealt = slices.select(block, F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), F.lit(None).cast("string").alias("k"), "stripe", "slices")
    rows = asked.unionByName(dealt).repartition("block", "part").sortWithinPartitions("block", "part", "k")  # nulls first
    return rows.mapInArrow(lambda b: _hits(b, config, width, stripe), "g long, k string")
