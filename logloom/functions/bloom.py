"""The store's Bloom filter as column expressions: sizes, salted FNV-1a positions, masks, tests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The FNV-1a 64-bit offset basis and prime, and the salts' multipliers.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
SALT_FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x5FE6EC49E2F6E415)
_U64 = (1 << 64) - 1


@dataclass(frozen=True)
class BloomConfig:
    """m bits and k hashes; kept with each mask, since masks of other sizes cannot be tested."""

    m: int
    k: int


def optimal(n: int, p: float) -> BloomConfig:
    """Sizes for n keys at false-positive rate p; a rate outside (0, 1) means 0.01."""
    p = p if 0 < p < 1 else 0.01
    m = max(1, math.floor(-n * math.log(p) / math.log(2) ** 2))
    return BloomConfig(m, max(1, math.ceil(m / max(1, n) * math.log(2))))


def salt(i: int) -> int:
    return i * SALT_FACTORS[i % len(SALT_FACTORS)] & _U64


def seed_state(i: int) -> int:
    """FNV-1a over the salt's eight little-endian bytes: where hash i of a key starts."""
    h = FNV_OFFSET
    for byte in salt(i).to_bytes(8, "little"):
        h = (h ^ byte) * FNV_PRIME & _U64
    return h


def _bytes(key: Column) -> Column:
    digits, n = F.hex(key), F.length(key)
    places = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    return F.transform(places, lambda p: F.conv(F.substring(digits, 2 * p - 1, F.lit(2)), 16, 10).cast("bigint"))


def position(key: Column, i: int, m: int) -> Column:
    """Bit position of hash i of a binary key. The 64-bit state is kept as two 32-bit halves, which never overflow a bigint."""
    return F.get(_positions(key, [i], m), 0)


def _positions(key: Column, hashes: list[int], m: int) -> Column:
    """One fold over the key's bytes carries the states of all hashes."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    start = F.array(*[F.struct(F.lit(h >> 32).cast("bigint").alias("hi"), F.lit(h & 0xFFFFFFFF).cast("bigint").alias("lo")) for h in map(seed_state, hashes)])

    # the prime is 2**40 + 435
    def step(s: Column, b: Column) -> Column:
        x = s["lo"].bitwiseXOR(b)
        low = x * 435
        high = (s["hi"] * 435 + F.shiftrightunsigned(low, 32) + F.shiftleft(x, 8)).bitwiseAND(mask)
        return F.struct(high.alias("hi"), low.bitwiseAND(mask).alias("lo"))

    place = lambda s: ((s["hi"] % m) * F.lit((1 << 32) % m).cast("bigint") + s["lo"] % m) % m
    return F.aggregate(_bytes(key), start, lambda states, b: F.transform(states, lambda s: step(s, b)), lambda states: F.transform(states, place))


def positions(key: Column, config: BloomConfig) -> Column:
    return _positions(key, list(range(config.k)), config.m)


def masks(df: DataFrame, key: str, config: BloomConfig, *by: str) -> DataFrame:
    """by, bucket (of 32768 bits) and bitmap of the filter of each group."""
    bits = df.select(*by, F.explode(positions(F.col(key), config)).alias("p"))
    bucket = F.bitmap_bucket_number(F.col("p") + 1)
    return bits.groupBy(*by, bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bitmap"))


def is_set(bitmap: Column, p: Column) -> Column:
    """Whether bit p is set in the bitmap of its bucket."""
    place = F.bitmap_bit_position(p + 1)
    byte = F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (place % 8).cast("int")) == 1


def union_masks(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """The filters of all keys of a and b, which have the same sizes: new keys are added by the OR of their mask."""
    return a.unionByName(b).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def maybe_contains(probes: DataFrame, key: str, filters: DataFrame, config: BloomConfig, *by: str) -> DataFrame:
    """by and key of each probe that its group's filter may hold.

    Probes have the columns by, and meet the one row that their group's filter has for each bucket
    of their bits. A filter without groups has m / 32768 rows, which follow its planned size, not
    the data.
    """
    bits = probes.select(*by, key, positions(F.col(key), config).alias("p_")).distinct()
    if config.m <= 32768:  # one bucket: all bits of a probe meet one bitmap
        if not by:
            return bits.withColumn("bitmap", filters.agg(F.bitmap_or_agg("bitmap")).scalar()).filter(F.forall("p_", lambda p: is_set(F.col("bitmap"), p))).select(key)
        return bits.join(filters, list(by)).filter(F.forall("p_", lambda p: is_set(F.col("bitmap"), p))).select(*by, key)
    one = bits.select(*by, key, F.explode(F.array_distinct("p_")).alias("p"), F.size(F.array_distinct("p_")).alias("all_")).withColumn("bucket", F.bitmap_bucket_number(F.col("p") + 1))
    hit = one.join(filters, [*by, "bucket"]).filter(is_set(F.col("bitmap"), F.col("p")))
    return hit.groupBy(*by, key, "all_").agg(F.count(F.lit(1)).alias("n_")).filter("n_ = all_").select(*by, key)
