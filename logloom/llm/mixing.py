"""Mixing sources to target weights by Poisson replication.

Each source's mean repetition rate is the share it shall have, over the share it has. A
document's count is the Poisson quantile of a uniform hashed from (seed, doc_id): the number
of cumulative probabilities that are not above it, from a table where the rate is up to
TABLE_RATE, and beyond by the Cornish-Fisher expansion of the quantile, so that the expression's
size does not follow the rate. Rows are exploded by their counts.

The global shuffle orders copies by a hash of (seed, row, copy) and cuts the hash's range into
equal partitions, so the order of all rows, partition after partition, is the same for any number
of partitions and any retry. Rows that are equal in all columns are grouped first, combined
before they are shuffled; their copies are numbered through, so they are strewn like any others.
Copies beyond CHUNK of a row are made by several tasks.

Defined results: sources without a weight, and null sources, share what the weights leave of 1
at their natural proportions; a null doc_id draws by the digest of its text; repeated rows draw
alike; a null or empty text has no bytes; a source without bytes gets rate 0; very long texts are
rows like others; an empty table gives no rows. Input columns, none of them of map type, are kept;
``copy_no`` and ``shuffle_key`` replace columns of those names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import free_name, integer, materialize, row_key, table, uniform

SEED = "mix-1"
#: Shares of the mixture's bytes.
TARGETS = {"src0": 0.10, "src1": 0.08, "src2": 0.08, "src3": 0.06, "src4": 0.06, "src5": 0.04, "src6": 0.02}
#: Bytes out over bytes in.
EPOCHS = 1.0
#: Rates up to which quantiles come from a table of probabilities.
TABLE_RATE = 256.0
#: Copies of a row that one task makes at once.
CHUNK = 1_000
#: Groups of equal rows that are broadcast at most; more are joined by shuffle.
BROADCAST_GROUPS = 500_000
#: Bytes of text of a partition of the result.
PARTITION_BYTES = 256 << 20
#: Acklam's rational approximation of the normal quantile, in the middle and in the tails.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def poisson_cdf(rate: float) -> list[float]:
    """Cumulative probabilities from 0 on, until the rest is under 2**-53."""
    if rate <= 0:
        return []
    last = math.ceil(rate + 12 * math.sqrt(rate) + 40)
    out, total = [], 0.0
    for k in range(last + 1):
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out.append(total)
        if k > rate and total >= 1 - 2.0**-53:
            break
    return out


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(u: Column) -> Column:
    """Of u in (0, 1), to nine digits."""
    low = F.least(u, F.lit(1.0) - u)
    q = F.sqrt(F.lit(-2.0) * F.log(low))
    tail = _polynomial(q, _C) / _polynomial(q, _D)  # of the lower end
    d = u - 0.5
    r = d * d
    return F.when(low >= 0.02425, _polynomial(r, _A) * d / _polynomial(r, _B)).when(u < 0.5, tail).otherwise(-tail)


def poisson_quantile(u: Column, rate: float) -> Column:
    """How often a row of this rate that draws u in [0, 1) is repeated."""
    if rate <= TABLE_RATE:
        return F.size(F.filter(F.array(*[F.lit(x) for x in poisson_cdf(rate)]).cast("array<double>"), lambda c: c <= u))
    z, s = normal_quantile(F.greatest(F.least(u, F.lit(1 - 2.0**-53)), F.lit(2.0**-53))), math.sqrt(rate)
    # a lambda's argument is made once
    w = F.get(F.transform(F.array(z), lambda z: F.lit(rate) + F.lit(s) * z + (z * z - 1) / 6 + (z - z * z * z) / F.lit(72 * s)), 0)
    return F.greatest(F.ceil(w - 0.5), F.lit(0)).cast("int")


def _group(weights: dict[str, float], source: str) -> Column:
    return F.when(F.col(source).isin(*weights), F.col(source)).otherwise(F.lit(None).cast("string"))


def source_bytes(docs: DataFrame, weights: dict[str, float], source: str = "source", text: str = "text") -> dict[str | None, int]:
    """Bytes of text by source; None stands for the sources without a weight. One row for each weight, and one more, comes to the driver."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    return {r[0]: r[1] or 0 for r in docs.groupBy(_group(weights, source).alias("g")).agg(F.sum(size.cast("bigint"))).collect()}


def target_rates(sums: dict[str | None, int], weights: dict[str, float], epochs: float = EPOCHS) -> dict[str | None, float]:
    """Mean repetitions by source, from the sources' bytes."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are shares of the mixture: none below 0, 1 in all at most")
    total = float(sum(sums.values()))
    share = {**weights, None: max(0.0, 1 - sum(weights.values()))}
    return {g: epochs * share[g] * total / sums[g] if sums.get(g) else 0.0 for g in share}


def mix_sources(docs: DataFrame, weights: dict[str, float] = TARGETS, epochs: float = EPOCHS, seed: str = SEED, source: str = "source", doc_id: str = "doc_id", text: str = "text", copy_no: str = "copy_no", shuffle_key: str = "shuffle_key", partitions: int | None = None) -> DataFrame:
    """docs with each row repeated by its Poisson count, shuffled, with ``copy_no`` and ``shuffle_key``."""
    docs = docs.drop(copy_no, shuffle_key)
    sums = source_bytes(docs, weights, source, text)
    rates = target_rates(sums, weights, epochs)
    key, u, n, same, i = (free_name(docs, x) for x in ("key_", "u_", "n_", "same_", "i_"))
    u_col = F.col(u)
    count = poisson_quantile(u_col, rates[None])
    chain = F
    for g in weights:
        chain = chain.when(F.col(source) == g, poisson_quantile(u_col, rates[g]))
    count = chain.otherwise(count) if weights else count
    counted = docs.withColumn(same, F.xxhash64(*docs.columns)).withColumn(key, row_key(doc_id, text)).withColumn(u, uniform(seed, F.col(key))).withColumn(n, count).filter(F.col(n) > 0)

    # equal rows: one of them stands for all, and is copied that many times more
    groups = materialize(counted.groupBy(same).agg(F.count(F.lit(1)).alias(u)).filter(F.col(u) > 1))
    n_groups = groups.limit(BROADCAST_GROUPS + 1).count()
    side = F.broadcast(groups) if n_groups <= BROADCAST_GROUPS else groups
    single = counted.withColumn(u, F.lit(1).cast("bigint"))
    if n_groups:
        single = single.join(side.select(same), same, "left_anti")

    def exploded(rows: DataFrame, chunked: bool) -> DataFrame:
        total, start = F.col(n) * F.col(u), F.lit(0).cast("bigint")
        if chunked:
            rows = rows.withColumn(i, F.explode(F.sequence(start, total - 1, F.lit(CHUNK).cast("bigint"))))
            rows = rows.repartition(F.col(same), F.col(i))
            return rows.withColumn(i, F.explode(F.sequence(F.col(i), F.least(F.col(i) + CHUNK, total) - 1)))
        return rows.withColumn(i, F.explode(F.sequence(start, total - 1)))

    copies = exploded(single, max(rates.values()) > CHUNK / 2)
    if n_groups:
        many = counted.drop(u).join(side, same).dropDuplicates([same])
        copies = copies.unionByName(exploded(many, True))
    # copy_no counts a row's own copies; rows that equal it go on from there for the order alone
    copies = copies.withColumn(copy_no, (F.col(i) % F.col(n)).cast("int"))
    turn = F.floor(F.col(i) / F.col(n))
    place = F.concat_ws("|", F.col(key), F.md5(F.coalesce(F.col(text), F.lit(""))), F.col(copy_no).cast("string"), F.when(turn > 0, turn.cast("string")))
    copies = copies.withColumn(shuffle_key, integer(f"{seed}|order", place)).drop(key, u, n, i)
    if partitions is None:
        out = sum(rates[g] * (sums.get(g) or 0) for g in rates)
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(out / PARTITION_BYTES))
    slot = F.least(F.floor(F.col(shuffle_key) / math.ceil((1 << 60) / partitions)), F.lit(partitions - 1)).cast("int")
    return copies.repartitionById(partitions, slot).sortWithinPartitions(shuffle_key, same).drop(same)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def sql_mix(source: str, weights: dict[str, float] = TARGETS, epochs: float = EPOCHS, seed: str = SEED) -> str:
    """DuckDB SQL: the rows of ``mix_sources`` over the relation source, with copy_no and shuffle_key."""
    shares = ", ".join(f"('{g}', {w!r}::DOUBLE)" for g, w in weights.items())
    rest = max(0.0, 1 - sum(weights.values()))
    key = "coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))"
    return f"""WITH w(g, share) AS (VALUES {shares}, (NULL, {rest!r}::DOUBLE)),
d AS (SELECT *, CASE WHEN source IN ({", ".join(f"'{g}'" for g in weights)}) THEN source END AS g FROM {source}),
sums AS (SELECT g, sum(octet_length(encode(coalesce(text, ''))))::DOUBLE AS s FROM d GROUP BY g),
rates AS (SELECT s.g, {float(epochs)!r}::DOUBLE * w.share * (SELECT sum(s) FROM sums) / s.s AS rate FROM sums s JOIN w ON s.g IS NOT DISTINCT FROM w.g WHERE s.s > 0),
steps AS (SELECT g, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k ROWS UNBOUNDED PRECEDING) AS c
  FROM (SELECT g, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rates WHERE rate > 0)),
cdf AS (SELECT g, list(c ORDER BY k) AS cs FROM steps GROUP BY g),
n AS (SELECT d.*, {key} AS key_, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)) AS n_
  FROM d JOIN cdf ON d.g IS NOT DISTINCT FROM cdf.g)
SELECT * EXCLUDE (g, key_, n_, turn, c), ('0x' || substr(md5('{seed}|order|' || concat_ws('|', key_, md5(coalesce(text, '')), copy_no::VARCHAR, CASE WHEN turn > 0 THEN turn::VARCHAR END)), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, row_number() OVER (PARTITION BY c, copy_no) - 1 AS turn FROM (SELECT c.*, unnest(range(0, c.n_))::INTEGER AS copy_no, c FROM n c)) q"""


def oracle_sql() -> str:
    return sql_mix("(SELECT doc_id, text, lang, source, n_chars FROM documents)")
