import math
from collections import Counter

import pytest

from logloom.llm import mixing as m

DOCS = "doc_id long, text string, source string, copy_no string, u_ int"


def docs(spark, n=4000):
    rows = [(i, "x" * (10 + i % 7), "hot" if i % 3 == 0 else f"s{i % 5}", "c", i) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_cdf_is_the_poisson_distribution():
    for rate in (0.01, 0.7, 3.0, 40.0, 900.0):
        cdf = m.poisson_cdf(rate)
        assert all(a <= b for a, b in zip(cdf, cdf[1:], strict=False))
        assert math.isclose(cdf[0], math.exp(-rate), rel_tol=1e-9, abs_tol=1e-300)
        assert math.isclose(cdf[-1], 1, rel_tol=1e-9)
    assert m.poisson_cdf(0) == []


def test_shares_and_totals(spark):
    weights = {"hot": 0.5, "s1": 0.3}
    out = m.mix_sources(docs(spark), weights, epochs=2.0)
    size = Counter()
    for r in out.select("source", "text").collect():
        size[r["source"] if r["source"] in weights else None] += len(r["text"])
    total = sum(size.values())
    before = sum(10 + i % 7 for i in range(4000))
    assert abs(total / before - 2) < 0.1
    assert abs(size["hot"] / total - 0.5) < 0.03 and abs(size["s1"] / total - 0.3) < 0.03


def test_same_rows_for_any_partitioning(spark):
    a = m.mix_sources(docs(spark, 500), {"hot": 0.4})
    b = m.mix_sources(docs(spark, 500).repartition(13), {"hot": 0.4})
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_quantiles_of_high_rates(spark):
    """Against the summed distribution, and of a size that does not follow the rate."""
    us = [2.0**-52, 1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 0.99999, 1 - 1e-7]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    from pyspark.sql import functions as F

    for rate in (257.0, 900.0, 40_000.0):
        got = [r[0] for r in df.select(m.poisson_quantile(F.col("u"), rate)).collect()]
        cdf = m.poisson_cdf(rate)
        assert all(abs(g - sum(c <= u for c in cdf)) <= 1 for g, u in zip(got, us, strict=True))
    one = m.poisson_quantile(F.col("u"), 1e6)
    assert abs(len(str(one)) - len(str(m.poisson_quantile(F.col("u"), 300.0)))) < 50 and abs(df.select(one).collect()[5][0] - 1e6) < 2


def test_order_does_not_depend_on_partitions_and_equal_rows_are_strewn(spark):
    rows = [(7, "same text", "hot", "c", 1)] * 1000 + [(i, f"text {i}", "s1", "c", i) for i in range(1000)]
    df = spark.createDataFrame(rows, DOCS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = []
        for parts, n in ((3, 4), (11, 9)):
            out = m.mix_sources(df.repartition(parts), {}, epochs=2.0, seed="order", partitions=n)
            assert out.rdd.getNumPartitions() == n
            seen.append([tuple(r) for r in out.collect()])
            equal = [sum(r["doc_id"] == 7 for r in part) for part in out.rdd.glom().collect()]
            assert min(equal) > 0.5 * sum(equal) / n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] == seen[1]


def test_many_copies_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 7)
    df = spark.createDataFrame([(i, f"t{i}", "rare" if i < 3 else "s", "c", i) for i in range(60)], DOCS)
    out = m.mix_sources(df, {"rare": 0.9}, epochs=20.0).collect()
    copies = {}
    for r in out:
        copies.setdefault(r["doc_id"], []).append(r["copy_no"])
    assert max(map(len, copies.values())) > 100 and all(sorted(v) == list(range(len(v))) for v in copies.values())


def test_copies_are_numbered_and_shuffled(spark):
    rows = m.mix_sources(docs(spark, 600), {"hot": 0.9}).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], set()).add(r["copy_no"])
    assert all(v == set(range(len(v))) for v in seen.values())
    assert len({r["shuffle_key"] for r in rows}) == len(rows)
    keys = [r["shuffle_key"] for r in rows]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["shuffle_key"])]
    assert keys and order != sorted(order)


def test_nulls_ties_empty_and_clashes(spark):
    rows = [(None, None, None, None, None), (None, "a", "hot", "x", 1), (1, "", "hot", "x", 1), (1, "", "hot", "x", 1), (2, "b", None, "x", 2)]
    df = spark.createDataFrame(rows, DOCS)
    out = m.mix_sources(df, {"hot": 0.5}, epochs=6.0)
    assert set(out.columns) == {"doc_id", "text", "source", "u_", "copy_no", "shuffle_key"}
    counts = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert counts[1, ""] % 2 == 0  # repeated rows draw alike
    assert m.mix_sources(df.limit(0), {"hot": 0.5}).count() == 0
    assert m.mix_sources(df, {}).columns == out.columns
    with pytest.raises(ValueError):
        m.mix_sources(df, {"a": 0.8, "b": 0.4})


def test_copy_columns_can_be_renamed(spark):
    out = m.mix_sources(docs(spark, 50), {"hot": 0.5}, copy_no="n1", shuffle_key="k1")
    assert out.columns == ["doc_id", "text", "source", "copy_no", "u_", "n1", "k1"]
