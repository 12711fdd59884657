import re
from collections import Counter

import __spark_entry__
import corpus_pipeline as cp
from oracle import connect

from logloom.llm import decontaminate, mixing, ngram_join, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passes(text, rules):
    """The base test and the learned rules, on counts made word by word."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    if len(words) < 10 or 100 * len(covered) > 20 * len(words):
        return False
    letters = re.findall("[A-Za-z]", text)
    ratio = lambda a, b: a / b if b else 0.0
    x = {
        "words": float(len(words)),
        "chars_per_word": sum(map(len, words)) / len(words),
        "symbols_per_word": len(re.findall(r"[#*$%&|<>]", text)) / len(words),
        "marks_per_word": len(re.findall(r"[!?;:_=+~^@{}\\/]", text)) / len(words),
        "dup_lines": ratio(len(lines) - len(set(lines)), len(lines)),
        "repeated": len(covered) / len(words),
        "upper": ratio(sum(c.isupper() for c in letters), len(letters)),
        "distinct": len(set(words)) / len(words),
        "words_per_line": ratio(len(words), len(lines)),
    }
    return not any(all(x[c.feature] > c.threshold if c.above else x[c.feature] <= c.threshold for c in rule) for rule in rules)


def test_rows_equal_brute_force(spark, sf_dir):
    """Every stage stated anew: counts word by word, then SQL that tries all pairs, all alignments, all copies and the tree."""
    con = connect(sf_dir)
    con.execute(f"CREATE TABLE docs AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM docs")
    assert con.execute("SELECT count(*) = count(DISTINCT doc_id) FROM docs").fetchone()[0]

    def keep(sql):
        con.execute(f"CREATE TABLE next_ AS {sql}")
        before, after = (con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("docs", "next_"))
        con.execute("DROP VIEW documents; DROP TABLE docs; ALTER TABLE next_ RENAME TO docs; CREATE VIEW documents AS SELECT * FROM docs")
        return before, after

    rules = quality_rules.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), stats=None)
    good = [i for i, t in con.execute("SELECT doc_id, text FROM docs").fetchall() if passes(t, rules)]
    dropped = [
        keep(f"SELECT * FROM docs WHERE doc_id IN ({', '.join(map(str, good))})"),
        keep(f"SELECT * FROM docs WHERE doc_id IN (SELECT doc_id FROM ({ngram_join.oracle_sql()}) WHERE n_shingles = 0 OR doc_id = component_id)"),
        keep(f"SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM ({decontaminate.oracle_sql()}))"),
    ]
    assert all(a > b > 0 for a, b in dropped)
    keep(f"SELECT * EXCLUDE (copy_no, shuffle_key) FROM ({mixing.sql_mix('docs')})")
    want = con.execute(sharding.sql_shard(sharding.build_tree(sharding.N_SHARDS), "docs", "doc_id::VARCHAR", "shard")).fetchall()
    columns = [c[0] for c in con.description]
    got = cp.run(spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def test_stages_take_effect_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "ngram_join", "decontaminate", "mixing", "sharding"]
    now, columns = docs, docs.columns
    ids = lambda df: Counter(r[0] for r in df.select("doc_id").collect())
    kept = ids(quality_rules.op7_quality_rules(spark, sf_dir).filter("kept"))
    for name, stage in cp.STAGES:
        before, now = now, stage(spark, now, sf_dir)
        now = spark.createDataFrame(now.collect(), now.schema)
        assert now.columns == columns + ["shard"] * (name == "sharding")
        if name == "quality_rules":
            assert ids(now) == kept
        elif name == "ngram_join":
            groups = ngram_join.similar_documents(before).filter("n_shingles > 0").select("component_id").distinct().count()
            assert now.count() == groups + ngram_join.similar_documents(before).filter("n_shingles = 0").count()
        elif name == "decontaminate":
            bad = ids(decontaminate.find_contamination(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
            assert set(ids(now)) == set(ids(before)) - set(bad)
        elif name == "mixing":
            assert ids(now) == ids(mixing.mix_sources(before))
        else:
            assert now.count() == before.count() and now.filter("shard not between 0 and 39").count() == 0
    assert sorted(map(repr, now.collect())) == sorted(map(repr, cp.run(spark, sf_dir).collect()))


def test_nulls_repeats_and_clashing_columns(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, None, None, None, None, 1, "a"), (None, text, "en", "s", 5, None, None), (1, text, "en", "src0", 5, 2, "b"), (1, text, "en", "src0", 5, 2, "b"), (2, "", "en", "src1", 0, 3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, copy_no string")
    now = docs
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), now.schema)
    out = cp.STAGES[-1][1](spark, now, sf_dir)
    assert out.columns == [*docs.columns, "shard_"]
    assert all(r["doc_id"] == 1 for r in out.collect())
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {"pipeline"} | {f"op{i}_" for i in range(1, 11)} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in names}
    assert "pipeline" not in __spark_entry__.oracle_sql()
    assert sharding.N_SHARDS == 40
