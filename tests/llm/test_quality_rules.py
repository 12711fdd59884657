import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import quality_rules as q
from logloom.llm import tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)]


def stats(texts):
    return np.concatenate([q.block_stats(b) for b in tokens.blocks(pa.array(texts, pa.string()))])[:, :5].tolist()


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet="ab \n\t\xa0é#|\x1c😀", max_size=60), min_size=1, max_size=6))
def test_stats_equal_brute_force(texts):
    assert stats(texts) == [brute(t) for t in texts]


def test_stats_of_edge_texts():
    texts = [None, "", "  \n ", "a b c d e f " * 4000, "x" * 100_000, "a\nb\na\n\n \na"]
    assert stats(texts) == [brute(t) for t in texts]


def test_rules_find_noise_and_keep_clean(spark):
    rows = []
    for i in range(600):
        words = [f"w{(i * 7 + j * 13) % 997}x{j}" for j in range(40)]
        if i % 4 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(600)], "doc_id long, quality int")
    out = q.reject_bad(docs, labels)
    assert out.columns == ["doc_id", "text", "stats"]
    assert sorted(r[0] for r in out.select("doc_id").collect()) == [i for i in range(600) if i % 4]


def test_without_labels_the_base_test_decides(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, " ".join(f"w{i}" for i in range(30))), (None, None), (3, "u v w x y " * 9)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r[0] for r in q.reject_bad(docs, labels).collect()] == [2]
    assert q.reject_bad(docs.limit(0), labels).count() == 0


def test_query(spark, sf_dir):
    out = {r["doc_id"]: r for r in q.op7_quality_rules(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        r = out[d["doc_id"]]
        n, *rest = want = brute(d["text"])
        assert [r[x] for x in q.BASE_STATS] == want
        assert r["base_failed"] == (n < 10 or 100 * want[4] > 20 * n)
        assert not (r["base_failed"] and r["kept"])
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    kept = [out[r["doc_id"]]["kept"] for r in good if r["quality"] == 1]
    lost = [out[r["doc_id"]]["kept"] for r in good if r["quality"] == 0 and not out[r["doc_id"]]["base_failed"]]
    assert np.mean(kept) > 0.9
    assert not lost or np.mean(lost) < 0.5
