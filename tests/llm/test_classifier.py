import zlib

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import classifier as c

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    out = c.op5_classifier(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(out) == docs
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out, strict=True))
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    rows = out.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    rows = rows[rows.held_out]
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert np.mean([(g > bad).mean() for g in good]) > 0.9
    assert (good >= 0.3).mean() > 0.95


def test_scores_do_not_see_ids_or_other_columns(spark):
    text = ["some plain words of text"] * 3 + [None, ""]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(text)] + [(None, text[0], "de", None)], "doc_id long, text string, score string, held_out string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    model = c.fit(df, labels)
    out = c.score(df, model).collect()
    assert len(out) == 6
    assert len({r["score"] for r in out if r["doc_id"] in (0, 1, 2, None)}) == 1
    assert len({r["score"] for r in out if r["doc_id"] in (3, 4)}) == 1
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [True]
    assert c.score(df.limit(0), model).count() == 0


@pytest.mark.parametrize(("labels", "share"), [([], 0.5), ([(1, 1), (2, 1)], 1.0)])
def test_without_both_classes(spark, labels, share):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    model = c.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r["score"] for r in c.score(df, model).collect()} == {share}


def test_texts_are_pooled_alike_in_any_batch():
    texts = ["Word word, WORD!! x", None, "", " \n", "é è " * 300, "zz ** zz"]
    index = c.index_vectors()
    whole = c.text_features(pa.array(texts), index)
    single = np.concatenate([c.text_features(pa.array([t], pa.string()), index) for t in texts])
    assert (whole == single).all() and not whole[1:4].any()


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["word", "WORD", "ab", "x1", "--", "é", "zz,yy"]
    text = " ".join(rng.choice(words, 3000))
    texts = [text, "short", "u" * 5000 + " v", text + " end"]
    index = c.index_vectors()
    sums = c.ContextSums()
    for b in c.tokens.blocks(pa.array(texts)):
        sums.add(*c.token_ids(b))
    whole = c.text_features(pa.array(texts), index)
    monkeypatch.setattr(c, "_BLOCK", 700)
    monkeypatch.setattr(c, "_SEGMENT", 50)
    monkeypatch.setattr(c, "_TOKENS", 120)
    assert np.allclose(c.text_features(pa.array(texts), index), whole, atol=1e-5)
    got = np.zeros((c.VOCABULARY, c.DIM), np.int64)
    c._add_sums(((r.as_py(), x.as_py()) for b in c._sums(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for r, x in zip(b.column(1), b.column(2), strict=True)), got)
    assert (got == sums.table()).all()


def test_same_model_for_any_partitions_and_repeated_ids(spark):
    rows = [(i % 40, f"text {i} " + ("good words here" if i % 2 else "** bad ##") * (1 + i % 3)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [sorted(map(tuple, c.score(df, c.fit(df.repartition(n), labels)).select("doc_id", "score").collect())) for n in (1, 7)]
    assert scores[0] == scores[1]


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    p = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))
    y = (rng.random(3000) < p).astype(float)
    net = c.train(x[:2000], y[:2000])
    net.temperature = c.fit_temperature(net.logits(x[2000:2500]), y[2000:2500])
    s = net.scores(x[2500:])
    assert ((s > 0.5) == (p[2500:] > 0.5)).mean() > 0.85
    assert abs(s.mean() - y[2500:].mean()) < 0.06


def _vocabulary_rows(text):
    return next(iter(c.token_ids(b)[1] for b in c.tokens.blocks(pa.array([text]), limit=1 << 20)))


def test_contexts_come_from_all_rows_that_are_not_held_out(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:6]
    held = next(i for i in range(40) if not zlib.crc32(str(i).encode()) % 5)
    df = spark.createDataFrame([(ids[0], "one two"), (ids[1], "two one"), (ids[2], "three four three four"), (held, "five six")], "doc_id long, text string")
    model = c.fit(df, spark.createDataFrame([(ids[0], 0), (ids[1], 1)], "doc_id long, quality int"))
    index = c.index_vectors()
    assert not np.allclose(model.vectors[_vocabulary_rows("three four")], index[_vocabulary_rows("three four")])
    assert np.allclose(model.vectors[_vocabulary_rows("five six")], index[_vocabulary_rows("five six")])


def test_word_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "B", "CC", "dd", "e!", "--", "ff"], n)) for n in (0, 1, 2, 3, 40, 300)]
    index, total = c.index_vectors(), np.zeros((c.VOCABULARY, c.DIM))
    for t in texts[1:]:
        ids = _vocabulary_rows(t)
        for i, x in enumerate(ids):
            for j in range(max(0, i - c.REACH), min(len(ids), i + c.REACH + 1)):
                total[x] += index[ids[j]] * (i != j)
    norm = np.sqrt((total**2).sum(1, keepdims=True))
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    assert np.allclose(c.word_vectors(df), index + total / np.where(norm > 0, norm, 1), atol=1e-5)


def test_scores_keep_their_order_where_calibration_has_no_errors():
    logits = np.array([-9.0, -8, -7, 6, 8, 9] * 8)
    y = (logits > 0).astype(float)
    z = np.linspace(-9, 9, 40) / c.fit_temperature(logits, y)
    assert (np.diff(c._sigmoid(z)) > 0).all()
