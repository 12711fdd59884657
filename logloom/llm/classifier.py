"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network.

A text's tokens are runs of letters and digits, lower-cased, and runs of other characters than
white space; words in capitals count as a token more. Tokens are hashed to VOCABULARY rows. Each
row has a fixed sparse ternary index vector; its word vector adds the normalised sum of the index
vectors met REACH tokens to each side in any document that is not held out. A document is the mean of its tokens'
vectors, with the mean's length, the likeness of neighbours and the text's size beside. A tanh
layer and a logistic unit, trained with numpy, score it, and a temperature fitted on rows that
were not trained on calibrates the probabilities.

Network and temperature are fitted on MAX_SAMPLE labelled rows at most, the first by a hash of
doc_id. They and the vectors, which need no label, are never fitted on rows whose crc32(doc_id as
text) mod 5 is 0: those are held out. Every whole text is scored.

Defined results: null and empty texts are scored as a mean of zeros; a null doc_id is held out;
without labelled rows of both classes every score is the share of label 1, or 0.5 without any;
of labelled rows that repeat a doc_id with other texts one counts, whatever the partitions; repeated
rows get equal scores; very long texts are worked off in pieces; an empty table gives no rows; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import tokens
from logloom.llm.common import bounded_batches, integer, materialize, table

DIM, VOCABULARY = 64, 1 << 14
NONZERO, REACH = 6, 2
MAX_SAMPLE = 8_000
PARTS = 4
#: The table of sums is shuffled in so many slices of its rows.
SLICES = 16
#: Pairs of neighbours that are counted at once.
_PAIRS = 1 << 21
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 80, 64, 0.005, 1e-4
THRESHOLD = 0.3
SEED = 7
FEATURES = DIM + 3
_BLOCK = 1 << 20
#: Tokens of a text that are summed as one, and tokens whose vectors are taken at once.
_SEGMENT, _TOKENS = 4096, 1 << 16
_CLASS = np.zeros(256, np.uint8)  # 0 white space, 1 word, 2 other
for _b in range(256):
    _CLASS[_b] = 0 if tokens.IS_SPACE[_b] else 1 if _b >= 128 or chr(_b).isalnum() else 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
CAPITALS = 0


def index_vectors() -> np.ndarray:
    """NONZERO entries of +1 or -1 in each row."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((VOCABULARY, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out / np.sqrt(NONZERO)


def token_ids(block: tokens.Block) -> tuple[np.ndarray, np.ndarray]:
    """Row and vocabulary row of each token of a block, in order."""
    kind = _CLASS[block.data]
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[block.offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    some = kind[start] > 0
    start, end = start[some], end[some]
    ids = 1 + (tokens.word_hashes(tokens.LOWER[block.data], start, end) % np.uint64(VOCABULARY - 1)).astype(np.int64)
    row = np.searchsorted(block.offsets, start, "right") - 1
    upper = np.append(0, np.cumsum(_UPPER[block.data]))
    loud = (upper[end] - upper[start] == end - start) & (end - start > 1)
    order = np.argsort(np.concatenate([2 * np.arange(len(ids)), 2 * np.flatnonzero(loud) + 1]), kind="stable")
    ids = np.concatenate([ids, np.full(int(loud.sum()), CAPITALS)])[order]
    return np.concatenate([row, row[loud]])[order], ids


def text_pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """lo, hi, row (from lo), token ids, and whether the piece goes on in the same text, of blocks of rows.

    A longer text is cut behind white space into pieces of about _BLOCK bytes; where it is cut depends
    on the text alone.
    """
    for b in tokens.blocks(column, limit=_BLOCK):
        if len(b.data) <= 2 * _BLOCK or b.n > 1:
            yield b.lo, b.hi, *token_ids(b), False
            continue
        spaces = np.flatnonzero(tokens.IS_SPACE[b.data])
        at = 0
        while at < len(b.data):
            k = int(np.searchsorted(spaces, at + _BLOCK))
            end = int(spaces[k]) + 1 if k < len(spaces) else len(b.data)
            yield b.lo, b.hi, *token_ids(tokens.Block(0, 1, b.data[at:end], np.array([0, end - at]))), at > 0
            at = end


class ContextSums:
    """Sums, for each vocabulary row, the index vectors of its neighbours in the same text, in whole multiples of their entries."""

    def __init__(self) -> None:
        index = index_vectors()
        self.at = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
        self.sign = np.sign(np.take_along_axis(index, self.at, axis=1)).astype(float)
        self.total = np.zeros(VOCABULARY * DIM)
        self.codes: list[np.ndarray] = []
        self.waiting = 0

    def add(self, row: np.ndarray, ids: np.ndarray, skip: int = 0) -> None:
        """Pairs whose second token is one of the first ``skip`` were counted before."""
        for step in range(1, REACH + 1):
            same = np.flatnonzero(row[step:] == row[:-step])
            same = same[same + step >= skip]
            self.codes.append((ids[same] * VOCABULARY + ids[same + step]).astype(np.int32))
            self.waiting += len(same)
        if self.waiting >= _PAIRS:
            self.flush()

    def flush(self) -> None:
        """Distinct pairs are counted first, then added once."""
        code = np.sort(np.concatenate([*self.codes, np.zeros(0, np.int32)]))
        self.codes, self.waiting = [], 0
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(code)))
        a, b = np.divmod(code[first].astype(np.int64), VOCABULARY)
        for own, other in ((a, b), (b, a)):
            for j in range(NONZERO):
                self.total += np.bincount(own * DIM + self.at[other, j], n * self.sign[other, j], len(self.total))

    def table(self) -> np.ndarray:
        self.flush()
        return self.total.reshape(VOCABULARY, DIM)


class Pool:
    """Sums over the tokens of n_rows texts, in segments that depend on each text alone, a bounded number of tokens at a time."""

    def __init__(self, vectors: np.ndarray, n_rows: int) -> None:
        self.vectors = vectors
        self.n = np.zeros(n_rows, np.int64)
        self.total = np.zeros((n_rows, DIM))
        self.alike = np.zeros(n_rows)
        self.last: int | None = None

    def add(self, row: np.ndarray, ids: np.ndarray, goes_on: bool = False) -> None:
        """goes_on: the first row's text began in the tokens added before."""
        if not len(ids):
            return
        n = np.bincount(row, minlength=len(self.n))
        first = np.cumsum(n) - n
        rank = np.arange(len(ids)) - first[row]
        starts = np.flatnonzero(rank % _SEGMENT == 0)
        bounds = np.append(starts, len(ids))
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _TOKENS, "right")) - 1)
            lo, hi = bounds[i], bounds[j]
            own = self.vectors[ids[lo:hi]]
            np.add.at(self.total, row[starts[i:j]], np.add.reduceat(own, starts[i:j] - lo, axis=0).astype(float))
            before = ids[lo - 1] if lo else self.last if goes_on else ids[0]
            both = np.einsum("ij,ij->i", own, np.concatenate([self.vectors[[before]], own[:-1]])).astype(float)
            both[rank[lo:hi] == 0] = 0
            if goes_on and lo == 0:
                both[0] = float(np.einsum("j,j->", own[0], self.vectors[before]))
            np.add.at(self.alike, row[starts[i:j]], np.add.reduceat(both, starts[i:j] - lo))
            i = j
        self.n += n
        self.last = int(ids[-1])

    def features(self) -> np.ndarray:
        out = np.zeros((len(self.n), FEATURES))
        has = np.flatnonzero(self.n)
        n = self.n[has]
        out[has, :DIM] = self.total[has] / n[:, None]
        out[has, DIM] = np.sqrt((out[has, :DIM] ** 2).sum(1))
        out[has, DIM + 1] = self.alike[has] / n
        out[has, DIM + 2] = np.log1p(n) / 5
        return out


def text_features(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(column), FEATURES))
    pool, at = None, None
    for lo, hi, row, ids, goes_on in text_pieces(column):
        if not goes_on:
            if pool is not None:
                out[at] = pool.features()
            pool, at = Pool(vectors, hi - lo), slice(lo, hi)
        pool.add(row, ids, goes_on)
    if pool is not None:
        out[at] = pool.features()
    tokens.release()
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the mean log loss with weight decay."""
    rng = np.random.default_rng(SEED)
    net = Network(x.mean(0), x.std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // BATCH)):
            hidden = np.tanh(z[at] @ params[0] + params[1])
            d = (_sigmoid(hidden @ params[2] + params[3][0]) - y[at]) / len(at)
            back = np.outer(d, params[2]) * (1 - hidden**2)
            grads = [z[at].T @ back + DECAY * params[0], back.sum(0), hidden.T @ d + DECAY * params[2], np.array([d.sum()])]
            t += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of least log loss, by golden section over its logarithm.

    Against Platt's targets, one row more of each class than there is, so that rows which are told
    apart without an error do not make scores so sure that they round to 1 and lose their order.
    """
    ones = int((y > 0).sum())
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    loss = lambda s: np.mean(np.logaddexp(0, logits / np.exp(s)) - target * logits / np.exp(s))
    lo, hi, g = -2.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    """vectors: of each vocabulary row. Without a network every score is ``share``."""

    vectors: np.ndarray
    network: Network | None
    share: float = 0.5

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), self.share)
        return self.network.scores(text_features(column, self.vectors))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


_SUMS = "slice int, rows binary, sums binary"


def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a table of sums that are not 0, by slice."""
    some = np.flatnonzero(total.any(1))
    for k in np.unique(some % SLICES):
        rows = some[some % SLICES == k]
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([rows.astype(np.int32).tobytes()], pa.binary()), pa.array([total[rows].astype(np.int64).tobytes()], pa.binary())], names=["slice", "rows", "sums"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = ContextSums()
    for batch in batches:
        tail = np.zeros(0, np.int64)
        for _, _, row, ids, goes_on in text_pieces(batch.column(0)):
            skip = len(tail) if goes_on else 0
            if skip:
                row, ids = np.append(np.zeros(skip, np.int64), row), np.append(tail, ids)
            sums.add(row, ids, skip)
            tail = ids[-REACH:]
        tokens.release()
    yield from _slices(sums.table())


def _add_sums(parts, total: np.ndarray) -> np.ndarray:
    for rows, sums in parts:
        total[np.frombuffer(rows, np.int32)] += np.frombuffer(sums, np.int64).reshape(-1, DIM)
    return total


def _merged_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((VOCABULARY, DIM), np.int64)
    for batch in batches:
        _add_sums(((r.as_py(), x.as_py()) for r, x in zip(batch.column(1), batch.column(2), strict=True)), total)
    yield from _slices(total)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vector of each vocabulary row, by the contexts of all rows of docs; one table of sums comes to the driver."""
    sums = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_sums, _SUMS)
    sums = sums.repartition(SLICES, "slice").mapInArrow(_merged_sums, _SUMS).collect()
    total = _add_sums(((r["rows"], r["sums"]) for r in sums), np.zeros((VOCABULARY, DIM), np.int64)).astype(float)
    norm = np.sqrt((total**2).sum(1, keepdims=True))
    return (index_vectors() + total / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_SAMPLE) -> Model:
    """The model of ``label``; features of ``most`` rows, and one table of sums, come to the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    one = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("bigint"))).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    one = one.withColumn("order_", integer("classifier", F.col("doc_id").cast("string"))).orderBy("order_", "doc_id").limit(most)
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(one), "doc_id")
    # of rows that repeat a doc_id the one of the smallest digest
    sample = sample.groupBy("doc_id", "y", "order_").agg(F.min(F.struct(F.md5("text").alias("digest"), "text")).alias("first")).select("doc_id", "y", "order_", F.col("first.text").alias("text"))
    sample = materialize(sample.repartition(PARTS, "doc_id").sortWithinPartitions("order_", "doc_id"))
    vectors = word_vectors(docs.filter(~held_out(F.col("doc_id").cast("bigint"))))

    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(3), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["order_", "doc_id", "y", "x"])

    rows = sample.select("order_", "doc_id", "y", "text").mapInArrow(features, "order_ long, doc_id long, y int, x array<double>").toPandas().sort_values(["order_", "doc_id"])
    if not len(rows):
        return Model(vectors, None)
    x, y, order = np.array(rows["x"].tolist()), rows["y"].to_numpy(float), rows["order_"].to_numpy()
    if y.min() == y.max():
        return Model(vectors, None, float(y.mean()))
    calibrate = order % 5 == 0
    if len(set(y[calibrate])) < 2 or len(set(y[~calibrate])) < 2:
        return Model(vectors, train(x, y))
    net = train(x[~calibrate], y[~calibrate])
    net.temperature = fit_temperature(net.logits(x[calibrate]), y[calibrate])
    return Model(vectors, net)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id").cast("bigint")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
