"""Quality rules: text statistics, and a decision list learned from labelled statistics.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the labelled
rows by information gain, pruned on the other third from its end, and kept while it is precise
there; the rows it covers leave and the next rule is learned. The list is emitted as one ordered
Spark conditional expression over the statistics; the first rule that holds rejects the row.

Defined results: a null or empty text has zeros for all statistics and fails the base test;
repeated rows get equal verdicts; of labelled rows that repeat a doc_id with other texts one
counts, whatever the partitions; very long texts are taken whole, a block each; without labelled rows of both classes no rule is learned and
the base test alone decides; an empty table gives no rows. ``with_stats`` keeps input columns
and adds one struct column; clashing names get an underscore more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import tokens
from logloom.llm.common import bounded_batches, free_name, integer, materialize, table

WINDOW = 5
#: Labelled rows that the rules are learned from, the first by a hash of doc_id.
MAX_LABELLED = 20_000
BASE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_STATS = ("n_lines", "n_upper", "n_alpha", "n_marks", "n_distinct")
STATS = BASE_STATS + MORE_STATS
STATS_TYPE = T.StructType([T.StructField(x, T.LongType()) for x in STATS])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:_=+~^@{}\\/")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True


def _dup_lines(text: bytes) -> tuple[int, int]:
    seen, dup, n = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(tokens.SPACES):
            n += 1
            dup += line in seen
            seen.add(line)
    return n, dup


def block_stats(block: tokens.Block) -> np.ndarray:
    """One row of STATS for each text of the block."""
    out = np.zeros((block.n, len(STATS)), np.int64)
    col = {x: i for i, x in enumerate(STATS)}
    data = block.data
    w = tokens.words(block)
    out[:, col["n_words"]] = np.diff(w.first)
    out[:, col["word_chars"]] = tokens.counts_by_row(block, ~tokens.IS_SPACE[data] & ((data & 0xC0) != 0x80))
    for name, flags in (("n_symbols", _SYMBOL), ("n_marks", _MARK), ("n_upper", _UPPER), ("n_alpha", _ALPHA)):
        out[:, col[name]] = tokens.counts_by_row(block, flags[data])
    for i in range(block.n):
        out[i, col["n_lines"]], out[i, col["n_dup_lines"]] = _dup_lines(data[block.offsets[i] : block.offsets[i + 1]].tobytes())
    h = tokens.word_hashes(data, w.start, w.end)
    own = tokens.mix(h ^ tokens.mix(w.row.astype(np.uint64)))
    order = np.argsort(own)
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[order][1:] != own[order][:-1]
    out[:, col["n_distinct"]] = np.bincount(w.row[order][fresh], minlength=block.n)
    at = tokens.within_rows(w, WINDOW)
    keys = tokens.mix(tokens.window_hashes(h, WINDOW)[at] ^ tokens.mix(w.row[at].astype(np.uint64)))
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    out[:, col["n_repeat_words"]] = np.bincount(w.row[covered], minlength=block.n)
    return out


@F.arrow_udf(STATS_TYPE)
def text_stats(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrow arrays, not pandas: texts stay in their buffers and make no Python strings."""
    for column in texts:
        parts = [block_stats(b) for b in tokens.blocks(column)]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(STATS)), np.int64)
        tokens.release()
        yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATS))], names=list(STATS))


def with_stats(df: DataFrame, out: str = "stats", text: str = "text") -> DataFrame:
    """df with the struct column ``out`` of STATS."""
    bounded_batches(df.sparkSession)
    return df.withColumn(out, text_stats(F.coalesce(F.col(text), F.lit(""))))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def features(stats: Column) -> dict[str, Column]:
    """What thresholds are set on: sizes and ratios, 0 where the divisor is."""
    ratio = lambda a, b: F.when(stats[b] > 0, stats[a].cast("double") / stats[b]).otherwise(F.lit(0.0))
    return {
        "words": stats["n_words"].cast("double"),
        "chars_per_word": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "marks_per_word": ratio("n_marks", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeated": ratio("n_repeat_words", "n_words"),
        "upper": ratio("n_upper", "n_alpha"),
        "distinct": ratio("n_distinct", "n_words"),
        "words_per_line": ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Adds the condition of the largest gain until no good row is covered; of equal gains the one in the widest gap."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0:
            break
        info0, best = np.log2(p0 / (p0 + n0)), (1e-9, -1.0, None)
        for name, v in x.items():
            own = v[inside]
            order = np.argsort(own)
            values, at = np.unique(own[order], return_index=True)
            at = np.append(at[1:], len(own))[:-1]  # rows up to each value but the last
            gap = np.diff(values)
            cuts = values[:-1] + gap / 2
            if not len(cuts):
                continue
            pos = np.concatenate([[0], np.cumsum(bad[inside][order])])[at]
            neg = at - pos
            for above, p, n in ((False, pos, neg), (True, p0 - pos, n0 - neg)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - info0), -1.0)
                top = np.flatnonzero(gain >= gain.max() - 1e-9)
                i = int(top[np.argmax(gap[top])])
                margin = float(gap[i] / (values[-1] - values[0]))
                if gain[i] > best[0] + 1e-9 or gain[i] > best[0] - 1e-9 and margin > best[1]:
                    best = (gain[i], margin, Condition(name, above, float(cuts[i])))
        if best[2] is None:
            break
        rule.append(best[2])
        inside &= best[2].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, int]:
    """The prefix of rule that tells the classes apart best on the pruning rows."""
    best = ((), -2.0, 0, 0)
    for k in range(1, len(rule) + 1):
        inside = _covers(rule[:k], x, len(bad))
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[1]:
            best = (rule[:k], worth, p, n)
    return best[0], best[2], best[3]


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, most_aside: int = 3) -> list[Rule]:
    """fold: 0 and 1 grow rules, 2 prunes them. Each kept rule is that precise on what it covers of fold 2.

    The bad rows of a rule that is not are set aside, so that others can still be learned, up to
    ``most_aside`` times; each time more rows of fold 2 must speak for a rule.
    """
    rules: list[Rule] = []
    left, aside, failed = np.ones(len(bad), bool), np.zeros(len(bad), bool), 0
    while len(rules) < most_rules and failed <= most_aside:
        grow, prune = left & (fold != 2) & ~aside, left & (fold == 2)
        if not (bad & grow).any() or not (bad & prune).any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        rule, p, n = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        covered = _covers(rule, x, len(bad)) & grow & bad if rule else np.zeros(len(bad), bool)
        if rule and p >= 2 + 3 * failed and p >= precision * (p + n):
            rules.append(rule)
            left &= ~_covers(rule, x, len(bad))
        elif covered.any():
            aside |= covered
            failed += 1
        else:
            break
    return rules


def kept(rules: list[Rule], stats: Column) -> Column:
    """The decision list as one ordered conditional: the base test, each rule, then keep."""
    x = features(stats)
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        cond = F.lit(True)
        for c in rule:
            cond = cond & ((x[c.feature] > F.lit(c.threshold)) if c.above else (x[c.feature] <= F.lit(c.threshold)))
        out = out.when(cond, F.lit(False))
    return out.otherwise(F.lit(True))


def labelled_sample(labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """doc_id and label of ``most`` documents at most, the first by a hash; of several labels of a document the lowest counts."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(label).cast("int").alias("label_"))
    return one.withColumn("order_", integer("quality-rules", F.col("doc_id").cast("string"))).orderBy("order_", "doc_id").limit(most)


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", stats: str | None = "stats", most: int = MAX_LABELLED) -> list[Rule]:
    """Rules that find label 0 among the statistics of the labelled rows.

    rows has doc_id and the struct column ``stats``, or where that is None text, of which the
    statistics are then made for labelled rows alone. The sample has ``most`` documents at most,
    so it is broadcast, and its statistics come to the driver.
    """
    own = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(stats or "text").alias("stats" if stats else "text"))
    own = own.join(F.broadcast(labelled_sample(labels, label, most)), "doc_id")
    # of rows that repeat a doc_id the one of the smallest digest, or the smallest statistics
    if stats:
        own = own.groupBy("doc_id", "order_", "label_").agg(F.min("stats").alias("stats"))
    else:
        own = own.groupBy("doc_id", "order_", "label_").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")).alias("first"))
        own = with_stats(own.select("doc_id", "order_", "label_", F.col("first.text").alias("text")))
    x = features(F.col("stats"))
    got = own.filter(~base_failed(F.col("stats"))).select("order_", "doc_id", "label_", *[v.alias(k) for k, v in x.items()]).toPandas()
    if got.empty:
        return []
    got = got.sort_values(["order_", "doc_id"])
    return learn_rules({k: got[k].to_numpy(float) for k in x}, (got["label_"] == 0).to_numpy(), (got["order_"] % 3).to_numpy())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = materialize(with_stats(docs).drop("text"))
    rules = fit(rows, table(spark, sf_dir, "labels"))
    stats = F.col("stats")
    return rows.select("doc_id", *[stats[x].alias(x) for x in BASE_STATS], base_failed(stats).alias("base_failed"), kept(rules, stats).alias("kept"))


def reject_bad(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base test and the learned rules keep, with the columns of docs."""
    rules = fit(docs, labels, stats=None)
    name = free_name(docs, "stats")
    return with_stats(docs, name).filter(kept(rules, F.col(name))).drop(name)
