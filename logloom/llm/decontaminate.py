"""Benchmark decontamination by spaced-seed hashing, with DataFrame and SQL functions only.

Texts become lower-case runs of letters and digits, each hashed. A fixed mask laid at a word
hashes the words under its ones and ignores the others, so a seed survives substitutions there.
The masks together fit into every placement of the equal words that the rule below asks for.
Seeds of documents are joined to seeds of benchmark items; an equal seed proposes to align the
two texts there. Each distinct alignment is verified over the whole item: it is a leak when of
some WINDOW aligned words NEED are equal (for shorter items, that share of the item).

A bitmap of bounded size tells which words the benchmark has; a document's seed is made only where
it has all words under the mask's ones, as no other can be equal to one of the benchmark. The
benchmark's seeds are broadcast up to BROADCAST_SEEDS of them, which are counted first, so
documents' seeds meet them in the scan and are never shuffled; more are joined by shuffle.
Alignments are few, and bring the words of their documents alone by a join on the row's key.

Defined results: null and empty texts have no seeds and are clean; items of fewer than
MIN_WORDS words are no evidence and match nothing; a null item_id is reported as null; repeated
documents count as one by doc_id (the largest value of each result counts), and rows with a null
doc_id by their text; very long texts are taken whole, as one array of hashes; an empty benchmark leaves all documents clean. Other columns are kept by
``drop_contaminated`` and otherwise ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import free_name, materialize, row_key, table

#: Ones are the words that a seed hashes. One of them fits into every placement of NEED equal words in
#: WINDOW, and of a shorter item's share: no leak is missed.
MASKS = ("11011001", "11010110", "11010011", "11111", "101000111")
#: Cells of one byte each, at least and at most; between, CELLS_PER_WORD for each word of the benchmark.
LEAST_CELLS, MOST_CELLS, CELLS_PER_WORD = 1 << 14, 1 << 20, 16
WINDOW, NEED = 13, 10
MIN_WORDS = 8
BROADCAST_SEEDS = 500_000


def _let(value: Column, body) -> Column:
    """body(value) with value made once; a plain projection would be copied into each lambda that uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def word_ids(text: Column) -> Column:
    """The hashed words of a text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _cell(word: Column, cells: int) -> Column:
    return F.shiftrightunsigned(word, 32).bitwiseAND(cells - 1).cast("int")


def vocabulary(items: DataFrame, ids: str) -> bytes:
    """The bitmap of the words of ids, of a size that follows their number up to MOST_CELLS bytes; as many rows at most come to the driver."""
    words = items.select(F.explode_outer(ids).alias("w")).filter("w is not null")
    n = words.agg(F.approx_count_distinct("w")).first()[0]
    cells = bytearray(min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_PER_WORD * n).bit_length())))
    for r in words.select(_cell(F.col("w"), len(cells)).alias("at")).distinct().collect():
        cells[r["at"]] = 1
    return bytes(cells)


def seed_rows(df: DataFrame, ids: str, *keep: str, known: bytes | None = None) -> DataFrame:
    """keep, pos and seed of each seed of each row; with ``known`` only where the bitmap has all words that the seed hashes."""

    def places(words: Column) -> Column:
        def at(first: Column, i: Column) -> Column:
            def seed(k: int, mask: str) -> Column:
                ones = [F.get(words, i + j) if j else first for j, c in enumerate(mask) if c == "1"]
                # null past the end and for words that are not known
                return F.when(reduce(and_, [w.isNotNull() for w in ones[1:]]), F.xxhash64(F.lit(k), *ones))

            seeds = F.array(*[seed(k, m) for k, m in enumerate(MASKS)])
            return F.when(first.isNotNull(), F.struct(i.alias("pos"), F.filter(seeds, lambda x: x.isNotNull()).alias("seeds")))

        return F.filter(F.transform(words, at), lambda x: F.size(x["seeds"]) > 0)

    words = F.col(ids)
    if known is not None:
        words = F.transform(words, lambda w: F.when(F.substring(F.lit(known), _cell(w, len(known)) + 1, F.lit(1)) == F.lit(b"\x01"), w))
    # outer: else the optimizer tests the size of what is exploded, and so makes it twice
    rows = df.select(*keep, F.explode_outer(_let(words, places)).alias("s_")).filter("s_ is not null")
    return rows.select(*keep, F.col("s_.pos").alias("pos"), F.explode_outer("s_.seeds").alias("seed"))


def _best(same: Column) -> Column:
    """The most equal words of any WINDOW consecutive ones, or of all where they are fewer."""

    def of(same: Column) -> Column:
        last = F.greatest(F.size(same) - WINDOW, F.lit(0))
        return F.array_max(F.transform(F.sequence(F.lit(0), last), lambda j: F.aggregate(F.slice(same, j + 1, WINDOW), F.lit(0), lambda s, x: s + x)))

    return _let(same, of)


def find_contamination(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """key (of the document's row), doc_id, item_id, n_equal (most equal words of a window) and n_alignments of each leak."""
    items = benchmark.select("item_id", word_ids(F.col("text")).alias("item_ids")).filter(F.size("item_ids") >= MIN_WORDS)
    items = materialize(items.withColumn("item_no", F.monotonically_increasing_id()))
    seeds = materialize(seed_rows(items, "item_ids", "item_no").withColumnRenamed("pos", "item_pos"))
    small = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = vocabulary(items, "item_ids")
    found = seed_rows(rows.select("key", word_ids(F.col("text")).alias("ids")), "ids", "key", known=known).join(F.broadcast(seeds) if small else seeds, "seed")
    aligned = materialize(found.select("key", "item_no", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    items = F.broadcast(items) if small else items
    pairs = rows.join(aligned, "key").join(items, "item_no")

    def equal_words(ids: Column) -> Column:
        return F.transform("item_ids", lambda x, j: F.when(j + F.col("shift") >= 0, F.coalesce((F.get(ids, j + F.col("shift")) == x).cast("int"), F.lit(0))).otherwise(0))

    same = _let(word_ids(F.col("text")), equal_words)
    need = F.least(F.lit(NEED), F.ceil(F.size("item_ids") * (NEED / WINDOW)).cast("int"))
    leaks = pairs.select("key", "doc_id", "item_id", "shift", need.alias("need"), _best(same).alias("n_equal")).filter(F.col("n_equal") >= F.col("need"))
    return leaks.groupBy("key", "doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"), F.countDistinct("shift").alias("n_alignments"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with the columns of docs."""
    leaks = materialize(find_contamination(docs, benchmark).select("key").distinct())
    key = free_name(docs, "key")
    return docs.withColumn(key, row_key()).join(leaks.withColumnRenamed("key", key), key, "left_anti").drop(key)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def sql_leaks(source: str) -> str:
    """DuckDB SQL: key, doc_id, item_id, n_equal and n_alignments of each leak in the relation source, by every alignment that shares words, without seeds."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    need = f"least({NEED}, ceil(len(bt) * {NEED / WINDOW!r}::DOUBLE))"
    return f"""WITH dt AS (SELECT row_number() OVER () AS d, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS key, doc_id::BIGINT AS doc_id, {words} AS dt FROM {source}),
bt AS (SELECT row_number() OVER () AS i, item_id, {words} AS bt FROM benchmark WHERE len({words}) >= {MIN_WORDS}),
bw AS (SELECT i, unnest(bt) AS w, unnest(range(0, len(bt))) AS q FROM bt),
dw AS (SELECT d, w, p FROM (SELECT d, unnest(dt) AS w, unnest(range(0, len(dt))) AS p FROM dt) WHERE w IN (SELECT w FROM bw)),
shifts AS (SELECT d, i, p - q AS shift, count(*) AS n FROM dw JOIN bw USING (w) GROUP BY ALL),
hits AS (SELECT key, doc_id, item_id, dt, bt, shift FROM shifts JOIN bt USING (i) JOIN dt USING (d) WHERE n >= {need}),
same AS (SELECT *, list_transform(range(0, len(bt)), lambda j: CASE WHEN j + shift >= 0 AND j + shift < len(dt) AND dt[j + shift + 1] = bt[j + 1] THEN 1 ELSE 0 END) AS m FROM hits),
best AS (SELECT *, list_max(list_transform(range(0, greatest(len(bt) - {WINDOW}, 0) + 1), lambda j: list_sum(list_slice(m, j + 1, j + {WINDOW})))) AS n_equal FROM same)
SELECT key, doc_id, item_id, max(n_equal)::INTEGER AS n_equal, count(DISTINCT shift)::BIGINT AS n_alignments FROM best
WHERE n_equal >= {need} GROUP BY key, doc_id, item_id"""


def oracle_sql() -> str:
    return f"SELECT * EXCLUDE (key) FROM ({sql_leaks('documents')})"
