"""Sharding by a hierarchical weighted hash tree, with DataFrame operations only.

A row descends region, rack and shard levels. At each level every child draws
``-ln(u) / weight`` with u hashed from (seed, path of the child, row key), and the smallest
draw wins, so a child gets rows in proportion to its weight. A changed weight alters the
draws of that child alone: rows move only into or out of its subtree. ``grown`` adds a shard
as a region of its own with that shard's weight, so all moved rows enter the new shard;
``build_tree`` adds its shards beyond N_SHARDS in the same way, so that count alone decides.

Defined results: a null doc_id draws by the digest of its text; a null text has size 16 and
CRC 0; repeated rows land in one shard with a slot each, and are one row until then; a text of
any length is hashed where it is read and goes no further; an empty table gives no rows; input
columns beyond doc_id and text are ignored by ``shard_report`` and kept by ``assign_shards``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import free_name, integer, materialize, row_key, table, uniform

SEED = "shards-1"
N_SHARDS = 40
RACKS, SHARDS_PER_RACK = 4, 5
#: Rows of a shard are numbered in this many independent pieces.
SLOT_PIECES = 64
#: Equal rows that one task numbers.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Node:
    """A leaf carries a shard id; an inner node weighs what its capacity is declared to be."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def build_tree(n_shards: int = N_SHARDS) -> Node:
    """Regions of RACKS racks of SHARDS_PER_RACK shards, each weighing its shard count; shards beyond N_SHARDS as ``grown`` adds them."""
    if n_shards > N_SHARDS:
        return grown(build_tree(n_shards - 1))
    per_region = RACKS * SHARDS_PER_RACK
    regions = []
    for lo in range(0, n_shards, per_region):
        racks = []
        for at in range(lo, min(lo + per_region, n_shards), SHARDS_PER_RACK):
            leaves = tuple(Node(f"s{i}", 1.0, shard=i) for i in range(at, min(at + SHARDS_PER_RACK, lo + per_region, n_shards)))
            racks.append(Node(f"k{at}", float(len(leaves)), leaves))
        regions.append(Node(f"r{lo}", sum(k.weight for k in racks), tuple(racks)))
    return Node("root", float(n_shards), tuple(regions))


def leaves(node: Node) -> list[Node]:
    return [node] if node.shard is not None else [x for c in node.children for x in leaves(c)]


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    new = max(x.shard for x in leaves(tree)) + 1
    leaf = Node(f"s{new}", weight, shard=new)
    region = Node(f"r{new}", weight, (Node(f"k{new}", weight, (leaf,)),))
    return Node(tree.name, tree.weight + weight, (*tree.children, region))


def _draw(node: Node, path: str, key: Column, seed: str) -> Column:
    """The index of the child of node that wins this row."""
    if len(node.children) == 1:
        return F.lit(0)
    tickets = [
        F.struct((-F.log(uniform(f"{seed}|{path}/{c.name}", key) + F.lit(2.0**-53)) / F.lit(float(c.weight))).alias("d"), F.lit(i).alias("i"))
        for i, c in enumerate(node.children)
        if c.weight > 0
    ]
    return F.array_min(F.array(*tickets))["i"]


def _cases(branches: list[tuple[Column, Column]]) -> Column:
    out = None
    for cond, value in branches:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def assign_shards(df: DataFrame, tree: Node, out: str = "shard", seed: str = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the shard of each row as an int column ``out``, which replaces one of that name."""
    key, reg, rack = free_name(df, "key_"), free_name(df, "region_"), free_name(df, "rack_")
    root = tree.name
    df = df.withColumn(key, row_key(doc_id, text))
    df = df.withColumn(reg, _draw(tree, root, F.col(key), seed))
    df = df.withColumn(rack, _cases([(F.col(reg) == i, _draw(r, f"{root}/{r.name}", F.col(key), seed)) for i, r in enumerate(tree.children)]))
    shards = []
    for i, r in enumerate(tree.children):
        for j, k in enumerate(r.children):
            ids = F.array(*[F.lit(x.shard) for x in k.children])
            at = _draw(k, f"{root}/{r.name}/{k.name}", F.col(key), seed)
            shards.append(((F.col(reg) == i) & (F.col(rack) == j), F.element_at(ids, at + 1)))
    return df.withColumn(out, _cases(shards).cast("int")).drop(key, reg, rack)


def number_slots(df: DataFrame, order: list[str], pieces: int = SLOT_PIECES, seed: str = SEED) -> DataFrame:
    """df with ``slot``, gapless from 0 in each shard.

    A shard's rows are numbered in ``pieces`` hash pieces, each with the rows before it as offset, so
    no task holds a whole shard. Equal rows are counted before the shuffle and numbered as one, then
    copied; of groups beyond CHUNK rows the copies are dealt anew. The offsets are shards x pieces
    rows at most.
    """
    columns = df.columns
    place = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    piece = (integer(f"{seed}|slot", place) % pieces).cast("int")
    groups = materialize(df.withColumn("piece_", piece).groupBy("piece_", *columns).agg(F.count(F.lit(1)).alias("n_")))
    counts = groups.groupBy("shard", "piece_").agg(F.sum("n_").alias("n_"))
    before = Window.partitionBy("shard").orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    inside = Window.partitionBy("shard", "piece_").orderBy(*order, *columns).rowsBetween(Window.unboundedPreceding, -1)
    first = groups.withColumn("first_", F.coalesce(F.sum("n_").over(inside), F.lit(0)))
    first = first.join(F.broadcast(offsets), ["shard", "piece_"]).withColumn("first_", F.col("first_") + F.col("offset_"))
    chunks = first.withColumn("i_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_") - 1, F.lit(CHUNK).cast("bigint"))))
    if not groups.filter(F.col("n_") > CHUNK).isEmpty():
        chunks = chunks.repartition("shard", "piece_", "first_", "i_")
    each = chunks.withColumn("i_", F.explode(F.sequence("i_", F.least(F.col("i_") + CHUNK, F.col("n_")) - 1)))
    return each.select(*columns, (F.col("first_") + F.col("i_")).cast("bigint").alias("slot"))


def shard_report(docs: DataFrame, n_shards: int = N_SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs."""
    tree = build_tree(n_shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.when(F.col("doc_id").isNull(), text).alias("text"),
    )
    rows = assign_shards(rows, tree, "shard", seed)
    rows = assign_shards(rows, grown(tree), "grown_shard", seed).drop("text")
    rows = number_slots(rows, ["doc_id", "size", "text_crc32"], seed=seed)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def _sql_draw(node: Node, path: str, key: str, seed: str) -> str:
    if len(node.children) == 1:
        return "0"
    tickets = ", ".join(
        f"{{'d': -ln(('0x' || substr(md5('{seed}|{path}/{c.name}|' || {key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 + {2.0**-53!r}::DOUBLE) / {float(c.weight)!r}::DOUBLE, 'i': {i}}}"
        for i, c in enumerate(node.children)
        if c.weight > 0
    )
    return f"list_min([{tickets}]).i"


def sql_shard(tree: Node, source: str, key: str, out: str, seed: str = SEED) -> str:
    """DuckDB SQL: source (a relation) with the shard column ``out``."""
    root = tree.name
    racks = " ".join(f"WHEN {i} THEN {_sql_draw(r, f'{root}/{r.name}', key, seed)}" for i, r in enumerate(tree.children))
    shards = " ".join(
        f"WHEN reg_ = {i} AND rack_ = {j} THEN [{', '.join(str(x.shard) for x in k.children)}][{_sql_draw(k, f'{root}/{r.name}/{k.name}', key, seed)} + 1]"
        for i, r in enumerate(tree.children)
        for j, k in enumerate(r.children)
    )
    return f"""SELECT * EXCLUDE (reg_, rack_), (CASE {shards} END)::INTEGER AS {out} FROM (
  SELECT *, (CASE reg_ {racks} END) AS rack_ FROM (
    SELECT *, {_sql_draw(tree, root, key, seed)} AS reg_ FROM {source}))"""


#: CRC-32 over the bytes of a text, by the 256-entry table of the reflected polynomial.
SQL_CRC_TABLE = """crc_table AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 9), lambda c, i:
  CASE WHEN i = 0 THEN c WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)) AS t)"""


def oracle_sql(n_shards: int = N_SHARDS, seed: str = SEED) -> str:
    tree = build_tree(n_shards)
    key = "coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))"
    base = sql_shard(tree, "d", key, "shard", seed)
    more = sql_shard(grown(tree), f"({base})", key, "grown_shard", seed)
    return f"""WITH {SQL_CRC_TABLE},
d AS (SELECT doc_id::BIGINT AS doc_id, text, encode(coalesce(text, '')) AS b FROM documents),
placed AS ({more}),
crc AS (SELECT p.* EXCLUDE (b, text), octet_length(b)::BIGINT + 16 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(regexp_extract_all(hex(b), '..'), lambda x: x <> ''), lambda x: ('0x' || x)::BIGINT)),
    lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)))::BIGINT AS text_crc32
  FROM placed p, crc_table),
pieces AS (SELECT *, (('0x' || substr(md5('{seed}|slot|' || concat_ws('|', coalesce(doc_id::VARCHAR, ''), size, text_crc32)), 1, 15))::BIGINT % {SLOT_PIECES}) AS piece FROM crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY piece, doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM pieces"""
