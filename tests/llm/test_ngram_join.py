import collections
import random
import re

import numpy as np
import pytest

from logloom.llm import ngram_join as j
from logloom.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    """doc_id, set size, component id and links of each row."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(repr((d, len(sets[i]), low.get(find(i)) if sets[i] else d, links[i])) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, sig int, root string")
    out = j.similar_documents(df).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    return sorted(repr(tuple(r)) for r in out)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 500)}"
    bases = [[word() for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(6)]
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            w = [x if rng.random() > rng.choice([0, 0, 0.01, 0.03, 0.06]) else word() for x in rng.choice(bases)]
        elif kind < 0.7:
            w = passage + [word() for _ in range(rng.randint(0, 60))]
        else:
            w = [word() for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    rows = corpus(3, 220)
    if small:  # many pieces, a short table of frequent shingles
        monkeypatch.setattr(j, "FREQUENT", 40)
        monkeypatch.setattr(j, "LEAST_COUNT", 4)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows_", [512, 5])
def test_clusters_of_many_blocks(spark, monkeypatch, rows_):
    monkeypatch.setattr(j, "BLOCK", 600)
    monkeypatch.setattr(j, "BLOCK_ROWS", rows_)
    rows = corpus(5, 160)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    text = "one two three four five six seven"
    rows = [(None, None), (None, text), (None, text), (7, text), (7, text), (3, text.upper()), (9, ""), (8, "  \n"), (4, "a b"), (5, "A\tb"), (6, "a b c"), (1, "x " * 30_000), (2, "x " * 10), (10, "é a b c d e"), (11, "É a b c d e")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == []


def test_one_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, "other words that stand alone here", "c"), (None, text, "d"), (None, None, "e"), (8, "", "f"), (8, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_hash string")
    out = j.one_of_each_group(df)
    assert out.columns == df.columns
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, [(3, text, "b"), rows[3], (None, None, "e"), (8, "", "f"), (8, "", "f")]))
    assert j.one_of_each_group(df.limit(0)).count() == 0


def test_large_groups_give_rows_and_small_ones_pairs(monkeypatch):
    n = 500
    entries = np.zeros(n + 32, j.ENTRY)
    entries["sig"], entries["n"], entries["matches"], entries["spare"], entries["count"] = np.arange(n + 32), 10, 1, 3, 1
    entries["count"][:2] = 2
    keys = np.concatenate([[7, 200, 7, 200], np.full(n - 2, 7), np.arange(300, 332)]).astype(np.uint64)
    for most in (1 << 20, 50):
        monkeypatch.setattr(j, "SORTED", most)
        rows = set()
        for out in j._candidates(keys, entries):
            rows |= set(zip(*(c.to_pylist() for c in out.columns), strict=True))
        assert {(b, k, s) for a, b, _, k, s in rows if a is None} == {(i, 7, 3) for i in range(n)}
        assert {(a, b) for a, b, *_ in rows if a is not None} == {(0, 1)}


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    doc = np.sort(rng.integers(0, 40, 900))
    shingle = rng.integers(0, 1 << 60, 900).astype(np.uint64)
    entries = np.zeros(40, j.ENTRY)
    entries["sig"] = np.arange(40) * 11
    got = []
    batch = j._packed(shingle, doc, entries, 7)
    assert len(set(batch.column(0).to_pylist())) == len(batch) == 7
    for k, e in zip(batch.column(1), batch.column(2), strict=True):
        own = np.frombuffer(e.as_py(), j.ENTRY)
        got += zip(np.repeat(own["sig"], own["count"]).tolist(), np.frombuffer(k.as_py(), np.uint64).tolist(), strict=True)
    assert sorted(got) == sorted(zip((doc * 11).tolist(), shingle.tolist(), strict=True))


@pytest.mark.parametrize("tile", [(1024, 1 << 16), (7, 60)])
@pytest.mark.parametrize("dense", [48, 3])
def test_link_counts_equal_brute_force(monkeypatch, tile, dense):
    monkeypatch.setattr(j, "TILE_ROWS", tile[0])
    monkeypatch.setattr(j, "TILE_MEMBERS", tile[1])
    monkeypatch.setattr(j, "DENSE", dense)
    rng = random.Random(6)
    sets, part, block = [], [], []
    for p, n in enumerate((1, 30, 3, 2, 60, 25)):
        bases = [rng.sample(range(80), rng.choice([1, 4, 12])) for _ in range(3)]
        own = [{x if rng.random() > 0.06 else rng.randint(0, 80) for x in rng.choice(bases)} for _ in range(n)]
        sets += own
        part += [p] * n
        block += sorted(rng.randint(0, 1) for _ in own)
    cross = np.array([False, False, False, True, True, False])
    copies = np.array([rng.randint(1, 3) for _ in sets])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    member = np.array([x for s in sets for x in sorted(s)], np.uint64)
    links, root = j.link_counts(row, member, np.array(part), np.array(block), cross, copies)
    want, tree = [0] * len(sets), list(range(len(sets)))
    find = lambda x: x if tree[x] == x else find(tree[x])
    for a in range(len(sets)):
        for b in range(a):
            if part[a] == part[b] and not (cross[part[a]] and block[a] == block[b]) and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                want[a] += copies[b]
                want[b] += copies[a]
                x, y = sorted((find(a), find(b)))
                tree[y] = x
    assert links.tolist() == want and root.tolist() == [find(x) for x in range(len(sets))]


def test_linked_sets_share_what_prefixes_promise():
    """Random sets at the edge of similarity, whatever multiples of the least l they take and shingles they leave out."""
    rng = random.Random(9)
    checked = 0
    for _ in range(20_000):
        n, other = rng.randint(1, 150), rng.randint(1, 150)
        common = -(-3 * (n + other) // 7)
        if common > min(n, other):
            continue
        ids = rng.sample(range(10_000), n + other - common)
        if rng.random() < 0.5:  # what is not shared is rare or frequent
            ids = sorted(ids[: n - common]) + sorted(ids[n - common : n], reverse=rng.random() < 0.5) + ids[n:]
            rank = {v: k for k, v in enumerate(sorted(ids, key=lambda v: (v in ids[n - common : n], v)))}
            ids = [rank[v] for v in ids]
        x, y = sorted(ids[:n]), sorted(ids[n - common :])
        prefix, rest, matches = [], [], []
        for v in (x, y):
            overlap = -(-3 * len(v) // 4)
            base = int(j.least_matches(np.array(len(v))))
            m = rng.choice([t * base for t in j.MULTIPLES if t * base <= overlap])
            prefix.append(v[: len(v) - overlap + m])
            rest.append(overlap - m)
            matches.append(m)
        shared = set(prefix[0]) & set(prefix[1])
        assert len(shared) >= max(min(matches), common - max(rest), *(int(j.least_shared(np.array(len(v)))) for v in (x, y)))
        for v in prefix:
            spare = (int(j.least_shared(np.array(len(x if v is prefix[0] else y)))) - 1) // 2
            shared -= set(rng.sample(sorted(shared), min(spare, len(shared))))
        assert shared
        checked += 1
    assert checked > 3000


def test_connected(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(60)] + [(1, 1)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for e in edges for x in e if find(x) != x}
    got = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chain", [(1, 3, 4, 5, 2), (1, 5, 4, 3, 2), (1, 2, 5, 4, 6, 3), (1, 2, 6, 4, 5, 3, 7)])
def test_connected_chain_alone(spark, chain):
    """Label orders where a round leaves no edge to a node that has one, but two edges at a node."""
    got = connected(spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 1) for i in sorted(chain) if i > 1]
