import itertools
import random
import re
from collections import Counter

from logloom.llm import decontaminate as d

RNG = random.Random(4)
ITEMS = [" ".join(RNG.choice("aeiou") + str(RNG.randint(0, 500)) for _ in range(n)) for n in (9, 16, 30, 59)]


def filler(n, rng=RNG):
    return " ".join(f"z{rng.randint(0, 3000)}" for _ in range(n))


def frames(spark):
    docs, leaked = [], set()
    for i in range(60):
        item = RNG.choice(ITEMS[1:])
        words = item.split()
        if i % 3 == 0:  # as it is, other case and marks
            docs.append((i, filler(30) + "\n" + item.upper().replace(" ", ", ") + "! " + filler(30)))
            leaked.add(i)
        elif i % 3 == 1:  # every eighth word replaced
            docs.append((i, filler(10) + " " + " ".join(w if j % 8 else "other" for j, w in enumerate(words)) + " " + filler(5)))
            leaked.add(i)
        else:  # a few words alone
            docs.append((i, filler(40) + " " + " ".join(words[:6]) + " " + filler(40)))
    docs += [(100, None), (101, ""), (None, filler(20) + " " + ITEMS[2]), (None, filler(20)), (102, ITEMS[0]), (103, filler(20_000))]
    leaked.add(102)
    df = spark.createDataFrame([(*x, "e", 2) for x in docs], "doc_id long, text string, key string, seed int")
    items = spark.createDataFrame([*enumerate(ITEMS), (10, None), (11, ""), (12, "too short to tell"), (None, ITEMS[3])], "item_id long, text string")
    return df, items, leaked


def test_finds_leaks_and_leaves_clean_documents(spark):
    df, items, leaked = frames(spark)
    found = d.find_contamination(df, items).collect()
    assert {r["doc_id"] for r in found if r["doc_id"] is not None} == leaked
    assert any(r["doc_id"] is None and r["item_id"] == 2 for r in found)
    kept = d.drop_contaminated(df, items)
    assert kept.columns == df.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in left if x is not None) == sorted(set(range(60)) - leaked | {100, 101, 103})
    assert left.count(None) == 1


def test_more_seeds_than_are_broadcast_give_the_same(spark):
    df, items, _ = frames(spark)
    a, b = (sorted(map(repr, d.find_contamination(df, items, broadcast_seeds=n).collect())) for n in (d.BROADCAST_SEEDS, 3))
    assert a == b


def test_empty_tables(spark):
    df, items, _ = frames(spark)
    assert d.find_contamination(df, items.limit(0)).count() == 0
    assert d.find_contamination(df.limit(0), items).count() == 0
    assert d.drop_contaminated(df, items.limit(0)).count() == df.count()


def placements():
    """Item length and replaced words of every way to keep just as many words as count."""
    for n in range(d.MIN_WORDS, d.WINDOW + 1):
        need = min(d.NEED, -(-n * d.NEED // d.WINDOW))
        yield from ((n, bad) for bad in itertools.combinations(range(n), n - need))


def test_every_placement_is_found(spark):
    cases = list(placements())
    items = {n: [f"q{n}x{j}" for j in range(n)] for n, _ in cases}
    longer = [f"r{j}" for j in range(40)]
    docs = [(i, " ".join("other" if j in bad else w for j, w in enumerate(items[n]))) for i, (n, bad) in enumerate(cases)]
    docs += [(10_000 + i, filler(9) + " " + " ".join("other" if j in bad else w for j, w in enumerate(longer[11:24])) + " " + filler(9)) for i, (n, bad) in enumerate(cases) if n == d.WINDOW]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = d.find_contamination(df, spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(0, " ".join(longer))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i, n) for i, (n, _) in enumerate(cases)] + [(i, 0) for i, _ in docs[len(cases) :]]


def test_equals_brute_force_alignment(spark, sf_dir):
    """All shifts of all documents against all items, with no seeds."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs, bench = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    items = [(r["item_id"], w) for r in bench.collect() if len(w := words(r["text"])) >= d.MIN_WORDS]
    places = {}
    for k, (_, w) in enumerate(items):
        for j, x in enumerate(w):
            places.setdefault(x, []).append((k, j))
    want = []
    for r in docs.collect():
        w = words(r["text"])
        equal = Counter((k, i - j) for i, x in enumerate(w) for k, j in places.get(x, ()))
        best = {}
        for (k, shift), n in equal.items():
            item = items[k][1]
            need = min(d.NEED, -(-len(item) * d.NEED // d.WINDOW))
            if n >= need:
                same = [int(0 <= j + shift < len(w) and w[j + shift] == x) for j, x in enumerate(item)]
                if (most := max(sum(same[j : j + d.WINDOW]) for j in range(max(len(item) - d.WINDOW, 0) + 1))) >= need:
                    best.setdefault(k, []).append(most)
        want += [(r["doc_id"], items[k][0], max(x), len(x)) for k, x in best.items()]
    got = d.find_contamination(docs, bench).drop("key").select("doc_id", "item_id", "n_equal", "n_alignments").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
