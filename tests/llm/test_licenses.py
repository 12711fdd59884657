import re
from re import _parser

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import licenses as l
from logloom.llm.license_rules import signatures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = sorted((i, label) for p, label in l.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    at = [i for i, _ in places]
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def brute_suppress(found):
    def outranks(a, b):
        if a is b or not (a[0] <= b[0] and b[1] <= a[1]):
            return False
        return a[2] > b[2] or a[2] == b[2] and (a[1] - a[0], -a[3]) > (b[1] - b[0], -b[3])

    return sorted(x for x in found if not any(outranks(y, x) for y in found))


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["MIT", "mit", "License", "apache", "general", "public", "é", "x-y", ",", "\n", "İ", "license"]), max_size=14), st.sampled_from([" ", "", "-", "\n"]))
def test_base_equals_brute_force(parts, by):
    text = by.join(parts)
    assert l.scan(text)[:5] == brute(text)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 8), st.integers(1, 3), st.integers(0, 5)), max_size=12, unique=True))
def test_suppression_equals_brute_force(found):
    found = [(s, s + n, p, r) for s, n, p, r in found]
    assert sorted(l.suppress(found)) == brute_suppress(found)


def test_rules():
    rules = signatures()
    assert len(rules) > 200
    for label, priority, score, keyword, pattern in rules:
        assert 1 <= priority <= 4 and 0 < score <= 1
        assert keyword in pattern.replace("licen[sc]e", "license"), label
        re.compile(pattern)


def test_labels():
    labels = lambda t: l.scan(t)[5]
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache,apache-2.0"
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert labels("GNU Lesser General Public License v2.1") == "gpl,lgpl-2.1"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by-nc-4.0"
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == "bsd-3-clause"
    assert labels("Released under the MIT License.") == "mit"
    assert labels("we permit a licensed driver") == ""


def test_query_and_edges(spark):
    texts = [None, "", "...", "mit license " * 20_000, "MIT License\nMIT License", "nothing here"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "mit license", "x"), (4, texts[4], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    out = l.scan_licenses(df).collect()
    got = sorted(repr((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in out)
    assert got == sorted(repr((d, *brute(t))) for d, t, _ in rows)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out)
    assert l.scan_licenses(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = {r["doc_id"]: r for r in l.op10_licenses(spark, sf_dir).collect()}
    for d in docs:
        r = out[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(d["text"])


def matches(items):
    """The texts that a parsed pattern matches, with each repeat taken once or, where it may be, not at all."""
    out = {""}
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            ends = {chr(arg)}
        elif op == "IN":
            ends = {chr(c) for kind, x in arg for c in ([x] if str(kind) == "LITERAL" else range(x[0], x[1] + 1))}
        elif op == "SUBPATTERN":
            ends = matches(arg[3])
        elif op == "BRANCH":
            ends = {m for x in arg[1] for m in matches(x)}
        elif op == "ANY":
            ends = {"."}
        else:
            assert op in ("MAX_REPEAT", "MIN_REPEAT"), op
            ends = matches(arg[2]) | ({""} if arg[0] == 0 else set())  # once for any number of times
        out = {a + b for a in out for b in ends}
    return out


def test_keyword_is_in_every_match():
    for label, _, _, keyword, pattern in signatures():
        assert [m for m in matches(_parser.parse(pattern)) if keyword not in m] == [], label
    assert l.scan("Distributed under the PSF License, version 2.")[5] == "python-2.0"
