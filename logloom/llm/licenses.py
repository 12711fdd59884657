"""License scan by ordered signature rules.

A text is normalised to lower-case ASCII words and other characters, one space apart. A keyword
automaton tells which rules can match at all; their patterns run in order. A detection whose
interval lies within that of a detection of higher priority (or of equal priority and an earlier
place in the list, or longer) is suppressed. Base phrases are matched word by word besides, and
their labels always stay.

Defined results: a null, empty or wordless text has no words, labels or places and score 0;
repeated rows get equal results; an empty table gives no rows; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import table
from logloom.llm.license_rules import signatures

#: Words that make a place of a base label when they stand one after another.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_SCORE = 0.75
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


@cache
def _compiled():
    by_keyword = defaultdict(list)
    rules = []
    for i, (label, priority, score, keyword, pattern) in enumerate(signatures()):
        rules.append((priority, label, score, re.compile(f"(?<= )(?:{pattern})(?= )".encode())))
        by_keyword[keyword].append(i)
    finder = ahocorasick.Automaton()
    for word in {*by_keyword, "license"}:
        finder.add_word(word, word)
    finder.make_automaton()
    return rules, dict(by_keyword), finder


def normalise(text: str | None) -> bytes:
    """Lower-case words, one space apart and at both ends (one space for no words)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    return b" %b " % b" ".join(words) if words else b" "


def base_places(norm: bytes) -> list[tuple[int, str]]:
    """(byte offset, label) of each place of a base phrase."""
    out = []
    for phrase, label in BASE_PHRASES.items():
        needle = b" %b " % phrase.encode()
        at = norm.find(needle)
        while at >= 0:
            out.append((at + 1, label))
            at = norm.find(needle, at + len(needle) - 1)
    return sorted(out)


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, priority, rule): those that lie within no detection that outranks them."""
    reach: dict[int, int] = {}
    out = []
    for start, end, priority, rule in sorted(found, key=lambda x: (x[0], -x[1], -x[2], x[3])):
        if not any(p >= priority and e >= end for p, e in reach.items()):
            out.append((start, end, priority, rule))
        reach[priority] = max(reach.get(priority, -1), end)
    # a later start never contains an earlier one, so one pass in this order is enough
    return out


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, str]:
    norm = normalise(text)
    n_words = norm.count(b" ") - 1
    if n_words <= 0:
        return 0, 0, None, None, "", "", 0.0, ""
    rules, by_keyword, finder = _compiled()
    keywords = {w for _, w in finder.iter(norm.decode("latin-1"))}
    if not keywords:
        return n_words, 0, None, None, "", "", 0.0, ""
    places = base_places(norm) if "license" in keywords else []
    found = []
    for i in sorted(i for k in keywords for i in by_keyword.get(k, ())):
        priority, _, _, pattern = rules[i]
        found += [(m.start(), m.end(), priority, i) for m in pattern.finditer(norm)]
    left = suppress(found)
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(rules[x[3]][1] for x in left)})
    score = max([rules[x[3]][2] for x in left] + [BASE_SCORE] * bool(base), default=0.0)
    first, last = (norm.count(b" ", 0, places[i][0]) - 1 for i in (0, -1)) if places else (None, None)
    return n_words, len(places), first, last, ",".join(base), ",".join(labels), score, _spans(norm, left, rules)


def _spans(norm: bytes, left: list[tuple[int, int, int, int]], rules) -> str:
    """label:first-last words of each detection, counted in one pass over the text."""
    edges = sorted({x for s, e, _, _ in left for x in (s, e)})
    words, at, n = {}, 0, -1
    for x in edges:
        n += norm.count(b" ", at, x)
        words[x], at = n, x
    return ";".join(f"{rules[r][1]}:{words[s]}-{words[e]}" for s, e, _, r in left)


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [x.split()[0] for x in OUT.split(", ")]
    for pdf in batches:
        out = pd.DataFrame([scan(t) for t in pdf["text"]], columns=cols[1:])
        out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
        for c in ("first_word", "last_word"):
            out[c] = out[c].astype("Int64")
        yield out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a document: counts, base places, labels, score, and each detection's words."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(_scan_batches, OUT)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
