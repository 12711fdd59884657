"""Jaccard join on word shingles with adaptive multi-match prefixes, down to components.

A document's set holds its distinct shingles of N words, ordered from rare to frequent by counts
over the corpus, ties by hash. Of two sets whose similarity is T or more, the first
``n - ceil(T n) + l`` shingles have l in common. Each document takes an l of n / 8 or a multiple,
the one with the least estimated cost: its prefix rows, and the candidates they bring, at most
the prefix's summed frequencies over l. A pair is a candidate when it shares the smaller l of the
two, and so many shingles of its prefixes that with all that lies behind the one that ends first
it could still be similar enough.

1. One pass writes each row's set size and signature, and the shingles met more than once in a
   piece of the input, with a pivot. Rows of one signature are one class from here on.
2. A second pass writes the prefixes. Since every document's l grows with its set, a linked pair
   shares at least ``least_shared`` prefix shingles, and each document can leave out nearly half
   as many without losing a pair: its most frequent ones go. Shingles of the bounded table of frequent ones that stay send no prefix row:
   the document is tied to the shingle's pivot, which costs one edge however many share it.
   Other shingles meet by shuffle, packed by bucket: small groups give pairs; of large groups each
   document leaves out as many as it still can, and what stays is tied to the group's first
   member. So no large group is expanded into pairs, and no linked pair is lost.
3. The ties' components are clusters. A large cluster is split by classes of set sizes, since
   linked sets lie in one class or in neighbours, and each class into blocks of bounded size.
   Each pair of blocks that can hold links is one group, where intersections are counted exactly,
   in tiles; what comes out is a count of links and a component for each text, never pairs.
   Components are joined over blocks.

Defined results: a null, empty or wordless text has an empty set and links with nothing; texts
with fewer than N words have their whole sequence as one shingle; a null doc_id takes part, and a
component's id is its smallest doc_id that is not null; repeated rows are one class; an empty
table gives no rows; columns other than doc_id and text are ignored, or kept by
``one_of_each_group``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm import tokens
from logloom.llm.common import bounded_batches, discard, free_name, materialize, table
from logloom.llm.components import connected

N = 5
T_NUM, T_DEN = 3, 4
#: Bytes of text within which shingles are counted before the counts are summed.
PIECE = 12 << 20
#: Shingles that the table of frequent ones holds at most, and the least count it takes.
FREQUENT, LEAST_COUNT = 1 << 18, 8
EIGHTH, MULTIPLES = 8, (1, 2, 3)
#: Cost of verifying a candidate, in prefix rows.
VERIFY_COST = 4.0
#: Members of a prefix group that are paired; larger ones are tied to a pivot.
PAIRED = 16
#: Bits of the filter that texts pass before they are shuffled.
BITS = 1 << 24
#: Prefix shingles are dealt to buckets planned for so many set members, and sorted so many at a time.
BUCKET, SORTED = 3 << 20, 1 << 20
MOST_PARTITIONS = 100_000
#: A class with more than one in so many of all rows is hot.
HOT = 10_000
#: Shingles of the texts of a block, and texts.
BLOCK, BLOCK_ROWS = 1 << 19, 512
#: Ratio of the sizes at the ends of a class; over 4 / 3, so that linked sets are in one class or in neighbours.
STEP = 1.34
#: Characters of texts of small clusters that are settled together.
SETTLED = 3 << 20
#: Shingle groups up to this size are expanded into pairs within a task, larger ones multiplied as a matrix.
DENSE = 48
#: Rows, and members of sets, of a tile in which intersections are counted.
TILE_ROWS, TILE_MEMBERS = 1024, 1 << 16
PREFIX = "bucket int, keys binary, entries binary, a long, b long"
MET = "a long, b long, need int, shingle long, spare int"
STATS = "doc_id long, row_hash long, n int, sig long, shingle long, df int, pivot long"


def shingle_sets(block: tokens.Block, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """row and hash of each distinct shingle of each text, by row and hash."""
    w = tokens.words(block)
    h = tokens.word_hashes(block.data, w.start, w.end)
    at = tokens.within_rows(w, n)
    row, own = w.row[at], tokens.window_hashes(h, n)[at]
    count = np.diff(w.first)
    for i in np.flatnonzero((count > 0) & (count < n)):
        few = h[w.first[i] : w.first[i + 1]]
        row, own = np.append(row, i), np.append(own, tokens.mix(tokens.window_hashes(few, len(few)) + np.uint64(len(few))))
    order = np.lexsort((own, row))
    row, own = row[order], own[order]
    keep = np.ones(len(own), bool)
    keep[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    return row[keep], own[keep]


def signatures(row: np.ndarray, own: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each row's set, and 64 bits that equal sets share."""
    size = np.bincount(row, minlength=n_rows)
    total = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(tokens.mix(own), dtype=np.uint64, out=total[1:])
    end = np.cumsum(size)
    return size, tokens.mix(total[end] - total[end - size]).view(np.int64)


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _stats(n: int):
    """Rows' sizes and signatures, and counts of the shingles that a piece holds in several sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def counts() -> Iterator[pa.RecordBatch]:
            own, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((sig, own))
            own, sig = own[order], sig[order]
            fresh = np.ones(len(own), bool)  # a class counts once
            fresh[1:] = (own[1:] != own[:-1]) | (sig[1:] != sig[:-1])
            own, sig = own[fresh], sig[fresh]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            df = np.diff(np.append(first, len(own)))
            some = df > 1
            k = int(some.sum())
            null = lambda kind: pa.nulls(k, kind)
            yield _batch(doc_id=null(pa.int64()), row_hash=null(pa.int64()), n=null(pa.int32()), sig=null(pa.int64()), shingle=pa.array(own[first[some]].view(np.int64)), df=pa.array(df[some].astype(np.int32)), pivot=pa.array(sig[first[some]]))

        for batch in batches:
            for b in tokens.blocks(batch.column(2), lower=True):
                row, own = shingle_sets(b, n)
                count, sig = signatures(row, own, b.n)
                null = lambda kind: pa.nulls(b.n, kind)  # noqa: B023, E731
                yield _batch(doc_id=batch.column(0)[b.lo : b.hi], row_hash=batch.column(1)[b.lo : b.hi], n=pa.array(count.astype(np.int32)), sig=pa.array(sig), shingle=null(pa.int64()), df=null(pa.int32()), pivot=null(pa.int64()))
                held.append((own, sig[row]))
                size += len(b.data)
                if size >= PIECE:
                    yield from counts()
                    held.clear()
                    tokens.release()
                    size = 0
        if held:
            yield from counts()
        held.clear()
        tokens.release()

    return run


def least_matches(n: np.ndarray) -> np.ndarray:
    """The smallest l that a set of n takes; never more for a smaller set."""
    return np.maximum(1, n // EIGHTH)


def least_shared(n: np.ndarray) -> np.ndarray:
    """What the prefixes of a set of n and of any linked set, which has T n shingles or more, surely share."""
    return least_matches(-(-T_NUM * n // T_DEN))


def choose_prefixes(row: np.ndarray, df: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, prefix length and number of shingles that can be left out, of each row, whose shingles come in order of df.

    Two linked sets leave out fewer than the smaller one's least l: of both, half of what a set
    with T of its own size takes, less one.
    """
    size = np.bincount(row, minlength=n_rows)
    start = np.cumsum(size) - size
    overlap = -(-T_NUM * size // T_DEN)
    total = np.append(0.0, np.cumsum(df - 1.0))
    base = least_matches(size)
    spare = np.where(size > 0, (least_shared(size) - 1) // 2, 0)
    best = np.full(n_rows, np.inf)
    matches, length = np.ones(n_rows, np.int64), np.zeros(n_rows, np.int64)
    for times in MULTIPLES:
        m = base * times
        able = (m <= overlap) & (size > 0)
        plen = np.where(able, size - overlap + m, 0)
        cost = np.where(able, plen + VERIFY_COST * (total[start + np.maximum(plen - spare, 0)] - total[start]) / m, np.inf)
        better = cost < best
        best = np.where(better, cost, best)
        matches, length = np.where(better, m, matches), np.where(better, plen, length)
    return matches, length, spare


#: What a bucket learns of a document: its class, set size, l, frequent shingles in its prefix, shingles it can still leave out, and how many keys follow.
ENTRY = np.dtype([("sig", "<i8"), ("n", "<i4"), ("matches", "<i4"), ("known", "<i4"), ("spare", "<i4"), ("count", "<i4")])


def _packed(shingle: np.ndarray, doc: np.ndarray, entries: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Prefix rows by bucket: one string of keys and one of ENTRY records each; doc is ascending."""
    bucket = (tokens.mix(shingle) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, doc, keys = bucket[order], doc[order], np.ascontiguousarray(shingle[order])
    step = bucket[1:] != bucket[:-1]
    of_bucket = np.flatnonzero(np.append(True, step))
    of_doc = np.flatnonzero(np.append(True, step | (doc[1:] != doc[:-1])))
    rows = entries[doc[of_doc]]
    rows["count"] = np.diff(np.append(of_doc, len(doc)))
    key_at = np.append(of_bucket, len(doc)) * 8
    row_at = np.searchsorted(of_doc, np.append(of_bucket, len(doc))) * ENTRY.itemsize
    strings = [pa.Array.from_buffers(pa.binary(), len(of_bucket), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(x.tobytes())]) for at, x in ((key_at, keys), (row_at, rows))]
    none = pa.nulls(len(of_bucket), pa.int64())
    return _batch(bucket=pa.array(bucket[of_bucket]), keys=strings[0], entries=strings[1], a=none, b=none)


def _prefixes(frequent, n: int, buckets: int):
    """Prefix rows packed by bucket, and ties (pivot, class) for frequent shingles, as PREFIX."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, dfs, pivots = frequent.value
        seen, size = set(), 0
        light_keys, light_docs, entries, n_docs, n_light = [], [], [], 0, 0
        ties: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if n_light:
                yield _packed(np.concatenate(light_keys), np.concatenate(light_docs), np.concatenate(entries), buckets)
            if ties:
                t = np.unique(np.concatenate(ties, axis=1), axis=1)
                yield _batch(bucket=pa.nulls(t.shape[1], pa.int32()), keys=pa.nulls(t.shape[1], pa.binary()), entries=pa.nulls(t.shape[1], pa.binary()), a=pa.array(t[0]), b=pa.array(t[1]))

        for batch in batches:
            for b in tokens.blocks(batch.column(0), lower=True):
                row, own = shingle_sets(b, n)
                _, sig = signatures(row, own, b.n)
                new = np.zeros(b.n, bool)
                for i, s in enumerate(sig.tolist()):
                    new[i] = s not in seen
                    seen.add(s)
                size += len(b.data)
                keep = new[row]
                row, own = row[keep], own[keep]
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                df = np.where(known, dfs[at], 1) if len(keys) else np.ones(len(own), np.int64)
                order = np.lexsort((own, df, row))
                row, own, df, known, at = row[order], own[order], df[order], known[order], at[order]
                matches, length, spare = choose_prefixes(row, df, b.n)
                count = np.bincount(row, minlength=b.n)
                rank = np.arange(len(row)) - (np.cumsum(count) - count)[row]
                inside = rank < length[row]
                light = inside & ~known
                left_out = inside & known & (rank >= (length - spare)[row])
                own_entries = np.zeros(b.n, ENTRY)
                own_entries["sig"], own_entries["n"], own_entries["matches"] = sig, count, matches
                own_entries["known"] = np.bincount(row[inside & known], minlength=b.n)
                own_entries["spare"] = spare - np.bincount(row[left_out], minlength=b.n)
                light_keys.append(own[light])
                light_docs.append(row[light] + n_docs)
                entries.append(own_entries)
                n_docs += b.n
                n_light += int(light.sum())
                heavy = inside & known & ~left_out
                if heavy.any():
                    t = np.unique(np.stack([pivots[at[heavy]], sig[row[heavy]]]), axis=1)
                    ties.append(t[:, t[0] != t[1]])
                if size >= PIECE:
                    yield from flush()
                    seen, size = set(), 0
                    light_keys, light_docs, entries, n_docs, n_light, ties = [], [], [], 0, 0, []
                    tokens.release()
        yield from flush()
        light_keys = light_docs = entries = ties = seen = None
        tokens.release()

    return run


def _candidates(keys: np.ndarray, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, need) of small groups, and rows (b, shingle, spare) of large ones, from the keys of one bucket."""
    doc = np.repeat(np.arange(len(entries)), entries["count"])
    for part in range(parts := 1 + len(keys) // SORTED):  # whole groups, so that sorting takes bounded memory
        mine = np.flatnonzero(keys % np.uint64(parts) == np.uint64(part)) if parts > 1 else slice(None)
        key, of = keys[mine], doc[mine]
        order = np.argsort(key)
        key, of = key[order], of[order]
        same = key[1:] == key[:-1]
        some = np.append(False, same) | np.append(same, False)  # most keys stand alone
        key, of = key[some], of[some]
        sig = entries["sig"][of]
        order = np.lexsort((sig, key))
        key, of, sig = key[order], of[order], sig[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        key, of, sig = key[keep], of[keep], sig[keep]
        if not len(key):
            continue
        n, matches, known, spare = (entries[x][of].astype(np.int64) for x in ("n", "matches", "known", "spare"))
        rest = -(-T_NUM * n // T_DEN) - matches
        first = np.append(True, key[1:] != key[:-1])
        size = np.diff(np.append(np.flatnonzero(first), len(key)))
        small = (size <= PAIRED)[np.cumsum(first) - 1]
        a, b, need = [], [], []
        for lag in range(1, min(PAIRED, int(size.max()))):
            i = np.flatnonzero((key[lag:] == key[:-lag]) & small[lag:])
            i = i[T_DEN * np.minimum(n[i], n[i + lag]) >= T_NUM * np.maximum(n[i], n[i + lag])]
            j = i + lag
            a.append(sig[i])
            b.append(sig[j])
            overlap = -(-T_NUM * (n[i] + n[j]) // (T_NUM + T_DEN))
            shared = np.maximum(np.minimum(matches[i], matches[j]), overlap - np.maximum(rest[i], rest[j]))
            need.append(shared - np.minimum(known[i], known[j]))
        if a:
            a, b, need = np.concatenate(a), np.concatenate(b), np.concatenate(need)
            none = pa.nulls(len(a), pa.int64())
            yield _batch(a=pa.array(a), b=pa.array(b), need=pa.array(need.astype(np.int32)), shingle=none, spare=pa.nulls(len(a), pa.int32()))
        big = np.flatnonzero(~small)
        if len(big):
            yield _batch(a=pa.nulls(len(big), pa.int64()), b=pa.array(sig[big]), need=pa.nulls(len(big), pa.int32()), shingle=pa.array(key[big].view(np.int64)), spare=pa.array(spare[big].astype(np.int32)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties as they are; of prefix rows, which come sorted by bucket, their candidates."""
    now, keys, entries, done = None, [], [], 0

    def settle() -> Iterator[pa.RecordBatch]:
        if keys:
            yield from _candidates(np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(entries), ENTRY))

    for batch in batches:
        tie = batch.column(0).is_null()
        if tie.true_count:
            t = batch.filter(tie)
            none = pa.nulls(len(t), pa.int64())
            yield _batch(a=t.column(3), b=t.column(4), need=pa.array(np.zeros(len(t), np.int32)), shingle=none, spare=pa.nulls(len(t), pa.int32()))
        for bucket, k, e in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if bucket is None:
                continue
            if bucket != now:
                yield from settle()
                now, keys, entries = bucket, [], []
                if done >= 8 * PIECE:
                    tokens.release()
                    done = 0
            keys.append(k.as_py())
            entries.append(e.as_py())
            done += len(keys[-1])
    yield from settle()
    keys, entries = [], []
    tokens.release()


def link_counts(row: np.ndarray, own: np.ndarray, part: np.ndarray, block: np.ndarray, cross: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, its similar ones (weighted by their copies) and its component's smallest row.

    row and own are the sets' members by row; rows of one part stand together, those of one block
    in it too. Of a part that is ``cross`` only pairs of two blocks are compared. Rows are taken in
    tiles: shingles of few rows give pairs of a tile's rows, those of many a product of 0/1
    matrices of two tiles, so memory follows the tiles and not the pairs.
    """
    n_rows = len(part)
    size = np.bincount(row, minlength=n_rows)
    links, root = np.zeros(n_rows, np.int64), np.arange(n_rows)
    key = tokens.mix(own ^ tokens.mix(part[row].astype(np.uint64)))
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    df = np.diff(np.append(start, len(key)))
    ident = np.empty(len(key), np.int64)
    ident[order] = np.repeat(np.arange(len(df)), df)
    some = df[ident] > 1
    row, ident = row[some], ident[some]
    light = df[ident] <= DENSE
    # light members by shingle and row; heavy ones by row and shingle
    order = np.lexsort((row[light], ident[light]))
    l_id, l_row = ident[light][order], row[light][order]
    at_row = np.argsort(l_row, kind="stable")
    row_of = l_row[at_row]
    h_id, h_row = ident[~light], row[~light]
    part_end = np.searchsorted(part, part, "right")
    edges: list[np.ndarray] = []
    waiting = 0

    def found(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root, links, waiting
        links += np.bincount(a, copies[b], n_rows).astype(np.int64) + np.bincount(b, copies[a], n_rows).astype(np.int64)
        apart = root[a] != root[b]
        if apart.any():
            edges.append(np.unique(np.stack([root[a[apart]], root[b[apart]]]), axis=1))
            waiting += edges[-1].shape[1]
            if waiting > TILE_MEMBERS:
                join()

    def join() -> None:
        nonlocal root, waiting
        if edges:
            e = np.concatenate(edges, axis=1)
            root = _roots(e[0], e[1], n_rows)[root]
            edges.clear()
            waiting = 0

    # tiles: rows of one block, so many and with so many members at most (or one row)
    members = np.bincount(row, minlength=n_rows)
    new_block = np.append(True, (part[1:] != part[:-1]) | (cross[part[1:]] & (block[1:] != block[:-1])))
    tiles, lo, held = [], 0, 0
    small = np.bincount(part, minlength=len(cross))[part] <= DENSE  # no heavy members: such parts share a tile
    for i in range(1, n_rows + 1):
        held += members[i - 1]
        if i == n_rows or i - lo >= TILE_ROWS or held + members[i] > TILE_MEMBERS or (new_block[i] and not (small[i] and small[i - 1])):
            tiles.append((lo, i))
            lo, held = i, 0
    for lo, hi in tiles:
        mine = at_row[np.searchsorted(row_of, lo) : np.searchsorted(row_of, hi)]
        codes = [np.zeros(0, np.int64)]
        for lag in range(1, DENSE):
            mine = mine[mine + lag < len(l_id)]
            mine = mine[l_id[mine + lag] == l_id[mine]]
            if not len(mine):
                break
            codes.append(l_row[mine] * n_rows + l_row[mine + lag])
        pair, common = np.unique(np.concatenate(codes), return_counts=True)
        a, b = pair // n_rows, pair % n_rows
        if cross.any():
            wanted = ~cross[part[a]] | (block[a] != block[b])
            a, b, common = a[wanted], b[wanted], common[wanted]
        i_lo, i_hi = np.searchsorted(h_row, (lo, hi))
        if i_lo == i_hi:
            good = T_DEN * common >= T_NUM * (size[a] + size[b] - common)
            found(a[good], b[good])
            continue
        for lo2, hi2 in tiles:
            if lo2 < lo or lo2 >= part_end[lo] or (cross[part[lo]] and block[lo] == block[lo2]):
                continue
            j_lo, j_hi = np.searchsorted(h_row, (lo2, hi2))
            total = np.zeros((hi - lo, hi2 - lo2), np.float32)
            ids = np.intersect1d(h_id[i_lo:i_hi], h_id[j_lo:j_hi])
            for w in range(0, len(ids), TILE_ROWS):
                sides = []
                for first, p, q, rows in ((lo, i_lo, i_hi, hi - lo), (lo2, j_lo, j_hi, hi2 - lo2)):
                    col = np.searchsorted(ids[w : w + TILE_ROWS], h_id[p:q])
                    ok = np.flatnonzero(ids[np.minimum(w + col, len(ids) - 1)] == h_id[p:q])
                    ok = ok[col[ok] < TILE_ROWS]
                    m = np.zeros((rows, min(TILE_ROWS, len(ids) - w)), np.float32)
                    m[h_row[p:q][ok] - first, col[ok]] = 1
                    sides.append(m)
                total += sides[0] @ sides[1].T
            here = (b >= lo2) & (b < hi2)
            total[a[here] - lo, b[here] - lo2] += common[here]
            good = T_DEN * total >= T_NUM * (size[lo:hi, None] + size[None, lo2:hi2] - total)
            ga, gb = np.nonzero(good)
            ga, gb = ga + lo, gb + lo2
            upper = ga < gb
            found(ga[upper], gb[upper])
    join()
    return links, root


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row of each row's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        old = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root != root[root]).any():
            root = root[root]
        if (root == old).all():
            return root


def _verify(n: int):
    """From texts sorted by (cluster, i, j, block): sig, root, weighted links of each text in its pair of blocks."""

    def settle(groups: list[list[tuple]]) -> pa.RecordBatch:
        items = [x for g in groups for x in g]
        part = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        rows, owns, at = [], [], 0
        for b in tokens.blocks(pa.array([x[0] for x in items], pa.large_string()), lower=True):
            row, own = shingle_sets(b, n)
            rows.append(row + at)
            owns.append(own)
            at += b.n
        sig, copies, block = (np.array([x[k] for x in items], np.int64) for k in range(1, 4))
        cross = np.array([g[0][4] != g[0][5] for g in groups])  # a pair in one block is counted with that block alone
        links, root = link_counts(np.concatenate(rows), np.concatenate(owns), part, block, cross, copies)
        least = np.full(len(items), np.iinfo(np.int64).max)
        np.minimum.at(least, root, sig)  # a component's root is its smallest signature
        root = least[root]
        whole = np.array([x[6] for x in items], bool)
        some = (links > 0) | (root != sig)
        return _batch(sig=pa.array(sig[some]), root=pa.array(root[some]), links=pa.array(links[some]), whole=pa.array(whole[some]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        now, seen, size = None, set(), 0
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(8)]  # cluster, i, j, sig, copies, block, whole, text
            for cluster, i, j, sig, copies, block, whole, text in zip(*cols, strict=True):
                if (cluster, i, j) != now:
                    if size > SETTLED:
                        yield settle(groups)
                        groups, size = [], 0
                        tokens.release()
                    now, seen = (cluster, i, j), set()
                    groups.append([])
                if sig not in seen:
                    seen.add(sig)
                    groups[-1].append((text, sig, copies, block, i, j, whole))
                    size += len(text)
        if groups:
            yield settle(groups)
        groups = cols = None
        tokens.release()

    return run


def _bitmap(rows: DataFrame) -> np.ndarray:
    """BITS bits, set for the row_hash of each row; BITS / 64 rows at most come to the driver."""
    cell = F.pmod(F.col("row_hash"), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (cell % 64).cast("int"))
    found = rows.groupBy(F.floor(cell / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("v")).toPandas()
    out = np.zeros(BITS // 64, np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64).view(np.uint64)
    return out


def _only(bitmap):
    """The rows whose row_hash may be wanted, so that other texts are not shuffled; the join that follows is exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.mod(batch.column(0).to_numpy(zero_copy_only=False), BITS)
            yield batch.filter(pa.array((bitmap.value[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1)) > 0))

    return run


def similar_documents(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, row_hash, n_shingles, component_id and n_links (other rows it links with) of each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_hash"), F.coalesce("text", F.lit("")).alias("text"))
    stats = materialize(rows.mapInArrow(_stats(n), STATS))
    mine = stats.filter("sig is not null").select("doc_id", "row_hash", "n", "sig")

    # a bounded table, used for order and ties only: what it leaves out meets by shuffle
    counts = stats.filter("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df"), F.min("pivot").alias("pivot"))
    top = counts.filter(F.col("df") >= LEAST_COUNT).orderBy(F.desc("df"), "shingle").limit(FREQUENT).toPandas()
    keys = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], top["df"].to_numpy(np.int64)[order], top["pivot"].to_numpy(np.int64)[order]))

    shingles, n_rows = mine.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(shingles / BUCKET), MOST_PARTITIONS))
    buckets = max(partitions, math.ceil(shingles / BUCKET))
    prefixes = rows.select("text").mapInArrow(_prefixes(frequent, n, buckets), PREFIX)
    dealt = prefixes.repartitionById(partitions, F.pmod(F.coalesce(F.col("bucket"), F.hash("b")), F.lit(partitions)))  # ties need not meet
    met = materialize(dealt.sortWithinPartitions("bucket").mapInArrow(_meet, MET))
    large = met.filter("shingle is not null").groupBy("shingle", "b").agg(F.min("spare").alias("spare"))
    groups = large.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"))
    ranked = materialize(large.join(groups, "shingle").withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("size"), "shingle"))))
    stay = ranked.filter("rank > spare").select("shingle", "b")
    firsts = materialize(stay.groupBy("shingle").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n_")).filter("n_ > 1").select("shingle", "a"))
    ties = met.filter("need = 0 and shingle is null and a is not null").select("a", "b").unionByName(stay.join(firsts, "shingle").filter("a <> b").select("a", "b"))
    # shared shingles of large groups are not counted in pairs
    uncounted = materialize(ranked.groupBy("b").agg(F.count(F.lit(1)).alias("more")))
    pairs = met.filter("need is not null and shingle is null").groupBy("a", "b").agg(F.min("need").alias("need"), F.count(F.lit(1)).alias("n_"))
    pairs = pairs.join(uncounted.select(F.col("b").alias("a"), F.col("more").alias("more_a")), "a", "left").join(uncounted.withColumnRenamed("more", "more_b"), "b", "left")
    both = F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    pairs = pairs.filter(F.col("n_") >= F.col("need") - both).select("a", "b").unionByName(ties)
    clusters = connected(pairs)
    discard(met, ranked, firsts, uncounted)
    members = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())

    classes = materialize(mine.filter("n > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n")))
    own = joined = materialize(classes.join(members.withColumnRenamed("node", "sig"), "sig").select("sig", "root", "copies", "n", F.col("first.row_hash").alias("row_hash")))
    # a cluster of one block is whole; of others linked sets are in one class of sizes or in neighbours
    total = own.groupBy("root").agg((F.count(F.lit(1)) <= BLOCK_ROWS).alias("few"), (F.sum("n") <= BLOCK).alias("short")).select("root", (F.col("few") & F.col("short")).alias("whole"))
    step = F.when(F.col("whole"), 0).otherwise(F.floor(F.log("n") / math.log(STEP))).cast("bigint")
    own = materialize(own.join(total, "root").withColumn("step", step))
    steps = own.groupBy("root", "step").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"))
    beside = Window.partitionBy("root").orderBy("step").rangeBetween  # a root has under 100 steps
    steps = steps.withColumn("below", F.coalesce(F.sum("blocks").over(beside(-1, -1)), F.lit(0))).withColumn("above", F.coalesce(F.sum("blocks").over(beside(1, 1)), F.lit(0)))
    number = lambda step, n: F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>")), lambda h: step * (1 << 32) + h)
    at = F.when(F.col("whole"), F.lit(0)).otherwise(F.col("step"))
    others = F.concat(number(at, F.when(F.col("whole"), 1).otherwise(F.col("blocks"))), number(at - 1, F.when(F.col("whole"), 0).otherwise(F.col("below"))), number(at + 1, F.when(F.col("whole"), 0).otherwise(F.col("above"))))
    block = F.when(F.col("whole"), F.lit(0)).otherwise(at * (1 << 32) + F.pmod(F.hash("sig"), F.col("blocks"))).cast("bigint")
    dealt = own.join(steps, ["root", "step"]).select("row_hash", "sig", "copies", F.col("root").alias("cluster"), "whole", block.alias("block"), F.explode(others).alias("other"))
    dealt = materialize(dealt.select("row_hash", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "copies", "block", "whole"))
    wanted = rows.select("row_hash", "text").mapInArrow(_only(spark.sparkContext.broadcast(_bitmap(dealt))), "row_hash long, text string")
    texts = wanted.join(dealt, "row_hash").select("cluster", "i", "j", "sig", "copies", "block", "whole", "text")
    found = texts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block").mapInArrow(_verify(n), "sig long, root long, links long, whole boolean")
    found = materialize(found)
    discard(joined, own, dealt)

    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    over = connected(found.filter("not whole").select(F.col("sig").alias("a"), F.col("root").alias("b")))
    label = found.filter("whole").select("sig", "root").unionByName(over.select(F.col("node").alias("sig"), "root")).filter("sig <> root")
    label = materialize(classes.join(label, "sig", "left").select("sig", F.col("first.doc_id").alias("doc_id"), "copies", F.coalesce("root", "sig").alias("root")))
    smallest = materialize(label.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    ids = label.join(smallest, "root").join(links, "sig", "left").select("sig", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    # classes with a large share of all rows are broadcast, fewer than HOT of them; the others' rows meet theirs by shuffle
    ids = materialize(ids)
    hot = materialize(ids.filter(F.col("n_copies") > n_rows / HOT))
    some = mine.filter("n > 0")
    cold = some.join(F.broadcast(hot.select("sig")), "sig", "left_anti").join(ids, "sig")
    out = cold.unionByName(some.join(F.broadcast(hot), "sig")).unionByName(mine.filter("n = 0"), allowMissingColumns=True)
    return out.select("doc_id", "row_hash", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).drop("row_hash")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component one row with the smallest doc_id, with the columns of docs.

    Rows without shingles link with nothing and stay. Of rows that repeat the smallest doc_id of a
    component with other texts the one with the smallest hash stays.
    """
    found = materialize(similar_documents(docs.select("doc_id", "text")))
    some = found.filter("n_shingles > 0")
    first = some.groupBy(F.coalesce(F.col("component_id").cast("string"), F.lit("none")).alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("f"))
    keep = materialize(first.select(F.col("f.row_hash").alias("h")).unionByName(found.filter("n_shingles = 0").select(F.col("row_hash").alias("h")).distinct()))
    name = free_name(docs, "row_hash")
    kept = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text"))).join(keep.withColumnRenamed("h", name), name, "left_semi")
    if not some.groupBy("row_hash").count().filter("count > 1").isEmpty():  # rows that repeat doc_id and text
        empty = F.coalesce(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")), F.lit("")) == ""
        kept = kept.filter(empty).unionByName(kept.filter(~empty).dropDuplicates([name]))
    return kept.drop(name)


def oracle_sql(n: int = N) -> str:
    return rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(0, len(w) - {n} + 1), lambda i: array_to_string(list_slice(w, i + 1, i + {n}), ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
e AS (SELECT r, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
reach(r, t) AS (SELECT r, r FROM s UNION SELECT reach.r, l.b FROM reach JOIN l ON reach.t = l.a),
low AS (SELECT reach.r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.t GROUP BY reach.r),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, CASE WHEN len(sh) = 0 THEN s.doc_id ELSE low.component_id END AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM s JOIN low ON low.r = s.r LEFT JOIN n ON n.a = s.r"""
