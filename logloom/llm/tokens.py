"""Words and word hashes of whole Arrow batches, on their UTF-8 buffers with numpy.

A word is a run of bytes other than space and \\x09-\\x0D. A batch is worked off in blocks of
whole rows of about BLOCK bytes, so memory is bounded by the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: workers are used again, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Rows lo to hi of a batch: their bytes, and where each row begins and ends in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK) -> Iterator[Block]:
    """Null texts come as empty ones."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        own = data[at[lo] : at[hi]]
        yield Block(lo, hi, LOWER[own] if lower else own, at[lo : hi + 1] - at[lo])
        lo = hi


@dataclass
class Words:
    """Where the words of a block begin and end, and the row of each."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row, and one more: the number of words before


def words(block: Block) -> Words:
    inside = ~IS_SPACE[block.data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    edges = block.offsets[:-1]
    before[edges[edges < len(inside)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    ends = block.offsets[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, block.offsets)
    return Words(start, end, np.repeat(np.arange(block.n), np.diff(first)), first)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word, from 8 bytes at a time: words of up to 8 bytes never collide with each other."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,)) if len(data) else np.zeros(1, np.uint64)
    left = end - start
    h = mix(left.astype(np.uint64) * _MULT)
    some, at = np.arange(len(start)), start
    rest = left
    while len(some):
        piece = eight[at]
        short = rest < 8
        piece[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[some] = mix(h[some] ^ piece)
        more = rest > 8
        some, at, rest = some[more], at[more] + 8, rest[more] - 8
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each k consecutive values of h, whatever rows they belong to."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 16:
        out = h[:n].copy()
        for j in range(1, k):
            out = out * _MULT + h[j : j + n]
        return mix(out)
    base = int(_MULT)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), dtype=np.uint64, out=total[1:])
    back = powers(pow(base, -1, 1 << 64), n)
    return mix((total[k : k + n] - total[:n]) * back)


def within_rows(words: Words, k: int) -> np.ndarray:
    """The starts of the windows of k words that lie in one row."""
    n = len(words.start) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.row[:n] == words.row[k - 1 : k - 1 + n])


def counts_by_row(block: Block, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[block.offsets])
