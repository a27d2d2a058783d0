"""Vectorised text primitives: words, lines, shingles and their 64-bit hashes over the bytes of an Arrow string column.

A hash of a byte range is the difference of two prefix sums of ``byte * BASE**position`` (mod 2**64), multiplied back by
the inverse power of its start, so one pass over the bytes hashes every word or line of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
STEP = U(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a term: ASCII letters and digits, and every byte of other scripts.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower case of ASCII letters.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((BASE, BASE_INV)):
            step = np.full(size, U(base), U)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and their offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most that many bytes (one text may be longer), so that work arrays stay bounded."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs where ``inside`` holds, cut at text borders."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def prefix(data: np.ndarray) -> np.ndarray:
    power, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * STEP)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text numbers and hashes of all words."""
    start, end, doc = spans(~SPACE[data], offsets)
    return start, end, doc, hashes(prefix(data), start, end)


def windows(word_hash: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of so many words within one text, and the number of the first word of each."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(n, U)
    for k in range(width):
        total = total * STEP + word_hash[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return mix(total[at] + U(width)), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words is one shingle; one without words has none."""
    _, _, doc, word_hash = words(data, offsets)
    shingle, at = windows(word_hash, doc, width)
    n = len(offsets) - 1
    bounds = np.searchsorted(doc[at], np.arange(n + 1))
    of_word = np.searchsorted(doc, np.arange(n + 1))
    for k in range(n):
        own = shingle[bounds[k] : bounds[k + 1]]
        if len(own):
            yield np.unique(own)
        elif of_word[k] < of_word[k + 1]:
            total = U(of_word[k + 1] - of_word[k])
            with np.errstate(over="ignore"):
                for h in word_hash[of_word[k] : of_word[k + 1]]:
                    total = total * STEP + h
            yield mix(np.array([total]))
        else:
            yield np.zeros(0, U)
