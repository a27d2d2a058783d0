"""Counts over whole texts: characters, symbols, repeated lines and repeated word windows, all vectorised."""

from __future__ import annotations

import numpy as np

from strandweave.llm.textkernel import U, hashes, mix, prefix, spans, windows, SPACE


def lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = lut(b"#*$%&|<>")
UPPER, LOWER, DIGIT = lut(bytes(range(0x41, 0x5B))), lut(bytes(range(0x61, 0x7B))), lut(bytes(range(0x30, 0x3A)))
HIGH = lut(bytes(range(0x80, 0x100)))
POINT = ~lut(bytes(range(0x80, 0xC0)))  # the first byte of each code point
PUNCT = ~(UPPER | LOWER | DIGIT | HIGH | SPACE)
#: Lead bytes of UTF-8 by script; everything else is Latin or nothing.
SCRIPTS = {"greek": range(0xCE, 0xD0), "cyrillic": range(0xD0, 0xD4), "hebrew": range(0xD6, 0xD8), "arabic": range(0xD8, 0xDC), "indic": range(0xE0, 0xE2), "cjk": range(0xE3, 0xEA), "hangul": range(0xEA, 0xEE)}


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def counted(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each (text, key) comes, for each of them."""
    salted = mix(key + doc.astype(U) * U(0x9E3779B97F4A7C15))
    _, inverse, count = np.unique(salted, return_inverse=True, return_counts=True)
    return count[inverse]


def earlier(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the same (text, key) came before."""
    salted = mix(key + doc.astype(U) * U(0x9E3779B97F4A7C15))
    first = np.unique(salted, return_index=True)[1]
    out = np.ones(len(key), bool)
    out[first] = False
    return out


def stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: the base counts, and shares that describe its form."""
    n = len(offsets) - 1
    inside = ~SPACE[data]
    start, end, doc = spans(inside, offsets)
    sums = prefix(data)
    word = hashes(sums, start, end)
    points = POINT[data]
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": per_text(points & inside, offsets),
        "n_symbols": per_text(SYMBOL[data], offsets),
        "chars": per_text(points, offsets),
    }
    for name, flags in (("upper", UPPER), ("lower", LOWER), ("digit", DIGIT), ("punct", PUNCT), ("high", HIGH), ("pipe", lut(b"|")), ("bang", lut(b"!?")), ("stop", lut(b".,;:"))):
        out[name] = per_text(flags[data], offsets)
    # lines: from the start of a text or behind a line feed, to the next one or the text's end
    feed = np.flatnonzero(data == 0x0A)
    line_start = np.union1d(offsets[:-1], feed + 1)
    line_start = line_start[line_start < len(data)]
    next_feed = np.append(feed, len(data))[np.searchsorted(feed, line_start)]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(next_feed, offsets[line_doc + 1])
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    again = earlier(line_doc, hashes(sums, line_start, line_end))
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    key, at = windows(word, doc, 8)
    twice = at[counted(doc[at], key) > 1]
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 8, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    out["n_distinct"] = np.bincount(doc[~earlier(doc, word)], minlength=n)
    out["n_marked"] = np.bincount(doc[PUNCT[data[end - 1]] & ~lut(b".,;:")[data[end - 1]]], minlength=n)
    return out


def scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The script of most letters of each text, by lead bytes."""
    latin = per_text((UPPER | LOWER | lut(bytes(range(0xC3, 0xCA))))[data], offsets)
    counts = [latin] + [per_text(lut(bytes(r))[data], offsets) for r in SCRIPTS.values()]
    names = ["latin", *SCRIPTS]
    return [names[k] for k in np.argmax(np.array(counts), axis=0)]
