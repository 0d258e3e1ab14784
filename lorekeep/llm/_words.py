"""Words and word runs of whole Arrow batches as numpy arrays.

A text's words are the maximal runs of letters and digits of its NFKC,
lower-cased form.  Everything here works on the code points of many texts at
once; no Python loop runs over words.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

SLICE_CHARS = 1 << 20  # texts are taken together up to about so many characters
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = np.uint64(0x5851F42D4C957F2D)
ID_BITS = 44  # bits of a shingle id; the rest of a 64-bit key numbers the row in its slice


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@cache
def _is_word_char() -> np.ndarray:
    top = 0x32400  # no letters or digits are assigned above
    return np.fromiter((chr(c).isalnum() for c in range(top)), bool, top + 0)


@cache
def _powers(size: int) -> np.ndarray:
    p = np.full(size, _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def slices(texts: list[str | None]):
    """(first row, texts) of consecutive slices; nulls become empty texts."""
    at, chars, part = 0, 0, []
    for t in texts:
        t = t or ""
        if part and (chars + len(t) > SLICE_CHARS or len(part) >= 1 << 18):
            yield at, part
            at, chars, part = at + len(part), 0, []
        part.append(t)
        chars += len(t)
    if part:
        yield at, part


_HIGH = re.compile("[\u0300-\U0001ffff]{65}")  # all marks are above; much faster than _many_marks


@cache
def _many_marks() -> re.Pattern:
    """Over 64 characters in a row that are marks or decompose to marks."""
    top = 0x20000  # no marks with a combining class are assigned above
    marks = [c for c in map(chr, range(0x300, top)) if unicodedata.combining(c) or (unicodedata.decomposition(c) and unicodedata.combining(unicodedata.normalize("NFKD", c)[0]))]
    return re.compile(f"[{''.join(marks)}]{{65,}}")


def _in_order(m: re.Match) -> str:
    """The same marks by combining class, equal classes as they come; normalising alone would take their number squared."""
    return "".join(sorted("".join(unicodedata.normalize("NFKD", c) for c in m.group()), key=unicodedata.combining))


def _normal(t: str) -> str:
    """NFKC."""
    return t if t.isascii() else unicodedata.normalize("NFKC", _many_marks().sub(_in_order, t) if _HIGH.search(t) else t)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the number of its text, in order."""
    parts = [_normal(t) for t in texts]
    joined = "\0".join(parts)
    if joined.count("\0") != len(parts) - 1:
        joined = "\0".join(t.replace("\0", " ") for t in parts)
    cp = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _is_word_char()
    inside = table[np.minimum(cp, len(table) - 1)] & (cp < len(table))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    length = ends - starts
    first = np.cumsum(length) - length
    pos = np.arange(int(length.sum())) - np.repeat(first, length)
    value = (cp[inside].astype(np.uint64) + np.uint64(1)) * _M1 * _powers(1 << int(length.max()).bit_length())[pos]
    row = np.searchsorted(np.flatnonzero(cp == 0), starts)
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64)), row


def runs(word: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n consecutive words within a text, and the index of its first word."""
    if len(word) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = len(word) - n + 1
    h = np.zeros(last, np.uint64)
    for k in range(n):
        h = h * _M1 + word[k : k + last]
    at = np.flatnonzero(row[:last] == row[n - 1 :])
    return mix(h[at]), at


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of n words of each text: ids grouped by text in ascending order, and offsets."""
    h, at = runs(*(w := words(texts)), n)
    key = np.sort((w[1][at].astype(np.uint64) << np.uint64(ID_BITS)) | (h >> np.uint64(64 - ID_BITS)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    size = np.bincount((key >> np.uint64(ID_BITS)).astype(np.int64), minlength=len(texts))
    return (key & np.uint64((1 << ID_BITS) - 1)).astype(np.int64), np.concatenate(([0], np.cumsum(size)))
