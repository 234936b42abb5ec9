"""Words and word n-grams of Arrow text columns as 64-bit hashes, computed on whole buffers.

A word is a run of bytes that aren't white space; its hash is a sum of random numbers chosen by byte, times powers by the place
in the word, mixed at the end. Two seeds together tell words apart by 128 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
#: What Python's \s takes for white space, as bytes of UTF-8 (one byte, and several).
_WHITE_BYTES = [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]
_WHITE_MORE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SOLID = np.ones(256, bool)
_SOLID[_WHITE_BYTES] = False
_SEEDS = [np.random.Generator(np.random.PCG64(k)).integers(1, 1 << 63, 257, dtype=np.uint64) | np.uint64(1) for k in (71, 72)]
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(seed: int, n: int) -> np.ndarray:
    if len(_powers.get(seed, ())) < n:
        _powers[seed] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 4096) - 1, _SEEDS[seed][256])], dtype=np.uint64)
    return _powers[seed]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of ranges of whole texts of about `most` bytes; nulls are empty."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1))
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word; words end with their text."""
    z = np.zeros(0, np.int64)
    if not len(data):
        return z, z, z
    solid = _SOLID[data]
    if (data >= 0xC2).any():
        for m in _WHITE_MORE.finditer(data.tobytes()):
            solid[m.start() : m.end()] = False
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    edges = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    begin[edges] = solid[edges]
    stop[edges - 1] = solid[edges - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(off, start, "right") - 1


def words(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    head = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(head, length)
    own = data[np.repeat(start, length) + place]
    return mixed(np.add.reduceat(_SEEDS[seed][own] * _power(seed, int(length.max()))[place], head) + length.astype(np.uint64))


def grams(word: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of n words in a row, from each word on that has so many at or after it."""
    size = max(0, len(word) - n + 1)
    out, factor = np.zeros(size, np.uint64), _SEEDS[seed][256:257]
    for k in range(n):
        out = out * factor + word[k : k + size]
    return mixed(out)


def places(text: np.ndarray, n: int) -> np.ndarray:
    """The words from which n words of one text go on; text: of each word, in order."""
    size = max(0, len(text) - n + 1)
    return np.flatnonzero(text[:size] == text[n - 1 : n - 1 + size]) if size else np.zeros(0, np.int64)


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of each text, end to end, and their offsets."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, data, off in slices(column):
        start, end, text = spans(data, off)
        at = places(text, n)
        h, t = grams(words(data, start, end), n)[at], text[at]
        order = np.lexsort((h.view(np.int64), t))
        h, t = h[order], t[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])][: len(h)]
        parts.append(h[new])
        sizes.append(np.bincount(t[new], minlength=len(off) - 1))
    return np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))]
