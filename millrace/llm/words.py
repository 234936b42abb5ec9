"""Words and shingles of Arrow text columns as 64-bit hashes, computed on whole buffers.

A word is a run of bytes of a class; its hash is a sum of random numbers chosen by byte, times powers by the place in the
word, mixed at the end. Texts are handled in slices of whole documents of about SLICE bytes, so arrays stay small; one
longer document is a slice of its own, whose bytes are handled in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
BYTE = _BYTE[_LOWER]  # A-Z as a-z
_P = np.uint64(0x9E3779B97F4A7C15)
GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Every byte but white space.
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 4096)
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P)], dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to `most` bytes together, one document at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _runs(data: np.ndarray, first: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unmixed hash, start and length of each run in a piece of bytes; runs end before each place in first."""
    inside = kind[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    at = np.flatnonzero(inside)
    head = np.searchsorted(at, starts)
    lengths = np.diff(np.r_[head, len(at)])
    place = np.arange(len(at)) - np.repeat(head, lengths)
    return np.add.reduceat(BYTE[data[at]] * _power(int(lengths.max()))[place], head), starts, lengths


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray = SOLID, piece: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, start, end (bytes) and document of each word; words end with their document.

    Bytes are handled in pieces, so a long text takes no more room than its words do. A word that a piece cuts is put together again.
    """
    first = np.unique(off[:-1][off[:-1] < off[1:]])
    sums, starts, lengths = [], [], []
    for lo in range(0, len(data), piece):
        hi = min(lo + piece, len(data))
        edges = first[np.searchsorted(first, lo) : np.searchsorted(first, hi)]
        s, at, n = _runs(data[lo:hi], edges - lo, kind)
        at = at + lo
        if len(at) and starts and len(starts[-1]) and at[0] == lo == starts[-1][-1] + lengths[-1][-1] and not (len(edges) and edges[0] == lo):
            sums[-1][-1:] += s[:1] * np.uint64(pow(int(_P), int(lengths[-1][-1]), 1 << 64))
            lengths[-1][-1] += n[0]
            s, at, n = s[1:], at[1:], n[1:]
        if len(at):
            sums.append(s)
            starts.append(at)
            lengths.append(n)
    if not starts:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    start, length = np.concatenate(starts), np.concatenate(lengths)
    return mix(np.concatenate(sums) + length.astype(np.uint64)), start, start + length, np.searchsorted(off, start, "right") - 1


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words from each word on; the last n - 1 entries run over what follows."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(min(n, len(hashes))):
        out[: len(hashes) - k] = out[: len(hashes) - k] * _P + mix(hashes[k:] + np.uint64(k + 1))
    return mix(out)


def sets(data: np.ndarray, off: np.ndarray, n: int, kind: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-word shingles of each document, end to end, and their n + 1 offsets.

    A document of fewer words has the whole sequence as its one shingle, one without words none.
    """
    h, _, _, doc = words(data, off, kind)
    docs = len(off) - 1
    count = np.bincount(doc, minlength=docs)
    at = np.r_[0, np.cumsum(count)]
    s = shingles(h, n)
    whole = np.arange(len(h)) - at[doc] + n <= count[doc]
    for d in np.flatnonzero((count > 0) & (count < n)):
        s[at[d]] = shingles(h[at[d] : at[d + 1]], int(count[d]))[0] + np.uint64(count[d])
        whole[at[d]] = True
    s, doc = s[whole], doc[whole]
    parts = np.r_[0, np.cumsum(np.bincount(doc, minlength=docs))]
    out = [np.unique(s[lo:hi]) for lo, hi in zip(parts[:-1], parts[1:], strict=True)]
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else s), np.r_[0, np.cumsum(sizes)]
