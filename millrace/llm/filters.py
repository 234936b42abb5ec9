"""Bloom filters of bounded size over distributed keys, so that a scan can leave out rows which surely meet none of them.

A filter has BITS a key up to MOST bits in all; with more keys, more rows pass in vain and none is lost, as all that pass are
joined afterwards. Each task sets bits of its own, which meet by word as a bitwise or, and the driver holds one filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as wd
from millrace.llm.common import prepare

BITS, PROBES, MOST = 12, 7, 1 << 28


class Bloom:
    """Double hashing; keys are pairs of 64-bit words. size is a power of two of at least 64."""

    def __init__(self, size: int, words: np.ndarray | None = None):
        self.size, self.words = size, np.zeros(size // 64, np.uint64) if words is None else words

    @classmethod
    def sized(cls, keys: int, most: int = MOST) -> Bloom:
        return cls(min(most, max(64, 1 << (BITS * keys).bit_length())))

    def _places(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(PROBES):
            at = (a + np.uint64(k) * (b | np.uint64(1))) & np.uint64(self.size - 1)
            yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for at, bit in self._places(a, b):
            np.bitwise_or.at(self.words, at, bit)

    def may_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), bool)
        for at, bit in self._places(a, b):
            found &= self.words[at] & bit != 0
        return found


def of_digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of digests of one length; a null is a digest of zeros."""
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = len(next((x for x in column if x.is_valid), pa.scalar(bytes(16))).as_py())
    data = np.frombuffer(b"".join(column.fill_null(bytes(width)).to_pylist()), np.uint8).reshape(-1, width)[:, :16]
    both = np.ascontiguousarray(data).view("<u8")
    return both[:, 0], both[:, 1]


def of_longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each number; null is 0."""
    x = wd.mix(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + wd.GOLD)
    return x, wd.mix(x + wd.GOLD)


def bloom(keys: DataFrame, most: int = MOST) -> Bloom:
    """Over the one column of keys, of numbers or digests."""
    prepare(keys.sparkSession)
    pairs, size = _pairs(keys), Bloom.sized(keys.count(), most).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(size)
        for b in batches:
            own.add(*pairs(b.column(0)))
        at = np.flatnonzero(own.words)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own.words[part].view(np.int64))], names=["at", "bits"])

    got = keys.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # at most MOST / 64 rows
    out = Bloom(size)
    out.words[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _pairs(df: DataFrame) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    return of_digests if df.schema[0].dataType.typeName() == "binary" else of_longs


def passes(keys: DataFrame, most: int = MOST) -> Callable[[Column], Column]:
    """A test of a column: false only where no key equals it."""
    made, pairs = bloom(keys, most), _pairs(keys)
    held = keys.sparkSession.sparkContext.broadcast((made.size, made.words))

    @F.arrow_udf("boolean")
    def may_hold(column: pa.Array) -> pa.Array:
        return pa.array(Bloom(*held.value).may_hold(*pairs(column)))

    return may_hold
