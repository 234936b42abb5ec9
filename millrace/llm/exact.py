"""Exact dedup through a log-structured merge index of text digests.

Each task feeds the digests of its rows to a small index: a memtable flushes to sorted runs that carry Bloom filters,
and compaction merges runs block by block, keeping the smallest identifier of each digest and the number of rows. So a task
sends on one entry per digest, however many copies it read, and holds a block a run however many digests it meets. The runs meet
by digest and are compacted once more; digests of several rows are groups. A filter over the digests of groups is asked in the scan of
the texts, and only the texts that pass it are shuffled, equal ones of a task once: a digest with several texts is decided by their bytes.

Defined results: null texts count as empty, and empty or white texts form one group. Row order is (most code points,
smallest doc_id, null ids last). A row that repeats another, id included, counts in group_size and reports the same
decision. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, by_ids, fresh, pick, table
from millrace.llm.filters import Bloom, passes

WHITE = " \t\n\x0b\x0c\r"
NO_ID = (1 << 63) - 1  # where an id is null


class Run:
    """Sorted keys with their smallest identifier (rank, id) and count, and a filter over the keys. In a folder the arrays lie in mapped files."""

    def __init__(self, blocks: Iterable[list[np.ndarray]], most: int, folder: str | None):
        """blocks: consecutive parts of keys, rank, ids, count; at most `most` keys together."""
        self.filter, files = Bloom.sized(most), []
        if folder:
            files = [tempfile.NamedTemporaryFile(dir=folder, delete=False) for _ in range(4)]
        parts: list[list[np.ndarray]] = [[] for _ in range(4)]
        for block in blocks:
            self.filter.add(*_halves(block[0]))
            for i, x in enumerate(block):
                if files:
                    files[i].write(x.tobytes())
                else:
                    parts[i].append(x)
        kinds = ["S33", np.int64, np.int64, np.int64]
        self.arrays = [np.concatenate([np.zeros(0, k), *x]) for k, x in zip(kinds, parts, strict=True)]
        for i, f in enumerate(files):
            f.close()
            if os.path.getsize(f.name):
                self.arrays[i] = np.memmap(f.name, kinds[i], "r")

    def __len__(self):
        return len(self.arrays[0])


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), keys.itemsize)[:, :16]).view("<u8")
    return both[:, 0], both[:, 1]


class MergeIndex:
    """digest -> (smallest identifier, rows). fanout runs of a level are compacted into one of the next."""

    def __init__(self, memtable: int = 1 << 15, fanout: int = 4, folder: str | None = None):
        self.memtable, self.fanout, self.folder = memtable, fanout, folder
        self.fresh: dict[bytes, tuple[int, int, int]] = {}
        self.levels: list[list[Run]] = [[]]

    def put(self, digest: bytes, rank: int, ident: int, count: int = 1) -> None:
        if old := self.fresh.get(digest):
            self.fresh[digest] = (*min(old[:2], (rank, ident)), old[2] + count)
        else:
            self.fresh[digest] = (rank, ident, count)
            if len(self.fresh) >= self.memtable:
                self.flush()

    def flush(self) -> None:
        if self.fresh:
            keys = np.array([k + b"\x01" for k in self.fresh], "S33")  # the mark saves trailing zero bytes
            values = np.array(list(self.fresh.values()), np.int64).reshape(-1, 3)
            self.fresh, order = {}, np.argsort(keys)
            self.levels[0].append(Run([[keys[order], *values[order].T]], len(keys), self.folder))
            for level, runs in enumerate(self.levels):
                if len(runs) >= self.fanout:
                    if level + 1 == len(self.levels):
                        self.levels.append([])
                    self.levels[level + 1].append(self._merged(runs))
                    self.levels[level] = []

    def _merged(self, runs: list[Run]) -> Run:
        return Run(self._blocks(runs), sum(map(len, runs)), self.folder)

    def _blocks(self, runs: list[Run]) -> Iterator[list[np.ndarray]]:
        """The runs merged, about memtable entries of each at a time: all keys up to the least of the runs' next limits."""
        at = [0] * len(runs)
        while any(p < len(r) for p, r in zip(at, runs, strict=True)):
            limit = min(r.arrays[0][min(p + self.memtable, len(r)) - 1] for p, r in zip(at, runs, strict=True) if p < len(r))
            to = [int(np.searchsorted(r.arrays[0], limit, "right")) for r in runs]
            keys, rank, ids, count = (np.concatenate([r.arrays[i][p:q] for p, q, r in zip(at, to, runs, strict=True)]) for i in range(4))
            at = to
            order = np.lexsort((ids, rank, keys))
            keys, rank, ids, count = keys[order], rank[order], ids[order], count[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            yield [keys[first], rank[first], ids[first], np.add.reduceat(count, first)]

    def compact(self) -> Run | None:
        self.flush()
        if runs := [r for level in self.levels for r in level]:
            self.levels = [[self._merged(runs)]]
            return self.levels[0][0]
        return None

    def get(self, digest: bytes) -> tuple[int, int, int] | None:
        found = [self.fresh[digest]] if digest in self.fresh else []
        key = np.array([digest + b"\x01"], "S33")
        for run in (r for level in self.levels for r in level):
            if run.filter.may_hold(*_halves(key))[0] and (at := int(np.searchsorted(run.arrays[0], key[0]))) < len(run) and run.arrays[0][at] == key[0]:
                found.append(tuple(int(x[at]) for x in run.arrays[1:]))
        return (*min(f[:2] for f in found), sum(f[2] for f in found)) if found else None


_ENTRY = pa.schema([("digest", pa.binary()), ("rank", pa.int64()), ("ident", pa.int64()), ("count", pa.int64())])
_ENTRY_DDL = "digest binary, rank long, ident long, count long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with tempfile.TemporaryDirectory() as folder:  # the task's own runs; they go with the task
        index = MergeIndex(folder=folder)
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                index.put(*row)
        if run := index.compact():
            for lo in range(0, len(run), 20_000):
                keys, *rest = (x[lo : lo + 20_000] for x in run.arrays)
                yield pa.RecordBatch.from_arrays([pa.array([bytes(k)[:-1] for k in keys], pa.binary()), *(pa.array(np.asarray(x)) for x in rest)], schema=_ENTRY)
        del index, run


def merge_index(entries: DataFrame) -> DataFrame:
    """entries: digest, rank, ident, count, from rows or from earlier indexes; one row per digest comes back."""
    partial = entries.select("digest", "rank", "ident", "count").mapInArrow(_index, _ENTRY_DDL)
    return partial.repartition("digest").mapInArrow(_index, _ENTRY_DDL)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; doc_id is an integer column."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    whole = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    plain = F.translate("text", WHITE, "")
    rows = scratch.keep(whole.select("doc_id", F.unhex(F.sha2(plain, 256)).alias("digest"), (-F.length("text")).cast("long").alias("rank")), "rows")
    ident = F.coalesce("doc_id", F.lit(NO_ID)).alias("ident")
    groups = scratch.keep(merge_index(rows.select("digest", "rank", ident, F.lit(1).cast("long").alias("count"))).where("count > 1"), "groups")

    # Of a digest that more rows have, each task sends on every text once, however many copies it read; only digests are stored.
    may = passes(groups.select("digest"))
    texts = whole.select(F.unhex(F.sha2(plain, 256)).alias("digest"), plain.alias("plain")).where(may(F.col("digest")))
    clash = scratch.keep(texts.distinct().groupBy("digest").count().where("count > 1").select("digest"), "clash")
    found = rows.join(groups.select("digest", "ident", "count"), "digest", "left")
    if clash.isEmpty():  # else two texts share a digest
        return _decided(found)
    return _decided(found.join(clash, "digest", "left_anti")).unionByName(_by_text(whole, plain, clash))


def _by_text(whole: DataFrame, plain, other: DataFrame) -> DataFrame:
    """The rows of digests that several texts share, grouped by the bytes themselves."""
    rows = whole.select("doc_id", plain.alias("plain"), F.unhex(F.sha2(plain, 256)).alias("digest"), (-F.length("text")).cast("long").alias("rank"))
    rows = rows.join(other.select("digest").distinct(), "digest", "left_semi")
    ident = F.coalesce("doc_id", F.lit(NO_ID))
    best = rows.groupBy("plain").agg(F.min(F.struct("rank", ident.alias("ident"))).alias("b"), F.count("*").alias("count"))
    return _decided(rows.join(best.select("plain", "b.ident", "count"), "plain"))


def _decided(found: DataFrame) -> DataFrame:
    keep = F.when(F.col("ident").isNull(), F.col("doc_id")).when(F.col("ident") == NO_ID, F.lit(None)).otherwise(F.col("ident"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("count", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows that exact_dedup drops; of the rows of an equal text with the id that stays, one stays. Rows without an id stay.

    Where ids are distinct, decisions go by id. Rows of an id that several rows have are decided on by (id, digest), so another text of
    the id isn't touched; only those rows are hashed again.
    """
    scratch = Scratch(docs.sparkSession, "exact-kept")
    found = scratch.keep(exact_dedup(docs, text, doc_id).where("doc_id is not null").select("doc_id", "kept", F.unhex("text_sha256").alias("digest")), "found")
    twice = scratch.keep(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    several = not twice.isEmpty()
    lost = found.where("not kept").select("doc_id")
    lost = scratch.keep(lost.unionByName(twice).distinct() if several else lost, "lost")
    once = by_ids(docs, lost, doc_id, "left_anti")
    if not several:
        return once
    rows, here, ident, there = by_ids(docs, twice, doc_id, "left_semi"), fresh(docs, "_digest"), fresh(docs, "_ident"), fresh(docs, "_group")
    rows = rows.withColumn(here, F.unhex(F.sha2(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), WHITE, ""), 256)))
    stay = found.where("kept").select("doc_id", "digest").join(twice, "doc_id", "left_semi").distinct().toDF(ident, there)
    own = rows.join(stay.hint("merge"), (F.col(f"`{doc_id}`").cast("long") == F.col(ident)) & (F.col(here) == F.col(there)))
    return once.unionByName(own.dropDuplicates([ident, there]).select(*docs.columns))


def digest_of(text: str | None) -> bytes:
    return hashlib.sha256((text or "").translate(dict.fromkeys(map(ord, WHITE))).encode()).digest()


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
w AS (SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(text) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY plain) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM w
"""
