"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman scores them.

A seed is an n-gram of an item at any place, of the least n of SEED_WORDS whose information (by the frequencies of its
words in all documents) reaches RARE nats; so a seed is rare by chance, and an item that leaked into very many documents
keeps its seeds. Seeds are looked up at every word of every document; hits on near diagonals are one passage, which is
aligned with the item. The score is the alignment's, over the one of the item with itself.

Items come to the driver in blocks of BLOCK_BYTES of text at most and each block is one pass over the documents, which
shuffles nothing; however many items there are, none is left out. A GB of items would be about 125 passes. Each block's index rides
in the closure of its pass, a few times BLOCK_BYTES.

Places of an item where a gram occurs again and again are one interval, hits are held HITS at a time, and long windows are aligned in
pieces, so a text of any length and repetition is aligned in full in bounded memory beyond its own words.

Defined results: items without a word match nothing; an item shorter than the least n is seeded as a whole; null and empty
texts match nothing; repeated documents report each, repeated items too; a document and item with several matches report
the best, the first of equals. Empty tables give empty results. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as wd
from millrace.llm.common import pick, prepare, table
from millrace.llm.passages import MATCH, Passages, align, char_span, document_words, text_hashes

SEED_WORDS, RARE, MIN_SCORE, BLOCK_BYTES = (2, 3, 4, 6, 8), 18.0, 0.4, 8 << 20
_DDL = "doc_id long, item_id long, score double, matched_words long, item_words long, coverage double, char_start long, char_end long"


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") + 64
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _counts(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            for _, h, *_ in document_words(b.column(0)):
                total += len(h)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                n += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen]), pa.array(np.r_[total, n[seen]])], names=["word", "n"])

    return run


def seeded(block: list[tuple[int, str]], count_words) -> Passages:
    """count_words(sorted distinct word hashes) -> their counts in the corpus and the number of its words."""
    hashed = text_hashes([t for _, t in block])
    vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
    found = Passages()
    if not len(vocabulary):
        return found.freeze()
    n, total = count_words(vocabulary)
    info = np.log((total + 1) / (n + 1))
    for (item, _), h in zip(block, hashed, strict=True):
        for segment, part in found.add((item, len(h)), h):
            value = np.r_[0, np.cumsum(info[np.searchsorted(vocabulary, part)])]
            lengths = [k for k in SEED_WORDS if k < len(part)] or [len(part)]
            grams = {k: wd.shingles(part, k) for k in lengths}
            for place in range(len(part)):
                fit = [k for k in lengths if place + k <= len(part)]
                if fit:
                    k = next((k for k in fit if value[place + k] - value[place] >= RARE), None)
                    if k or len(part) <= SEED_WORDS[-1] or fit[-1] == lengths[-1]:
                        k = k or fit[-1]
                        found.seed(k, int(grams[k][place]), segment, place)
    return found.freeze()


def _scan(known: Passages, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for first, h, at, s, e, own, part in document_words(b.column(1)):
                best: dict[tuple[int, int], tuple] = {}
                for d, segment, low, high in known.clusters(h, at):
                    a = known.texts[segment]
                    pad = 4 + len(a) // 4
                    lo, hi = max(0, low - pad), min(int(at[d + 1] - at[d]), high + len(a) + pad)
                    score, equal, _, _, x, y = align(a, h[at[d] + lo : at[d] + hi])
                    if y > x and ((d, segment) not in best or score > best[d, segment][0]):
                        w = at[d] + lo
                        best[d, segment] = (score, equal, int(w + x), int(w + y))
                by: dict[tuple, list[tuple]] = {}
                for (d, segment), x in sorted(best.items()):
                    by.setdefault((d, known.owners[segment]), []).append(x)
                for (d, (item, size)), parts in by.items():
                    score = sum(x[0] for x in parts) / (MATCH * size)
                    if score >= min_score:
                        equal = sum(x[1] for x in parts)
                        span = char_span(own, int(part[d]), int(s[min(x[2] for x in parts)]), int(e[max(x[3] for x in parts) - 1]))
                        rows.append((b.column(0)[first + d].as_py(), item, round(score, 6), equal, size, round(equal / size, 6), *span))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _DDL.split(", ")])

    return run


def leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item of which the document holds a copy, edited or not; clean documents have none."""
    spark = prepare(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], _DDL)
    for known in known_passages(rows, pick(items, item_id=item_id, text=item_text)):
        out = out.unionByName(rows.mapInArrow(_scan(known, min_score), _DDL))
    return out


def known_passages(rows: DataFrame, items: DataFrame) -> Iterator[Passages]:
    def count(vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
        got = rows.select("text").mapInArrow(_counts(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a word of the block
        n = {r["word"]: r["n"] for r in got}
        return np.array([n.get(k, 0) for k in range(len(vocabulary))]), n.get(-1, 0)

    for block in _blocks(items.select(F.col("item_id").cast("long"), "text")):
        known = seeded(block, count)
        if known.texts:
            yield known


def _leaked(known: Passages, min_score: float):
    scan = _scan(known, min_score)

    @F.arrow_udf("boolean")
    def leaked(column: pa.Array) -> pa.Array:
        hit = np.zeros(len(column), bool)
        for out in scan(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(len(column))), column], names=["doc_id", "text"])])):
            hit[out.column(0).to_numpy()] = True
        return pa.array(hit)

    return leaked


def drop_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold a copy of an item; nothing is shuffled."""
    prepare(docs.sparkSession)
    rows = pick(docs, text=text)
    for known in known_passages(rows, pick(items, item_id=item_id, text=item_text)):
        docs = docs.where(~_leaked(known, min_score)(F.col(f"`{text}`")))
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
