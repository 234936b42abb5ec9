"""Removal of what reference snapshots hold: whole documents that share a unit, or only the shared spans.

The reference side becomes one row a unit with its least witness (id, start, end) and is stored, so its size is known before
the join: up to SMALL units it is broadcast and no unit of the documents is shuffled; beyond that units are merge-joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.units import coalesce, units
from millrace.scratch import Scratch


#: Units of less than 100 bytes each, so at most some 50 MB.
SMALL = 500_000


def _shared(docs: DataFrame, references: DataFrame, algorithm: str, n: int, witness: bool) -> DataFrame:
    """Units of docs that a reference has too, with w (the least id, start, end that has it) if a witness is asked for.

    Few n-grams of references are told to all tasks, so only hits leave the scan of docs.
    """
    known = units(references, algorithm, n).groupBy("unit").agg(F.min(F.struct(F.col("doc_id").alias("id"), "start", "end")).alias("w"))
    stored = Scratch(known.sparkSession, "reference").keep(known if witness else known.select("unit"), "units")
    if stored.count() > SMALL:
        return units(docs, algorithm, n).join(stored.hint("merge"), "unit")
    first = None
    if algorithm == "ngram":
        halves = stored.select(F.substring("unit", 1, 8).alias("h")).toArrow().column("h").combine_chunks().to_pylist()  # at most SMALL rows
        first = np.unique(np.frombuffer(b"".join(halves), "<u8"))
    return units(docs, algorithm, n, first).join(F.broadcast(stored), "unit")


def matches(docs: DataFrame, references: DataFrame, algorithm: str = "ngram", n: int = 13) -> DataFrame:
    """doc_id, start, end, ref_id, ref_start, ref_end of every unit that a reference document has too."""
    return _shared(docs, references, algorithm, n, True).select("doc_id", "start", "end", F.col("w.id").alias("ref_id"), F.col("w.start").alias("ref_start"), F.col("w.end").alias("ref_end"))


def contaminated(docs: DataFrame, references: DataFrame, algorithm: str = "ngram", n: int = 13) -> DataFrame:
    """doc_id of documents with any shared unit."""
    return _shared(docs, references, algorithm, n, False).select("doc_id").distinct()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["doc_id", "retained_text", "ranges", "removed_spans", "removed_bytes"], [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64()]
    for b in batches:
        rows = []
        for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data, gone = text.encode(), coalesce((x["start"], x["end"]) for x in found)
            edges = [0, *[x for span in gone for x in span], len(data)]
            kept = [(edges[k], edges[k + 1]) for k in range(0, len(edges), 2) if edges[k] < edges[k + 1]]
            rows.append((b"".join(data[s:e] for s, e in kept).decode(), [{"start": s, "end": e} for s, e in kept], len(gone), sum(e - s for s, e in gone)))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def cut_spans(docs: DataFrame, references: DataFrame, algorithm: str = "ngram", n: int = 13) -> DataFrame:
    """doc_id, retained_text, ranges, removed_spans, removed_bytes of the documents with matches; one all gone keeps an empty text."""
    found = matches(docs, references, algorithm, n).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(found, "doc_id").select("doc_id", "text", "found").mapInArrow(_cut, f"doc_id {kind}, retained_text string, ranges array<struct<start:long,end:long>>, removed_spans long, removed_bytes long")


def retained(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """docs with spans removed: text, n_bytes and n_chars of what is left, and its ranges (null: untouched)."""
    both = docs.join(cuts.select("doc_id", "retained_text", "ranges"), "doc_id", "left")
    text = F.coalesce("retained_text", "text")
    return both.withColumns({"text": text, "n_bytes": T.n_bytes(text), "n_chars": T.n_chars(text)}).drop("retained_text")


def statistics(docs: DataFrame, references: DataFrame, algorithm: str = "ngram", n: int = 13, granularity: str = "document") -> DataFrame:
    """matched_documents, removed_documents, removed_spans, removed_bytes."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    cuts = scratch.keep(cut_spans(docs, references, algorithm, n).select("removed_spans", "removed_bytes"), "cuts")
    whole = granularity == "document"
    return cuts.agg(F.count("*").alias("matched_documents"), (F.count("*") if whole else F.lit(0).cast("long")).alias("removed_documents"), F.coalesce(F.sum("removed_spans"), F.lit(0)).alias("removed_spans"), F.coalesce(F.sum("removed_bytes"), F.lit(0)).alias("removed_bytes"))
