"""Populations: documents with their identity, sizes and origins; unions; distributed ranks and running sums.

A population has doc_id, corpus_id, source_key, text, content (SHA-256 of the text), n_bytes and n_chars, and any fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.scratch import Scratch

CORE = ("doc_id", "corpus_id", "source_key", "text", "content", "n_bytes", "n_chars")


def population(df: DataFrame, doc_id: str | Column = "doc_id", corpus: str | Column = "source", key: str | Column | None = None, text: str = "text", fields: tuple[str, ...] = ()) -> DataFrame:
    """Null texts count as empty. Without a key the identifier is the key."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        col(doc_id).alias("doc_id"), col(corpus).alias("corpus_id"), (col(doc_id) if key is None else col(key)).cast("string").alias("source_key"),
        body.alias("text"), T.content(body).alias("content"), T.n_bytes(body).alias("n_bytes"), T.n_chars(body).alias("n_chars"), *fields,
    )


def document_id(corpus: Column, key: Column, text: Column) -> Column:
    """An identifier of corpus, key and text, each after its length."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(part(corpus), part(key), part(text)), 256)


def union(snapshots: dict[str, DataFrame]) -> DataFrame:
    """Distinct documents of several snapshots (by name) with the sorted names of those that hold each."""
    parts = [df.withColumn("origin", F.lit(name)) for name, df in sorted(snapshots.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    rest = [c for c in both.columns if c not in ("doc_id", "origin")]
    return both.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in rest], F.sort_array(F.collect_set("origin")).alias("origins"))


#: Up to so many identifiers are broadcast, a hundred bytes each at most.
FEW = 1 << 18


def few(stored: DataFrame) -> DataFrame:
    """A stored table of a row a document, to join with: broadcast while it is small, so that no text is shuffled; else merge-joined."""
    return F.broadcast(stored) if stored.count() <= FEW else stored.hint("merge")


def ranked(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "rank") -> DataFrame:
    """df with a column `name`, 0 to n - 1 in the order: sorted ranges, and what the ranges before hold. No task sees all rows."""
    at = F.monotonically_increasing_id()
    kept = scratch.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), f"sorted-{name}")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_p long, _before long")
    return kept.join(F.broadcast(offsets), part == F.col("_p")).withColumn(name, F.col("_before") + local).drop("_p", "_before", "_at")


def running(df: DataFrame, order: list[Column], size: str, scratch: Scratch, name: str = "before") -> DataFrame:
    """df with a column `name`: the sum of size over the rows before, in the order; in two levels, like ranked()."""
    kept = scratch.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), f"sorted-{name}")
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    sums = sorted((r["p"], r["n"]) for r in kept.groupBy(F.col("_part").alias("p")).agg(F.sum(size).alias("n")).collect())
    before, total = [], 0
    for p, n in sums:
        before.append((p, total))
        total += n or 0
    offsets = df.sparkSession.createDataFrame(before, "_p long, _before long")
    local = F.coalesce(F.sum(size).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return kept.withColumn(name, local).join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn(name, (F.col("_before") + F.col(name)).cast("long")).drop("_p", "_before", "_at", "_part")
