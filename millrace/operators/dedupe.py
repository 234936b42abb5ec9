"""Exact dedup of documents or lines, of single documents or whole source groups.

Decisions are simultaneous: what loses still removes others. A unit (document or line) is won by the best rank that holds
it; a removal unit loses if any of its units has a better winner. Only hashes and identifiers are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.fields import Ordering
from millrace.operators.order import with_order
from millrace.operators.units import units
from millrace.scratch import Scratch


def exact_losers(active: DataFrame, order_by: Sequence[Ordering] = (), hash_column: str | None = None) -> DataFrame:
    """doc_id, kept of each document that a better one with the same text beats."""
    scratch = Scratch(active.sparkSession, "exact")
    rows = with_order(active, order_by, scratch).select("doc_id", F.col(hash_column or "content").alias("unit"), "_rank")
    first = rows.groupBy("unit").agg(F.min_by("doc_id", "_rank").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "unit").where("doc_id <> kept").select("doc_id", "kept")


def group_of(separator: str | None):
    """The removal unit of a document: itself, or the corpus and the key's prefix."""
    return F.struct("corpus_id", T.group_prefix(F.col("source_key"), separator).alias("prefix")) if separator else F.struct(F.col("doc_id"))


def unit_losers(active: DataFrame, algorithm: str = "line", order_by: Sequence[Ordering] = (), separator: str | None = None) -> DataFrame:
    """doc_id, kept, kept_start, kept_end, matched, matched_start, matched_end of each document that is removed.

    The witness is the least by the winner's rank, then matched id and start, then kept id and start. With a separator, all
    members of a group lose, by the group's witness.
    """
    scratch = Scratch(active.sparkSession, "units")
    rows = with_order(active.withColumn("_group", group_of(separator)), order_by, scratch)
    members = scratch.keep(rows.select("doc_id", "_group", "_rank"), "members")
    best = members.groupBy("_group").agg(F.min("_rank").alias("_best")) if separator else None
    with_best = members.join(best, "_group") if separator else members.withColumn("_best", F.col("_rank"))
    u = units(active, algorithm).groupBy("doc_id", "unit").agg(F.min(F.struct("start", "end")).alias("at"))  # a document's first of equal units
    u = scratch.keep(u.join(with_best.select("doc_id", "_group", "_best"), "doc_id"), "units")
    winner = u.groupBy("unit").agg(F.min(F.struct("_best", F.col("doc_id").alias("kept"), F.col("at").alias("kept_at"))).alias("w"), F.count("*").alias("n")).where("n > 1")
    lost = u.join(winner, "unit").where(F.col("w._best") < F.col("_best"))
    witness = F.min(F.struct(F.col("w._best").alias("rank"), F.col("doc_id").alias("matched"), F.col("at").alias("matched_at"), F.col("w.kept").alias("kept"), F.col("w.kept_at").alias("kept_at"))).alias("x")
    lost = lost.groupBy("_group").agg(witness)
    out = members.join(lost, "_group") if separator else lost.withColumn("doc_id", F.col("_group.doc_id"))
    return out.select("doc_id", "x.kept", F.col("x.kept_at.start").alias("kept_start"), F.col("x.kept_at.end").alias("kept_end"), "x.matched", F.col("x.matched_at.start").alias("matched_start"), F.col("x.matched_at.end").alias("matched_end"))


def evidence_groups(active: DataFrame, algorithm: str) -> DataFrame:
    """unit, n (documents and places) of the classes of equal units."""
    return units(active, algorithm).groupBy("unit").agg(F.count("*").alias("places"), F.countDistinct("doc_id").alias("documents"), F.min(F.struct("doc_id", "start", "end")).alias("first"))
