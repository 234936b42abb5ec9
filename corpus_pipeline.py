"""From documents to token sequences: language, exact copies, near copies, leaked benchmarks, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each result as Parquet in
the shared folder and reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, exact, langid, leaks, pieces, superminhash
from millrace.scratch import released

#: The corpus is to hold these; a document without letters, in another language or of doubtful language goes.
LANGUAGES, LEAST_SCORE = frozenset({"de", "en", "es", "fr"}), 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is, with a score of LEAST_SCORE or more, in one of LANGUAGES."""
    return langid.keep_languages(docs, languages=LANGUAGES, least=LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more."""
    return superminhash.drop_near(docs, shingle=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens, round_trip."""
    return pieces.encode_pieces(docs)


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", benchmark_leaks), ("sentencepiece", encode)]

#: Trained language models, near-duplicate components and alignments can't be written as SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with released():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
