"""Fields derived from single documents: text statistics, and columns that models or other tables supply.

Statistics are built-in functions only. Word statistics take words as runs of what isn't white space, stripped of
punctuation; the tokenizer of the original field definitions isn't available here, so values can differ from it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.model import ranked
from millrace.scratch import Scratch

# The punctuation that counts, and common English words.
PUNCTUATION = "!/—”:％１〈&(、━\\【#%「」，】；+^]~“《„';’{|∶´[=-`*．（–？！：$～«〉,><》)?）。…@_.\"}►»"
STOP_WORDS = "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she that the their them there they this to was we were which will with would you".split()


class Producer(Protocol):
    """Adds columns to documents; a result may hang on a document's text alone."""

    schema: str

    def __call__(self, docs: DataFrame) -> DataFrame: ...


def _share(text: Column, pattern: str) -> Column:
    """Characters that match, over all; null for an empty text."""
    return F.when(F.length(text) > 0, (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.length(text))


def document_statistics(text: Column) -> dict[str, Column]:
    ellipses = (F.length(text) - F.length(F.regexp_replace(text, r"\.\.\.|…", ""))) / 3
    n = F.length(text)
    escaped = "".join("\\" + c if c in "\\]^-[&" else c for c in PUNCTUATION)
    return {
        "length": n.cast("long"),
        "white_space_ratio": _share(text, r"(?U)\s"),
        "non_alpha_digit_ratio": _share(text, r"[^\p{L}\p{N}]"),
        "digit_ratio": _share(text, r"\p{Nd}"),
        "uppercase_ratio": _share(text, r"\p{Lu}"),
        "elipsis_ratio": F.when(n > 0, ellipses / n),
        "punctuation_ratio": _share(text, f"[{escaped}]"),
    }


def word_statistics(text: Column) -> Column:
    """One struct, so that words are cut once."""

    def of(w: Column) -> Column:
        n = F.size(w)
        chars = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
        share = lambda test: F.when(n > 0, F.size(F.filter(w, test)) / n)
        stop = F.array(*map(F.lit, STOP_WORDS))
        return F.struct(
            n.cast("long").alias("n_words"), F.when(n > 0, chars / n).alias("avg_word_length"), share(lambda x: F.length(x) <= 3).alias("short_word_ratio_3"),
            share(lambda x: F.length(x) >= 7).alias("long_word_ratio_7"), F.when(n > 0, F.size(F.array_distinct(w)) / n).alias("type_token_ratio"),
            share(lambda x: (F.upper(x) == x) & x.rlike(r"\p{L}")).alias("uppercase_word_ratio"), share(lambda x: x.rlike(r"^\p{Lu}")).alias("capitalized_word_ratio"),
            share(lambda x: F.array_contains(stop, F.lower(x))).alias("stop_word_ratio"),
        )

    return T.let(T.words(text), of)


def with_statistics(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    lines = F.greatest(F.size(T.lines(text)), F.lit(1))
    both = docs.withColumns(document_statistics(text)).withColumn("_w", word_statistics(text))
    return both.withColumn("avg_words_per_line", F.col("_w.n_words") / lines).select("*", "_w.*").drop("_w")


def from_pandas(name: str, kind: str, compute: Callable[[pd.Series], pd.Series]) -> Callable[[DataFrame], DataFrame]:
    """A model as a producer: texts of an Arrow batch in, values out; null is an explicit outcome."""
    udf = F.pandas_udf(compute, kind)
    return lambda docs: docs.withColumn(name, udf(F.col("text")))


def joined(docs: DataFrame, values: DataFrame, columns: Sequence[str], on: str = "doc_id", complete: bool = False) -> DataFrame:
    """Columns computed elsewhere, by document or content. complete: a document without a row is an error."""
    both = docs.join(values.select(on, *columns, F.lit(True).alias("_there")), on, "left")
    if complete:
        gap = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no values for "), F.col(on).cast("string"))).cast("string"))
        both = both.where(gap.isNull())
    return both.drop("_there")


def language_label(scores: Column, codes: Sequence[str]) -> Column:
    """Scores cut to 0 to 1; the first greatest code."""
    return T.top_class(F.transform(scores, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))), codes)


def windowed_mean(windows: Column) -> Column:
    """The mean of struct(score, weight) by weight; null without weight."""
    total = F.aggregate(windows, F.lit(0.0), lambda a, w: a + w["weight"])
    return F.aggregate(windows, F.lit(0.0), lambda a, w: a + w["score"] * w["weight"]) / F.when(total > 0, total)


def in_cohorts(docs: DataFrame, key: str, compute: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int = 64) -> DataFrame:
    """compute over fixed cohorts of `size` documents in order of key, for models whose values depend on what shares their batch.

    Cohorts come from ranks, so they are the same however rows are partitioned; the last may be smaller. compute sees a cohort's
    rows in that order, with `cohort`.
    """
    if size < 1:
        raise ValueError("a cohort has one document at least")
    placed = ranked(docs, [F.col(key)], Scratch(docs.sparkSession, "cohorts"), "_rank").withColumn("cohort", F.floor(F.col("_rank") / size))
    return placed.groupBy("cohort").applyInPandas(lambda rows: compute(rows.sort_values("_rank").drop(columns="_rank")), schema)
