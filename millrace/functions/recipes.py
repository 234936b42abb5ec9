"""Published preprocessing recipes as filters over documents (doc_id, text): quality and repetition rules, line cleanup, resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.functions import text as T

# Published word lists, thresholds and source shares.
#: Words of which a natural English text has two at least.
NATURAL = ("the", "be", "to", "of", "and", "that", "have", "with")
#: Greatest shares: repeated lines and paragraphs, by number and by characters; the top n-gram; all repeated n-grams.
LINES, LINE_CHARS = 0.3, 0.2
TOP = {2: 0.2, 3: 0.18, 4: 0.16}
REPEATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.1}
#: Shares by source of published mixtures; those of gpt3 add up to more than one as reported.
WEIGHTS = {
    "t5": {"c4": 1.0},
    "gopher": {"web": 0.48, "books": 0.27, "c4": 0.1, "news": 0.1, "code": 0.03, "wiki": 0.02},
    "falcon": {"web_en": 0.76, "web_europe": 0.08, "books": 0.06, "conversations": 0.05, "code": 0.03, "technical": 0.02},
    "llama": {"common_crawl": 0.67, "c4": 0.15, "code": 0.045, "wiki": 0.045, "books": 0.045, "arxiv": 0.025, "stack_exchange": 0.02},
    "gpt3": {"common_crawl": 0.6, "webtext": 0.22, "books1": 0.08, "books2": 0.08, "wiki": 0.03},
}


def source_weights(model: str) -> dict[str, float]:
    """Shares that sum to one."""
    total = math.fsum(WEIGHTS[model].values())
    return {k: w / total for k, w in WEIGHTS[model].items()}


def quality_checks(text: Column) -> Column:
    """One struct of the measured values."""

    def of(w: Column) -> Column:
        n = F.nullif(F.size(w), F.lit(0))  # a text without words has no shares, and doesn't pass
        lines = F.split(text, "\n")
        symbols = F.size(F.filter(w, lambda x: x.contains("#"))) + F.size(F.filter(w, lambda x: x.contains("...") | x.contains("…")))
        return F.struct(
            n.alias("words"), (F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / n).alias("mean_length"), (symbols / n).alias("symbols"),
            (F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[•-]"))) / F.size(lines)).alias("bullets"), (F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))) / F.size(lines)).alias("ellipses"),
            (F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))) / n).alias("alpha"), F.size(F.array_intersect(w, F.array(*map(F.lit, NATURAL)))).alias("natural"),
        )

    return T.let(T.words(text), of)


def gopher_quality(docs: DataFrame) -> DataFrame:
    q = docs.withColumn("_q", quality_checks(F.col("text")))
    return q.where("_q.words between 50 and 100000 and _q.mean_length between 3 and 10 and _q.symbols <= 0.1 and _q.bullets <= 0.9 and _q.ellipses <= 0.3 and _q.alpha >= 0.8 and _q.natural >= 2").drop("_q")


def _repeats(parts: Column, chars: Column) -> tuple[Column, Column]:
    """Shares of parts beyond the first of their kind, by number and by characters."""
    distinct = F.array_distinct(parts)
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return (F.size(parts) - F.size(distinct)) / F.greatest(F.size(parts), F.lit(1)), (size(parts) - size(distinct)) / F.greatest(chars, F.lit(1))


def _gram_shares(column: pa.Array) -> np.ndarray:
    """By text, the worst ratio of its repeated n-grams to their limits.

    A gram is numbered by the number of its first n - 1 words and its last word, so equal numbers are equal grams of one text;
    only places whose shorter gram repeats go on.
    """
    worst = np.zeros(len(column))
    for first, data, off in hashing.slices(column):
        start, end, text = hashing.spans(data, off)
        if not len(start):
            continue
        heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters before each byte
        here, chars = worst[first : first + len(off) - 1], np.maximum(np.diff(heads[off]), 1)
        before = np.r_[0, np.cumsum(heads[end] - heads[start])]  # characters of the words before each word
        known, word = np.unique(hashing.words(data, start, end), return_inverse=True)
        at, gram = np.arange(len(text)), text * len(known) + word
        for n in range(2, max(*TOP, *REPEATED) + 1):
            on = at + n - 1 < len(text)
            on[on] = text[at[on]] == text[at[on] + n - 1]
            at = at[on]
            _, place, gram, times = np.unique(gram[on] * len(known) + word[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
            again = times > 1
            head, k = at[place[again]], times[again]
            by, size = text[head], before[head + n] - before[head] + n - 1
            amount = np.zeros(len(here), np.int64)
            if n in TOP:
                order = np.lexsort((size, k, by))  # the last of a text is its most frequent, of those the longest
                amount[by[order]] = (k * size)[order]
            else:
                np.add.at(amount, by, (k - 1) * size)
            np.maximum(here, amount / chars / (TOP | REPEATED)[n], out=here)
            at, gram = at[again[gram]], gram[again[gram]]
    return worst


def repetition_shares(docs: DataFrame) -> DataFrame:
    """doc_id with the worst ratio to its limit; a document passes with at most 1. Grams are counted where the document is, so none is shuffled."""
    text, n = F.col("text"), F.length("text")
    lines = F.filter(F.split(F.trim(text), r"\n+"), lambda x: x != "")
    paragraphs = F.filter(F.split(F.trim(text), r"\n{2,}"), lambda x: x != "")
    ratios = []
    for parts in (paragraphs, lines):
        number, chars = _repeats(parts, n)
        ratios += [number / LINES, chars / LINE_CHARS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.maximum(flat, _gram_shares(b.column(2))))], names=["doc_id", "worst"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.greatest(*ratios), F.lit(0.0)).alias("worst"), "text").mapInArrow(run, f"doc_id {kind}, worst double")


def gopher_repetition(docs: DataFrame) -> DataFrame:
    return docs.join(repetition_shares(docs).where("worst <= 1").select("doc_id"), "doc_id", "left_semi")


def c4_lines(docs: DataFrame, min_sentences: int = 3, min_words: int = 5, blocked: tuple[str, ...] = ()) -> DataFrame:
    """docs with lines cut that don't end a sentence, are short or speak of scripts; documents with few sentences, braces or filler go."""
    keep = lambda x: F.rtrim(x).rlike(r"[.?!\"']$") & ~F.rtrim(x).rlike(r"\.\.\.$") & (F.size(T.words(x)) >= min_words) & ~F.lower(x).contains("javascript")
    clean = F.array_join(F.transform(F.filter(F.split("text", "\n"), keep), lambda x: F.trim(x)), "\n")
    sentences = F.regexp_count("_clean", F.lit(r"[.!?]+[\"')\]]*(\s|$)"))
    out = docs.withColumn("_clean", clean).where(sentences >= min_sentences).where(~F.lower("text").contains("lorem ipsum") & ~F.col("text").contains("{"))
    for word in blocked:
        out = out.where(~F.lower("_clean").rlike(rf"(?U)\b\Q{word}\E\b"))
    return out.withColumn("text", F.col("_clean")).drop("_clean")


def pareto(docs: DataFrame, score: Column, seed: int = 0, key: str = "source_key") -> DataFrame:
    """Documents kept with probability (2 - score)**-9, by a draw that hangs on the key alone."""
    bad = F.raise_error(F.lit("a score is finite, 0 to 1")).cast("double")
    s = F.when(score.isNull() | F.isnan(score) | (score < 0) | (score > 1), bad).otherwise(score)
    digest = F.sha2(F.concat(F.encode(F.lit(str(seed)), "UTF-8"), F.unhex(F.lit("00")), F.encode(F.col(key), "UTF-8")), 256)
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)
    return docs.where(draw < F.pow(2.0 - s, F.lit(-9.0)))
