"""Text, vector and key functions as columns. Offsets are in UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of what Python's re takes for no white space (Java's Unicode class lacks U+001C to U+001F).
WORD = r"(?U)[^\s\x{1c}-\x{1f}]+"


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def n_chars(text: Column) -> Column:
    return F.length(text).cast("long")


def newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, then) -> Column:
    """then(value) with the value computed once: a lambda body is computed for each element, with all that stands in it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def word_grams(text: Column, n: int, make, hashed: bool = True) -> Column:
    """make(array of n words, or of their 64-bit hashes) for each place; no elements where there are fewer words.

    Words are hashed once, so that an n-gram costs n longs and not n strings.
    """
    places = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: make(F.slice(w, i, n)))
    cut = F.transform(words(text), lambda w: F.xxhash64(w)) if hashed else words(text)
    one = make(F.array(F.lit(0).cast("long") if hashed else F.lit("")))
    return F.coalesce(let(cut, lambda w: F.when(F.size(w) >= n, places(w))), F.array_remove(F.array(one), one))


def gram_hash(gram: Column) -> Column:
    return F.xxhash64(gram)


def gram_set(text: Column, n: int) -> Column:
    """Distinct word n-grams as 64-bit hashes."""
    return F.array_distinct(word_grams(text, n, gram_hash))


def content(text: Column) -> Column:
    return F.sha2(text, 256)


def lines(text: Column) -> Column:
    """Non-empty pieces between line feeds; a carriage return is content."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def group_prefix(key: Column, separator: str) -> Column:
    """What comes before the separator, the whole key where there is none."""
    if len(separator) != 1 or separator == "\0" or "\ud800" <= separator <= "\udfff":
        raise ValueError("a separator is one code point other than NUL and surrogates")
    return F.substring_index(key, separator, 1)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    e = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp((x - top) / temperature)))
    return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(v, lambda x: x / total)))


def sigmoid(logits: Column, temperature: float = 1.0) -> Column:
    return F.transform(logits, lambda x: F.when(x >= 0, 1 / (1 + F.exp(-x / temperature))).otherwise(F.exp(x / temperature) / (1 + F.exp(x / temperature))))


def top_class(logits: Column, classes: Sequence[str]) -> Column:
    """The first of the greatest."""
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(logits, F.array_max(logits)).cast("int"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def stratum(labels: Sequence[tuple[Column, bool]]) -> Column:
    """One string label is the key itself; else a compact JSON array. labels: column, whether it is a string."""
    if len(labels) == 1 and labels[0][1]:
        return F.coalesce(labels[0][0].cast("string"), F.lit("[null]"))
    cell = lambda c, text: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":(.*)\}$", 1) if text else c.cast("string")
    parts = [F.when(c.isNull(), "null").otherwise(cell(c, text)) for c, text in labels]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")) if parts else F.lit("[]")


def seeded(kind: str, seed: int, *columns: Column) -> Column:
    """A key for a seeded order that any engine with SHA-256 can compute."""
    return F.sha2(F.concat_ws("/", F.lit(kind), F.lit(str(seed)), *[c.cast("string") for c in columns]), 256)


def seeded_fraction(kind: str, seed: int, *columns: Column) -> Column:
    """The first 60 bits of that key, as a long below 2**60."""
    return F.conv(F.substring(seeded(kind, seed, *columns), 1, 15), 16, 10).cast("long")
