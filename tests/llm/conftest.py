"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

CLASHING = "digest comp rep band size rank ident words rows kept hub_rep els node _out shared first bucket part".split()
LONG = " ".join(f"word{k % 977} and{k % 31} so{k % 7}" for k in range(60_000))
EDGES = [
    (1, "the quick brown fox jumps over the lazy dog and then runs far away from all of them", "en", "s1"),
    (2, "the quick brown fox jumps over the lazy dog and then runs far away from all of them", "en", "s1"),
    (2, "the quick brown fox jumps over the lazy dog and then runs far away from all of them", "en", "s1"),
    (3, None, "en", "s1"),
    (4, "", None, "s2"),
    (5, " \t\n ", "de", None),
    (6, "one", "de", "s2"),
    (7, "one", None, "s2"),
    (8, LONG, "fr", "s2"),
    (9, LONG + " end", "fr", "s2"),
    (10, "12345 67 !!", "es", "s2"),
    (11, "Größe señor ça 漢字 🌍 ▁ mark", "es", "s2"),
    (None, "a row without an id", "en", "s3"),
    (None, None, None, None),
]


def documents(spark, rows):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"cast({k} as string) as `{c}`" for k, c in enumerate(CLASHING)]).repartition(3)


@pytest.fixture(scope="session")
def edges(spark):
    return documents(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, EDGES).where("doc_id = -1")


def same(df, rows, columns):
    """The rows of df as a sorted list of the columns equal the expected ones."""
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted((tuple(r) for r in rows), key=key)
