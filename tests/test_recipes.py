"""Recipes on odd texts, and repetition against brute force."""

from __future__ import annotations

from collections import Counter

import pytest

from millrace.functions import recipes


def test_quality_of_texts_without_words(spark):
    rows = [(1, ""), (2, " \n "), (3, None), (4, "the cat and the dog have a house " * 10)]
    assert [r["doc_id"] for r in recipes.gopher_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [4]


def grams_worst(text: str) -> float:
    words, worst = text.split(), 0.0
    for n, limit in (recipes.TOP | recipes.REPEATED).items():
        times = Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        again = [(k, len(g)) for g, k in times.items() if k > 1]
        amount = (max(again)[0] * max(again)[1] if again else 0) if n <= 4 else sum((k - 1) * size for k, size in again)
        worst = max(worst, amount / max(len(text), 1) / limit)
    return worst


def test_repetition_counts_grams_without_a_shuffle(spark):
    texts = ["", "a", "é è é è é è é è é è é è", "x y x y z", " ".join("abcdefghijklmnopqrstuvwxyz"), "one two three four five six seven eight nine ten eleven " * 2, "ab c ab c ab c d", "c d ab c ab"]
    shares = recipes.repetition_shares(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").coalesce(1))
    assert "Exchange" not in shares._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r["worst"] for r in shares.collect()}
    assert got.pop(99) == 0
    assert got == pytest.approx({k: grams_worst(t) for k, t in enumerate(texts)})
