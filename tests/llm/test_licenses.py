import random

import numpy as np

from millrace.llm import licenses as lc
from millrace.llm import words as wd
from millrace.llm.passages import align, text_hashes

from .conftest import documents


def test_winnowing_keeps_one_in_every_window():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 50, 300).astype(np.uint64)
    places = lc.winnow(grams)
    for lo in range(len(grams) - lc.WINDOW + 1):
        part = grams[lo : lo + lc.WINDOW]
        rightmost = lo + lc.WINDOW - 1 - int(np.argmin(part[::-1]))
        assert rightmost in places
    assert lc.winnow(grams[:0]) == [] and len(lc.winnow(grams[:2])) == 1


def test_wide_band_equals_no_band():
    rng = random.Random(4)
    for _ in range(100):
        a, b = (np.array([rng.randrange(5) for _ in range(rng.randrange(1, 20))]) for _ in range(2))
        assert align(a, b, 0, 40)[0] == align(a, b)[0]


def test_spans_edits_and_edges(spark, edges, nothing):
    rng = random.Random(7)
    filler = " ".join(f"filler{chr(97 + k % 26)}{k}" for k in range(200))
    mit, gpl = lc.TEMPLATES["MIT/text"], lc.TEMPLATES["GPL-3.0/header"]
    edited = " ".join(w for w in gpl.split() if rng.random() > 0.08)
    rows = [
        (1, f"{filler} {mit} {filler}", "en", "s"),
        (2, f"é {edited} {filler} {lc.TEMPLATES['CC-BY-4.0/line']}", "en", "s"),
        (3, filler, "en", "s"),
        (4, None, "en", "s"),
        (5, " ".join(mit.split()[: len(mit.split()) // 2]), "en", "s"),
        (6, f"{mit}\n\n{mit}", "en", "s"),
    ]
    got = lc.license_scan(documents(spark, rows)).collect()
    found = sorted((r["doc_id"], r["template"]) for r in got)
    assert found == [(1, "MIT/text"), (2, "CC-BY-4.0/line"), (2, "GPL-3.0/header"), (6, "MIT/text"), (6, "MIT/text")]
    whole = next(r for r in got if r["doc_id"] == 1)
    assert rows[0][1][whole["char_start"] : whole["char_end"]] + "." == mit and whole["coverage"] == 1.0
    part = next(r for r in got if r["template"] == "GPL-3.0/header")
    assert 0.85 < part["coverage"] < 1 and rows[1][1][part["char_start"] :].startswith(edited[:20])
    assert lc.license_scan(nothing).count() == 0 and lc.license_scan(edges).count() == 0


def test_query_equals_full_alignment(spark, tiny):
    """Without index or band: every template against every document, best match only."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    names = sorted(lc.TEMPLATES)
    templates = text_hashes([lc.TEMPLATES[n] for n in names])
    want = set()
    for d, h in zip(docs, text_hashes([d["text"] for d in docs]), strict=True):
        for name, t in zip(names, templates, strict=True):
            if len(h) and align(t, h)[1] >= lc.LEAST * len(t):
                want.add((d["doc_id"], name))
    got = {(r["doc_id"], r["template"]) for r in lc.op6_license_scan(spark, tiny).collect()}
    assert got <= want and {d for d, _ in got} == {d for d, _ in want} and got
    assert wd.GOLD


def test_short_notices_back_to_back_and_edited(spark):
    templates = {"MIT/line": "Released under the MIT License", "Other/line": "a notice of quite other words altogether"}
    words = templates["MIT/line"].split()
    rows = [(k, " ".join([*words[:k], "edited", *words[k + 1 :]]), "en", "s") for k in range(5)]
    rows += [(5, "Released under the MIT License. " * 4, "en", "s"), (6, "Released under the MIT License. " * 300, "en", "s"), (7, "under the tree", "en", "s")]
    got = [r["doc_id"] for r in lc.license_scan(documents(spark, rows), templates).collect()]
    assert [got.count(k) for k in range(8)] == [1, 1, 1, 1, 1, 4, 300, 0]
