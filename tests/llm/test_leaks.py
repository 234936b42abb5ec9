import random
import re

import numpy as np

from millrace.llm import leaks
from millrace.llm.passages import MATCH, align, text_hashes

from .conftest import documents, same

SENTENCE = "describe how the ancient harbour walls were rebuilt after the great storm and who paid the masons for their work during that long winter"


def brute_align(a, b):
    """Smith-Waterman by its definition."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        score, equal, i, ii, j, jj = align(np.array(a), np.array(b))
        assert score == brute_align(a, b)
        assert brute_align(a[i:ii], b[j:jj]) == score and equal <= min(ii - i, jj - j)
    assert align(np.array([1, 2, 3]), np.array([9, 9]))[0] == 0


def paraphrase(rng, text, share):
    return " ".join(rng.choice(["quite", "really", "", "perhaps so"]) if rng.random() < share else w for w in text.split())


def test_query_finds_what_full_alignment_finds(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{tiny}/benchmark.parquet").collect()
    want = set()
    for (doc, _), h in zip(docs, text_hashes([d["text"] for d in docs]), strict=True):
        for item, g in zip(items, text_hashes([i["text"] for i in items]), strict=True):
            if len(h) and len(g) and align(g, h)[0] / (MATCH * len(g)) >= leaks.MIN_SCORE:
                want.add((doc, item["item_id"]))
    assert want
    got = leaks.op1_decontaminate(spark, tiny).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_edges_edits_and_spans(spark, edges, nothing):
    rng = random.Random(2)
    filler = " ".join(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], f"fill{k}") for k in range(300))
    rows = [
        (1, f"{filler} {SENTENCE.upper()} {filler}", "en", "s"),
        (2, f"{filler} {paraphrase(rng, SENTENCE, 0.2)} {filler}", "en", "s"),
        (3, filler, "en", "s"),
        (4, None, "en", "s"),
        (None, f"é {SENTENCE}", "en", "s"),
        (5, "what is it", "en", "s"),
        (5, "what is it", "en", "s"),
    ]
    items = spark.createDataFrame([(1, SENTENCE, 0), (2, None, 0), (3, "", 0), (4, "What is it?", 0), (4, "What is it?", 0)], "item_id long, text string, doc_id long")
    docs = documents(spark, rows)
    found = leaks.leaks(docs, items)
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in found.collect())
    assert got[:4] == [(0, 1), (1, 1), (2, 1), (5, 4)] and set(got) == set(got[:4])
    span = found.where("doc_id = 1").first()
    assert rows[0][1][span["char_start"] : span["char_end"]] == SENTENCE.upper() and span["score"] == 1.0
    span = found.where("doc_id is null").first()
    assert (span["char_start"], span["char_end"]) == (2, 2 + len(SENTENCE))
    kept = leaks.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    same(kept, [(3,), (4,)], ["doc_id"])
    assert leaks.leaks(nothing, items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0
    assert leaks.drop_leaks(docs, items.limit(0)).count() == len(rows)
    assert leaks.leaks(edges, items).where("item_id = 1").count() == 0


def test_blocks_of_items_change_nothing(spark, tiny, monkeypatch):
    want = leaks.op1_decontaminate(spark, tiny).select("doc_id", "item_id").collect()
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 2000)
    got = leaks.op1_decontaminate(spark, tiny).select("doc_id", "item_id").collect()
    assert sorted(want) == sorted(got)
