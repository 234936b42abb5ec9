import hashlib

import corpus_pipeline
from millrace.llm import common, langid, leaks, pieces
from millrace.llm.passages import MATCH, align, text_hashes

from .test_exact import STRIP
from .test_near import brute as near_brute


def test_run_equals_the_stages_by_brute_force(spark, tiny):
    docs = common.table(spark, tiny, "documents")
    predicted = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if predicted[r["doc_id"]]["lang_pred"] in corpus_pipeline.LANGUAGES and predicted[r["doc_id"]]["score"] >= corpus_pipeline.LEAST_SCORE)
    first = {}
    for doc, text in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
        first.setdefault(hashlib.sha256(text.translate(STRIP).encode()).digest(), doc)
    rows = [r for r in rows if r[0] in set(first.values())]
    kept = {d for d, _, _, kept in near_brute(rows, 5, 80) if kept}
    rows = [r for r in rows if r[0] in kept]
    items = text_hashes([r["text"] for r in common.table(spark, tiny, "benchmark").collect()])
    clean = [r for r, h in zip(rows, text_hashes([t for _, t in rows]), strict=True) if not any(len(h) and align(g, h)[0] / (MATCH * len(g)) >= leaks.MIN_SCORE for g in items)]
    codec = pieces.Pieces(pieces.load_pieces(open(pieces.MODEL, "rb").read()))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, tiny).collect()}
    assert set(got) == {d for d, _ in clean} and 100 < len(got) < 200
    for doc, text in clean:
        assert got[doc]["tokens"] == codec.encode(text) and got[doc]["round_trip"]


def test_stages_keep_columns_and_stand_edges(spark, edges, nothing, tiny):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for start in (edges, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, tiny)
            if name != "sentencepiece":
                assert docs.columns == start.columns
                docs = common.Scratch(spark, "test").keep(docs, name)
                assert docs.count() <= before.count()
        assert docs.columns == ["doc_id", "n_tokens", "tokens", "round_trip"] and (docs.count() > 0) == (start is edges)
