import zlib

import numpy as np

from millrace.llm import langid

from .conftest import EDGES, documents


def test_gradients_equal_differences():
    net = langid.Network(["a", "b", "c"], hidden=3)
    for w in net.weights:
        w *= 3
    rng = np.random.default_rng(0)
    x = rng.integers(0, 257, (7, 5)).astype(np.int16)
    x[0] = 65
    label = np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(x, label)
    for w, g in zip(net.weights, grads, strict=True):
        for at in [np.unravel_index(k, w.shape) for k in np.argsort(-np.abs(g).reshape(-1))[:5]]:
            old, step = w[at], np.float32(1e-2)
            w[at] = old + step
            up, _ = net.gradients(x, label)
            w[at] = old - step
            down, _ = net.gradients(x, label)
            w[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * max(0.05, abs(g[at]))


def test_prediction_path_equals_training_path():
    net = langid.Network(["a", "b"])
    x = np.random.default_rng(1).integers(0, 257, (20, 9)).astype(np.int16)
    assert np.allclose(net.positions(x)[0], net.positions(x, keep=True)[0], atol=1e-5)
    data = np.frombuffer("some bytes of a text that is longer than one window of the network, surely it is.".encode(), np.uint8)
    p = net.documents(data, np.array([0, 0, len(data)]))
    filled = np.r_[data.astype(np.int16), np.full(2 * langid.WINDOW - len(data), 256, np.int16)].reshape(2, -1).T
    parts = net.positions(filled)[0].transpose(1, 0, 2).reshape(2 * langid.WINDOW, -1)[: len(data)]
    assert (p[0] == 0).all() and np.allclose(p[1], parts.mean(axis=0), atol=1e-5)


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lang = dict(docs.select("doc_id", "lang").collect())
    rows = langid.op7_language_id(spark, small).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    tested = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in tested]) >= 0.95


def test_edges(spark, edges, nothing):
    net = langid.train(edges)
    rows = {r["doc_id"]: r for r in langid.predict(edges, net).collect()}
    assert len(langid.predict(edges, net).collect()) == len(EDGES)
    for doc in (3, 4, 5, 10):
        assert (rows[doc]["lang_pred"], rows[doc]["score"]) == ("und", 0.0)
    assert set(r["lang_pred"] for r in rows.values()) <= {"en", "de", "fr", "es", "und"}
    assert langid.train(nothing) is None and langid.predict(nothing, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edges, None).collect()} == {"und"}
    kept = langid.keep_languages(edges)
    assert kept.columns == edges.columns and {3, 4, 5, 10}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert langid.keep_languages(nothing).count() == 0


def test_only_what_is_not_held_out_is_learned(spark):
    rows = [(k, "aaaa bbbb " * 5, "en" if zlib.crc32(str(k).encode()) % 4 != 2 else "xx", "s") for k in range(60)]
    assert langid.train(documents(spark, rows)).languages == ["en"]
