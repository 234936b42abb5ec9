import numpy as np
import pytest

from millrace.llm import pll

from .conftest import EDGES


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    weights = pll.first_weights() + rng.normal(0, 0.1, len(pll.first_weights())).astype(np.float32)
    context, target = rng.integers(0, pll.SIZE + 1, (30, 2 * pll.SIDE)), rng.integers(0, pll.SIZE, 30)
    loss, g = pll.gradients(weights, context, target)
    assert loss == pytest.approx(-pll.log_probabilities(weights, context, target).mean(), abs=1e-4)
    for k in np.argsort(-np.abs(g))[:20]:
        up, down = weights.copy(), weights.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert (pll.gradients(up, context, target)[0] - pll.gradients(down, context, target)[0]) / 2e-2 == pytest.approx(g[k], rel=0.05, abs=1e-3)


@pytest.mark.parametrize("scale", [1, 20, 400])
def test_gradients_of_large_weights(scale):
    """Held against a softmax in 64 bits, below and beyond what exponentials of plain outputs allow."""
    rng = np.random.default_rng(1)
    weights = pll.first_weights()
    weights[-(pll.HIDDEN + 1) * pll.SIZE :] *= scale
    context, target = rng.integers(0, pll.SIZE + 1, (40, 2 * pll.SIDE)), rng.integers(0, pll.SIZE, 40)
    e, w, b, u, c = (x.astype(np.float64) for x in pll.split(weights))
    h = np.tanh(e[context].reshape(40, -1) @ w + b)
    out = h @ u + c
    out -= out.max(axis=1, keepdims=True)
    p = out - np.log(np.exp(out).sum(axis=1, keepdims=True))
    want = p[np.arange(40), target]
    loss, g = pll.gradients(weights, context, target)
    error = np.exp(p)
    error[np.arange(40), target] -= 1
    assert loss == pytest.approx(-want.mean(), rel=1e-4, abs=1e-4)
    assert pll.log_probabilities(weights, context, target) == pytest.approx(want, rel=1e-3, abs=1e-3)
    assert g[-(pll.HIDDEN + 1) * pll.SIZE :] == pytest.approx(np.r_[h.T @ error, [error.sum(axis=0)]].reshape(-1) / 40, rel=1e-2, abs=1e-4)


def test_contexts_stay_in_their_document():
    t, at = np.arange(9), np.array([0, 4, 4, 9])
    for p, row in enumerate(pll.contexts(t, at)):
        lo, hi = (0, 4) if p < 4 else (4, 9)
        want = [q if lo <= q < hi else pll.PAD for q in (p - 3, p - 2, p - 1, p + 1, p + 2, p + 3)]
        assert row.tolist() == want


def test_training_beats_frequencies_and_scores_add_up(spark, small):
    from millrace.llm.common import Scratch, pick, table

    rows = pick(table(spark, small, "documents"), doc_id="doc_id", text="text")
    known, weights = pll.train(rows, Scratch(spark, "test"))
    docs = {r["doc_id"]: np.array(r["tokens"], np.int64) for r in known.collect()}
    every = np.concatenate(list(docs.values()))
    p = np.bincount(every, minlength=pll.SIZE) / len(every)
    by_frequency = (p[p > 0] * np.log(p[p > 0])).sum()
    total = 0.0
    for r in known.mapInArrow(pll._scored(weights), "doc_id long, n_tokens long, pll double, mean_pll double").collect():
        t = docs[r["doc_id"]]
        want = pll.log_probabilities(weights, pll.contexts(t, np.array([0, len(t)])), t).astype(np.float64).sum()
        assert r["n_tokens"] == len(t) and r["pll"] == pytest.approx(want, abs=1e-2, rel=1e-4)
        total += r["pll"]
    assert total / len(every) > by_frequency + 0.1
    rng = np.random.default_rng(1)
    shuffled = rng.permutation(every)
    assert total / len(every) > pll.log_probabilities(weights, pll.contexts(shuffled, np.array([0, len(shuffled)])), shuffled).mean() + 0.1


def test_edges(spark, edges, nothing):
    rows = pll.pseudo_likelihood(edges).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: r for r in rows}
    for doc in (3, 4, 5):
        assert (by[doc]["n_tokens"], by[doc]["pll"], by[doc]["mean_pll"]) == (0, 0.0, None)
    assert by[1]["pll"] == by[2]["pll"] < 0 and by[8]["n_tokens"] == 180_000
    assert pll.pseudo_likelihood(nothing).count() == 0


@pytest.mark.parametrize("held", [0, 40, 1 << 16])
def test_words_of_a_bucket_have_their_own_probabilities(spark, monkeypatch, held):
    import math
    from collections import Counter

    from millrace.llm.common import Scratch, pick
    from millrace.llm.passages import text_hashes

    from .conftest import documents

    monkeypatch.setattr(pll, "HELD", held)
    bucket = lambda w: int(text_hashes([w])[0][0] % np.uint64(pll.SPARE))
    real, gibberish = "quay", next(w for k in range(10_000) if bucket(w := f"zq{k}x") == bucket("quay"))
    texts = [" ".join(f"w{k}" for k in range(400))] * 5 + [f"w1 w2 {x} w3 w4" for x in (real, real, real, gibberish)] + [" ".join(f"r{k}" for k in range(300)), None]
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in pll.pseudo_likelihood(docs).collect()}
    assert got[5]["pll"] == got[6]["pll"] and got[5]["pll"] - got[8]["pll"] == pytest.approx(math.log(3), abs=5e-4)

    known, weights = pll.train(pick(docs, doc_id="doc_id", text="text"), Scratch(spark, "test"))
    by_token = {r["doc_id"]: r["pll"] for r in known.mapInArrow(pll._scored(weights), "doc_id long, n_tokens long, pll double, mean_pll double").collect()}
    count = Counter(w for t in texts for w in (t or "").split())
    named = {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], int(text_hashes([x[0]])[0].view(np.int64)[0])))[: pll.KNOWN]}
    total = Counter()
    for w, n in count.items():
        if w not in named:
            total[bucket(w)] += n
    for k, t in enumerate(texts):
        want = by_token[k] + sum(math.log(count[w] / total[bucket(w)]) for w in (t or "").split() if w not in named)
        assert got[k]["pll"] == pytest.approx(want, abs=1e-3)
        assert got[k]["mean_pll"] == (pytest.approx(got[k]["pll"] / len(t.split()), abs=1e-5) if t else None)


def test_every_position_is_a_target_once(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    found = Counter()

    class Noted(pll.Descent):
        def step(self, context, target):
            found.update((*x, y) for x, y in zip(context.tolist(), target.tolist(), strict=True))
            return super().step(context, target)

    monkeypatch.setattr(pll, "Descent", Noted)
    docs = [np.random.default_rng(k).integers(0, pll.SIZE, n).astype(np.int16) for k, n in enumerate((700, 0, 1, 3000, 41))]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs, pa.list_(pa.int16()))], names=["doc_id", "tokens"])
    seen = sum(out.column(1)[0].as_py() for turn in range(pll.ROUNDS) for out in pll._descended(pll.first_weights(), turn)(iter([rows, rows])))
    t, at = np.concatenate(docs).astype(np.int64), np.r_[0, np.cumsum([len(d) for d in docs])]
    once = Counter((*x, y) for x, y in zip(pll.contexts(t, at).tolist(), t.tolist(), strict=True))
    assert seen == 2 * len(t) and found == once + once
