"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Texts are cut into windows of WINDOW bytes. A forward and a backward recurrent layer read each window; their states label
every byte position, and the mean of the positions' probabilities over the whole text is the document's. Training runs
backpropagation through time on a bounded sample: LABELLED documents a language, chosen by a hash of their ids among the
labelled documents that are not held out, and SPREAD windows of each, spread evenly over the whole text. Only text and
lang of those documents are learned from; a prediction reads text alone.

Defined results: null texts and texts without a letter are 'und' with score 0; a null lang is never learned from. Without any
labelled document all others are 'und' with score 0 too. Equal probabilities: the first language in order of name. A null
doc_id counts as the empty string for the hold-out rule. Repeated rows repeat. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as wd
from millrace.llm.common import pick, prepare, table

HIDDEN, WINDOW, LABELLED, SPREAD, SHORT = 12, 64, 320, 5, (12, 24, 40)
EPOCHS, BATCH, RATE, SEED = 9, 128, 0.012, 7
f32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(x * f32(0.5))
    x *= f32(0.5)
    x += f32(0.5)
    return x


class Layer:
    """A gated recurrent layer whose input is a byte: table[byte] stands for the input weights. Order of gates: reset, update, new."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.table = rng.normal(0, 0.1, (257, 3 * hidden)).astype(f32)  # 256: past the end
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(f32)

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: steps x rows of bytes. The states of all steps, and what backward() needs."""
        n, h = self.h, np.zeros((x.shape[1], self.h), f32)
        states, saved = np.empty((*x.shape, n), f32), []
        if not keep:
            return self._states(x, states), saved
        for t in range(len(x)):
            g, hu = self.table[x[t]], h @ self.u
            rz = _sigmoid(g[:, : 2 * n] + hu[:, : 2 * n])
            new = np.tanh(g[:, 2 * n :] + rz[:, :n] * hu[:, 2 * n :])
            saved.append((h, rz, new, hu[:, 2 * n :]))
            h = new + rz[:, n:] * (h - new)
            states[t] = h
        return states, saved

    def _states(self, x: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The same without what training needs, in place. Gates are scaled by half beforehand, as sigmoid(x) = (tanh(x/2) + 1) / 2."""
        n, rows = self.h, x.shape[1]
        half = np.r_[np.full(2 * n, 0.5), np.ones(n)].astype(f32)
        table, u = self.table * half, self.u * half
        g, hu, new = np.empty((rows, 3 * n), f32), np.empty((rows, 3 * n), f32), np.empty((rows, n), f32)
        h = np.zeros((rows, n), f32)
        rz, r, z, hun = hu[:, : 2 * n], hu[:, :n], hu[:, n : 2 * n], hu[:, 2 * n :]
        for t in range(len(x)):
            np.take(table, x[t], axis=0, out=g, mode="clip")
            np.matmul(h, u, out=hu)
            rz += g[:, : 2 * n]
            np.tanh(rz, out=rz)
            rz *= f32(0.5)
            rz += f32(0.5)
            np.multiply(r, hun, out=new)
            new += g[:, 2 * n :]
            np.tanh(new, out=new)
            np.subtract(h, new, out=h)
            h *= z
            h += new
            states[t] = h
        return states

    def backward(self, x: np.ndarray, saved: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of table and u, from those of the states."""
        n, d_table, d_u = self.h, np.zeros_like(self.table), np.zeros_like(self.u)
        dh = np.zeros((x.shape[1], n), f32)
        for t in range(len(x) - 1, -1, -1):
            h, rz, new, hun = saved[t]
            r, z = rz[:, :n], rz[:, n:]
            dh = dh + grad[t]
            dn = dh * (1 - z) * (1 - new * new)
            d_rz = np.concatenate([dn * hun * r * (1 - r), dh * (h - new) * z * (1 - z)], axis=1)
            d_hu = np.concatenate([d_rz, dn * r], axis=1)
            np.add.at(d_table, x[t], np.concatenate([d_rz, dn], axis=1))
            d_u += h.T @ d_hu
            dh = dh * z + d_hu @ self.u.T
        return [d_table, d_u]


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Layer(hidden, rng), Layer(hidden, rng)
        self.w = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(f32)
        self.b = np.zeros(len(languages), f32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.u, self.back.table, self.back.u, self.w, self.b]

    def positions(self, x: np.ndarray, keep: bool = False):
        """Probabilities of the languages at every position of windows x (steps x rows)."""
        a, sa = self.ahead.forward(x, keep)
        b, sb = self.back.forward(x[::-1], keep)
        n = self.ahead.h
        score = a.reshape(-1, n) @ self.w[:n] + b[::-1].reshape(-1, n) @ self.w[n:] + self.b
        score = score.reshape(*x.shape, -1)
        both = np.concatenate([a, b[::-1]], axis=2) if keep else None
        score -= score.max(axis=2, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=2, keepdims=True)
        return score, (both, sa, sb)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over positions that hold a byte, and its gradients."""
        p, (both, sa, sb) = self.positions(x, keep=True)
        real = (x < 256)[:, :, None].astype(f32)
        total = max(1.0, float(real.sum()))
        rows = np.arange(x.shape[1])
        loss = -float((np.log(p[:, rows, label] + 1e-9) * real[:, :, 0]).sum()) / total
        d = p.copy()
        d[:, rows, label] -= 1
        d *= real / f32(total)
        d_both, n = d @ self.w.T, self.ahead.h
        g = self.ahead.backward(x, sa, d_both[:, :, :n]) + self.back.backward(x[::-1], sb, d_both[::-1, :, n:])
        return loss, [*g, np.tensordot(both, d, ([0, 1], [0, 1])), d.sum(axis=(0, 1))]

    def train(self, x: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        """Adam over shuffled rows; x: rows x steps."""
        rng, loss = np.random.default_rng(seed), 0.0
        m, v, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                part = order[lo : lo + batch]
                loss, grads = self.gradients(np.ascontiguousarray(x[part].T), label[part])
                t += 1
                step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for w, g, a, b in zip(self.weights, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= (step * a / (np.sqrt(b) + 1e-8)).astype(f32)
        return loss

    def documents(self, data: np.ndarray, off: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Mean probabilities over all bytes of each document; zeros for one without bytes."""
        sums = np.zeros((len(off) - 1, len(self.languages)))
        starts, owner = _windows(off)
        ends, steps = np.minimum(starts + WINDOW, off[owner + 1]), np.arange(WINDOW)[:, None]
        for lo in range(0, len(starts), rows):
            at = starts[None, lo : lo + rows] + steps
            inside = at < ends[lo : lo + rows]  # windows are filled up as in training, so a result hangs on the text alone
            x = np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), np.int16(256))
            p, _ = self.positions(x)
            if not inside.all():
                p *= inside[:, :, None]
            np.add.at(sums, owner[lo : lo + rows], p.sum(axis=0))
        return sums / np.maximum(1, np.diff(off))[:, None]


def _windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = -(-np.diff(off) // WINDOW)
    owner = np.repeat(np.arange(len(count)), count)
    return off[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW, owner


def samples(text: str) -> list[bytes]:
    """SPREAD windows at even distances over the whole text, fewer where it is short, and the beginnings of some, as short texts are."""
    data = text.encode()
    n = min(SPREAD, max(1, len(data) // WINDOW))
    found = [data[s : s + WINDOW] for s in (len(data) - WINDOW) * np.arange(n) // max(1, n - 1)] if len(data) > WINDOW else [data]
    return [w for w in found + [w[:k] for w, k in zip(found, SHORT, strict=False)] if w]


def fit(kept: dict[str, list[tuple[float, list[bytes]]]]) -> Network | None:
    """kept: by language, for each document a number and its windows."""
    languages = sorted(kept)
    x, label = [], []
    for k, lang in enumerate(languages):
        for _, windows in kept[lang]:
            for w in windows:
                x.append(np.r_[np.frombuffer(w, np.uint8).astype(np.int16), np.full(WINDOW - len(w), 256, np.int16)])
                label.append(k)
    if not x:
        return None
    net = Network(languages)
    net.train(np.stack(x), np.array(label))
    return net


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", labelled: int = LABELLED) -> Network | None:
    """A network from `labelled` documents a language, about, that are not held out."""
    known = pick(docs, doc_id=doc_id, text=text, lang=lang).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 1.1 * labelled / n))]) if counts else None
    if share is None:
        return None
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text", draw.alias("draw"))
    cut = chosen.mapInArrow(_cut, "lang string, draw double, windows array<binary>").collect()  # about `labelled` rows of a few windows a language
    kept: dict[str, list] = {}
    for r in cut:
        kept.setdefault(r["lang"], []).append((r["draw"], [bytes(w) for w in r["windows"]]))
    return fit({k: sorted(v)[:labelled] for k, v in kept.items()})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        windows = [samples(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(windows, pa.list_(pa.binary()))], names=["lang", "draw", "windows"])


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False)
            data, off = wd.buffers(text)
            best, score = np.zeros(len(text), int), np.zeros(len(text))
            if net:
                for lo, hi in wd.slices(off, 1 << 20):
                    p = net.documents(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    best[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            named = pa.array([net.languages[k] for k in best] if net else ["und"] * len(text), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pc.if_else(letters, named, "und"), pc.if_else(letters, pa.array(np.clip(np.round(score, 6), 0, 1)), 0.0)], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, net: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    spark = prepare(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(_predict(net), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, languages: set[str] | None = None, least: float = 0.3, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """docs whose text is, with a score of at least `least`, in one of the languages (null: in any learned one)."""
    prepare(docs.sparkSession)
    net = train(docs, text, lang, doc_id)
    run = _predict(net)

    @F.arrow_udf("boolean")
    def fits(column: pa.Array) -> pa.Array:
        n = len(column)
        out = next(run(iter([pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), column, pa.nulls(n, pa.bool_())], names=["a", "b", "c"])])))
        known = pc.and_(pc.not_equal(out.column(2), "und"), pc.greater_equal(out.column(3), least))
        return known if languages is None else pc.and_(known, pc.is_in(out.column(2), pa.array(sorted(languages))))

    return docs.where(fits(F.col(f"`{text}`")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
