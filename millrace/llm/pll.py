"""Scoring by masked pseudo-likelihood: a window network predicts every word from both of its sides.

Words become tokens: the KNOWN most frequent of the whole corpus by name, all others by one of SPARE hash buckets. The
network concatenates the embeddings of SIDE words to the left and SIDE to the right (past the ends: a pad), puts them
through a hidden layer and a softmax over all tokens. A word's probability is that of its token, given its two sides, times
the word's share of the token: 1 for a known word, else its count over those of all words of its bucket, in the whole corpus.
A document's score is the sum of the log-probabilities of all of its words.

Words without a name of which there are most, about HELD at most, are counted in every task; the counts of the others, each
a vanishing part of the corpus, are joined by hash. Shares are summed in units of 1 / UNIT, so their order is no matter.

Training is spread over the corpus and takes all of it: in each of ROUNDS rounds, every task starts from the shared weights,
descends over another share of the positions of its documents, so that each position is a target once, and the weights of all tasks are averaged in a tree (of
fan-in FAN, each node of which holds one set of weights), weighted by positions. The driver holds one set of weights.

Defined results: null texts and texts without words have no tokens, pll 0 and a null mean. Ties in frequency go by word
hash. Repeated rows repeat. An empty table gives an empty result. Further columns are ignored. Averages of weights depend on
how rows are dealt to tasks, so scores of different layouts differ slightly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as wd
from millrace.llm.common import Scratch, pick, prepare, table
from millrace.llm.passages import document_words

KNOWN, SPARE, SIDE, EMBED, HIDDEN = 320, 64, 3, 8, 16
ROUNDS, BATCH, RATE, FAN, SEED = 2, 256, 0.1, 64, 11
HELD, UNIT = 1 << 16, 1 << 24
#: Outputs within -SAFE to SAFE have exponentials, sums of them and reciprocals well within 32 bits.
SAFE = 60
SIZE = KNOWN + SPARE
PAD = SIZE
f32 = np.float32
SHAPES = [(SIZE + 1, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, SIZE), (SIZE,)]


def first_weights(seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.normal(0, 0.3 if len(s) > 1 else 0, s) / (1 if s[0] > SIZE else math.sqrt(s[0]) * 0.3)).reshape(-1) for s in SHAPES]).astype(f32)


def split(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in SHAPES:
        out.append(flat[at : at + math.prod(s)].reshape(s))
        at += math.prod(s)
    return out


def tokens(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Token of each word hash; vocabulary: sorted hashes of the known words."""
    if not len(vocabulary):
        return KNOWN + (h % np.uint64(SPARE)).astype(np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, KNOWN + (h % np.uint64(SPARE)).astype(np.int64))


def contexts(t: np.ndarray, at: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """The 2 * SIDE tokens about each position, or each of the named ones; documents are t[at[d]:at[d + 1]]."""
    first, end = np.repeat(at[:-1], np.diff(at)), np.repeat(at[1:], np.diff(at))
    if place is None:
        place = np.arange(len(t))
    else:
        first, end = first[place], end[place]
    out = np.full((len(place), 2 * SIDE), PAD, np.int64)
    for c, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        there = place + step
        ok = (there >= first) & (there < end)
        out[ok, c] = t[there[ok]]
    return out


_ONES, _EMBED = np.ones(SIZE, f32), np.arange(EMBED)


def _forward(weights: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden layer with a last column of ones, and outputs.

    As the hidden layer lies within -1 to 1, weights bound the outputs; where they could overflow an exponential, outputs are
    taken less their greatest.
    """
    e, w, b, u, c = split(weights)
    x = e[context].reshape(len(context), -1)
    h = np.ones((len(context), HIDDEN + 1), f32)
    h[:, :-1] = np.tanh(x @ w + b)
    p = h @ weights[-(HIDDEN + 1) * SIZE :].reshape(HIDDEN + 1, SIZE)  # u and below it c
    if not np.abs(u).sum(axis=0).max() + np.abs(c).max() < SAFE:
        p -= p.max(axis=1, keepdims=True)
    return x, h, p


def log_probabilities(weights: np.ndarray, context: np.ndarray, target: np.ndarray, rows: int = 512) -> np.ndarray:
    out = np.empty(len(target), f32)
    for lo in range(0, len(target), rows):
        y = target[lo : lo + rows]
        *_, p = _forward(weights, context[lo : lo + rows])
        own = p[np.arange(len(y)), y]
        np.exp(p, out=p)
        out[lo : lo + rows] = own - np.log(p @ _ONES)
    return out


def gradients(weights: np.ndarray, context: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-probability and its gradient."""
    e, w, _, u, _ = split(weights)
    x, h, p = _forward(weights, context)
    n, rows = f32(len(target)), np.arange(len(target))
    own = p[rows, target]
    np.exp(p, out=p)
    total = p @ _ONES
    loss = float((np.log(total) - own).mean())
    p[rows, target] -= total  # what scales rows is left to the narrow factors
    scale = (1 / (total * n))[:, None]
    dz = (p @ u.T) * (scale * (1 - h[:, :-1] * h[:, :-1]))
    at = (context.reshape(-1, 1) * EMBED + _EMBED).reshape(-1)
    de = np.bincount(at, (dz @ w.T).reshape(-1), e.size).astype(f32)
    return loss, np.concatenate([g.reshape(-1) for g in (de, x.T @ dz, dz.sum(axis=0), (h * scale).T @ p)])


class Descent:
    """Adagrad from shared weights."""

    def __init__(self, weights: np.ndarray, rate: float = RATE):
        self.weights, self.rate, self.squares = weights.astype(f32).copy(), rate, np.full(len(weights), 1e-4, f32)

    def step(self, context: np.ndarray, target: np.ndarray) -> float:
        loss, g = gradients(self.weights, context, target)
        self.squares += g * g
        self.weights -= f32(self.rate) * g / np.sqrt(self.squares)
        return loss


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a task, sent on whenever a million words wait."""
    waiting: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(waiting), return_counts=True)
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    for b in batches:
        for _, h, *_ in document_words(b.column(1)):
            if len(h):
                waiting.append(h)
            if sum(map(len, waiting)) > 1_000_000:
                yield out()
    if waiting:
        yield out()


def _tokenized(vocabulary, held, held_n, totals):
    """Per document: its tokens, a number of its own, the sum of log shares as far as held counts tell, and the words not held."""
    ln, ln_totals = np.log(held_n.astype(np.float64)), np.log(np.maximum(totals, 1).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for first, h, at, *_ in document_words(b.column(1)):
                t = tokens(h, vocabulary)
                unnamed = np.flatnonzero(t >= KNOWN)
                w, share = h[unnamed], -ln_totals[t[unnamed] - KNOWN]
                there = np.zeros(len(w), bool)
                if len(held):
                    place = np.minimum(np.searchsorted(held, w), len(held) - 1)
                    there = held[place] == w
                    share[there] += ln[place[there]]
                sums = np.r_[0, np.cumsum(np.round(share * UNIT).astype(np.int64))][np.searchsorted(unnamed, at)]
                ends = np.searchsorted(unnamed[~there], at).astype(np.int32)
                n = len(at) - 1
                t = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(t.astype(np.int16)))
                rest = pa.ListArray.from_arrays(pa.array(ends), pa.array(w[~there].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), t, pa.array(np.arange(row, row + n)), pa.array(np.diff(sums)), rest], names=["doc_id", "tokens", "row", "share", "rest"])
                row += n

    return run


def _slices(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, tokens and offsets of slices of a batch of (doc_id, tokens)."""
    column = b.column(1)
    off = column.offsets.to_numpy().astype(np.int64)
    t = column.values.to_numpy()
    for lo, hi in wd.slices(off, 1 << 15):
        yield lo, t[off[lo] : off[hi]].astype(np.int64), off[lo : hi + 1] - off[lo]


def _descended(weights, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, left = Descent(weights), 0, None
        for b in batches:
            for _, t, at in _slices(b):
                chosen = np.arange(turn, len(t), ROUNDS)
                x, y = contexts(t, at, chosen), t[chosen]
                if left is not None:
                    x, y = np.concatenate([left[0], x]), np.concatenate([left[1], y])
                order = np.argsort(wd.mix(np.arange(len(y), dtype=np.uint64)))
                whole = len(y) // BATCH * BATCH
                for lo in range(0, whole, BATCH):
                    model.step(x[order[lo : lo + BATCH]], y[order[lo : lo + BATCH]])
                left = (x[order[whole:]], y[order[whole:]])
                seen += whole
        if left is not None and len(left[1]):
            model.step(*left)
            seen += len(left[1])
        if seen:
            yield _weights_row(model.weights * f32(1), seen)

    return run


_WEIGHTS = "weights array<float>, n long"


def _weights_row(weights: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([weights.astype(f32)], pa.list_(pa.float32())), pa.array([n], pa.int64())], names=["weights", "n"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(sum(math.prod(s) for s in SHAPES)), 0
    for b in batches:
        for w, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            total += w.values.to_numpy() * float(k)
            n += k
    if n:
        yield _weights_row(total / n, n)


def tokenize(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The tokens of rows (doc_id, text) with what is known of their words' shares, and (word, n) of the words not held."""
    counts = scratch.keep(rows.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    vocabulary = np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))
    # A few hundred classes of frequency: from the top, as many are held as have HELD words together.
    often = F.floor(F.log2("n") * 8).cast("int")
    totals, sizes = np.zeros(SPARE, np.int64), {}
    for r in counts.groupBy(often.alias("often"), F.pmod("word", F.lit(SPARE)).cast("int").alias("spare")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        totals[r["spare"]] += r["n"]  # SPARE divides 2 ** 64, so signed hashes fall into the same buckets
        sizes[r["often"]] = sizes.get(r["often"], 0) + r["words"]
    for r in top:
        totals[r["word"] % SPARE] -= r["n"]
    least, room = 1 << 30, HELD + KNOWN
    for k in sorted(sizes, reverse=True):
        if (room := room - sizes[k]) < 0:
            break
        least = k
    frequent = counts.where(often >= least).toArrow()
    held, held_n = frequent.column("word").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    order = np.argsort(held)
    run = _tokenized(vocabulary, held[order], held_n[order], totals)
    known = scratch.keep(rows.mapInArrow(run, "doc_id long, tokens array<short>, row long, share long, rest array<long>"), "tokens")
    return known, counts.where((often < least) & (F.col("n") > 1))  # of single words the logarithm is 0


def train(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """The tokens of rows (doc_id, text), and weights."""
    known, _ = tokenize(rows, scratch)
    return known, descend(known, scratch)


def descend(known: DataFrame, scratch: Scratch) -> np.ndarray:
    known = known.select("doc_id", "tokens")
    weights, tasks = first_weights(), known.rdd.getNumPartitions()
    for turn in range(ROUNDS):
        each = scratch.keep(known.mapInArrow(_descended(weights, turn), _WEIGHTS), f"round{turn}")
        n = tasks
        while True:
            n = -(-n // FAN)
            each = each.repartition(n).mapInArrow(_averaged, _WEIGHTS)
            if n == 1:
                break
        if got := each.first():
            weights = np.array(got["weights"], f32)
    return weights


def _scored(weights, more: tuple[str, ...] = ()):
    """Scores of the tokens alone; the columns named in more follow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, t, at in _slices(b):
                p = np.r_[0.0, np.cumsum(log_probabilities(weights, contexts(t, at), t), dtype=np.float64)]
                n, total = np.diff(at), np.round(p[at[1:]] - p[at[:-1]], 4)
                mean = pa.array(np.round(total / np.maximum(n, 1), 6), mask=n == 0)
                also = [b.column(name).slice(first, len(n)) for name in more]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(n), pa.array(total), mean, *also], names=["doc_id", "n_tokens", "pll", "mean_pll", *more])

    return run


def pseudo_likelihood(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, pll, mean_pll for every row of docs, by a network trained on them."""
    spark = prepare(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    scratch = Scratch(spark, "pll")
    known, counts = tokenize(rows, scratch)
    weights = descend(known, scratch)
    scored = known.drop("rest").mapInArrow(_scored(weights, ("row", "share")), "doc_id long, n_tokens long, pll double, mean_pll double, row long, share long")
    rest = known.select("row", F.explode("rest").alias("word")).join(counts.hint("merge"), "word")
    rest = rest.groupBy("row").agg(F.sum(F.round(F.log("n") * UNIT).cast("long")).alias("rest"))
    pll = F.round(F.col("pll") + (F.col("share") + F.coalesce("rest", F.lit(0))) / UNIT, 4)
    n = F.col("n_tokens")
    return scored.join(rest.hint("merge"), "row", "left").select("doc_id", "n_tokens", pll.alias("pll"), F.when(n > 0, F.round(pll / n, 6)).alias("mean_pll"))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
