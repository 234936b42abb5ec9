"""Similarity edges (word n-gram Jaccard, cosine, character MinHash candidates) and greedy selection.

Documents of equal sets or vectors are one class, and edges join class representatives; membership gives the rest. Jaccard
edges use the prefix filter: with a set's grams in order of rarity, two sets of similarity t share one of the first
n - ceil(t n) + 1, so no edge is lost and frequent grams are hardly ever joined on. Cosine edges partition vectors about
pivots and compare only blocks that the triangle inequality leaves. Greedy selection is the sequential rule (drop what has
a better kept neighbour), in rounds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.functions import text as T
from millrace.functions.fields import Ordering
from millrace.operators.order import with_order
from millrace.scratch import Scratch

#: Up to so many edges one task finishes alone; a bound on its memory, not on the edges.
ALONE = 1 << 20
#: Cosine products held at once, and edges sent on at once.
TILE, EDGES = 1 << 22, 1 << 17
PLACES, BANDS, CHARACTERS, SEED = 128, 16, 5, 42


def check_threshold(threshold: float, n: int = 1) -> None:
    if not 0 <= threshold <= 1 or not 1 <= n <= 1024:
        raise ValueError("a threshold is 0 to 1 and n is 1 to 1024")


def jaccard_classes(docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """doc_id, rep, size, grams: classes of equal gram sets; texts of fewer than n words are equal by text."""
    kind, rank = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = hashing.gram_sets(b.column(2), n)
            keys = [blake2b(h[lo:hi].tobytes(), digest_size=16).hexdigest() if hi > lo else text for lo, hi, text in zip(at[:-1], at[1:], b.column(3).to_pylist(), strict=True)]
            sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.string()), pa.array(np.diff(at).astype(np.int32)), sets], names=["doc_id", "_rank", "key", "n_grams", "grams"])

    keyed = scratch.keep(docs.select("doc_id", "_rank", "text", "content").mapInArrow(run, f"doc_id {kind}, _rank {rank}, key string, n_grams int, grams array<bigint>"), "grams")
    first = keyed.groupBy("key").agg(F.min_by("doc_id", "_rank").alias("rep"), F.min("_rank").alias("rep_rank"), F.count("*").alias("size"))
    return scratch.keep(keyed.join(first, "key").select("doc_id", "rep", "rep_rank", "size", "n_grams", "grams"), "classes")


def _pairs(classes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Candidate pairs of representatives by the prefix filter."""
    reps = classes.where("doc_id = rep and n_grams > 0")
    posted = reps.select("rep", "n_grams", F.explode("grams").alias("gram"))
    shared = scratch.keep(posted.groupBy("gram").count().where("count > 1"), "shared")
    # Grams of one document come first in order of rarity; they take prefix places but can't be joined on.
    known = posted.join(shared, "gram").groupBy("rep", "n_grams").agg(F.array_sort(F.collect_list(F.struct("count", "gram"))).alias("s"))
    length = (F.col("n_grams") - F.ceil(F.col("n_grams") * threshold - 1e-9) + 1) - (F.col("n_grams") - F.size("s"))
    prefix = scratch.keep(known.where(length > 0).select("rep", "n_grams", F.explode(F.slice("s", F.lit(1), F.greatest(length, F.lit(1)).cast("int"))).alias("g")).select("rep", "n_grams", "g.gram"), "prefix")
    a, b = (prefix.select("gram", F.col("rep").alias(x), F.col("n_grams").alias(f"n_{x}")) for x in "ab")
    close = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    return a.join(b, "gram").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs that reach the threshold on full sets."""
    of = lambda x: classes.where("doc_id = rep").select(F.col("rep").alias(x), F.col("grams").alias(f"g_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("i", F.size(F.array_intersect("g_a", "g_b")))
    score = F.col("i") / (F.size("g_a") + F.size("g_b") - F.col("i"))
    return both.select("a", "b", score.alias("similarity")).where(F.col("similarity") >= threshold)


def jaccard_edges(docs: DataFrame, threshold: float, n: int = 5, order_by: Sequence[Ordering] = ()) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, similarity) between representatives, and classes (doc_id, rep, size)."""
    check_threshold(threshold, n)
    if threshold == 0:
        raise ValueError("at threshold 0 every pair is an edge; greedy selection handles it without edges")
    scratch = Scratch(docs.sparkSession, "jaccard")
    classes = jaccard_classes(with_order(docs, order_by, scratch), n, scratch)
    edges = scratch.keep(verified(_pairs(classes, threshold, scratch), classes, threshold), "edges")
    return edges, classes


def expanded(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """a < b, similarity for all documents, copies too: as many rows as there are pairs."""
    members = classes.select("doc_id", "rep")
    across = edges.join(members.select(F.col("doc_id").alias("x"), F.col("rep").alias("a")), "a").join(members.select(F.col("doc_id").alias("y"), F.col("rep").alias("b")), "b")
    x = members.select(F.col("doc_id").alias("x"), "rep")
    within = x.join(members.select(F.col("doc_id").alias("y"), "rep"), "rep").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return across.select("x", "y", "similarity").unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


# Cosine


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Directions in double, scaled by the largest component first, and which rows have one."""
    ok = np.array([v is not None and any(x for x in v) for v in vectors], bool)
    if not ok.any():
        return np.zeros((0, 0)), ok
    x = np.array([v for v, k in zip(vectors, ok, strict=True) if k], np.float64)
    if not np.isfinite(x).all():
        raise ValueError("vectors must be finite")
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), ok


def cosine_edges(docs: DataFrame, threshold: float, vector: str = "embedding", block: int = 16384, pivots: int = 256) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, similarity) between representatives of equal vectors, and classes (doc_id, rep); null and zero vectors have neither."""
    check_threshold(threshold)
    spark = docs.sparkSession
    scratch = Scratch(spark, "cosine")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.transform(vector, lambda x: x.cast("double")).alias("v")).where("exists(v, x -> x <> 0)")
    first = rows.groupBy("v").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(rows.join(first, "v").select("doc_id", "rep"), "classes")
    reps = scratch.keep(first, "reps")
    wanted = min(pivots, reps.count() // block + 1)  # cells of about a block: a vector goes to each block in reach, so blocks are large and few
    sample = [r["v"] for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(wanted).collect()]  # at most `pivots` rows
    if not sample:
        return spark.createDataFrame([], f"a {kind}, b {kind}, similarity double"), classes
    centre, _ = _unit(sample)
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-7

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = _unit(b.column(1).to_pylist())
            angle = np.arccos(np.clip(x @ centre.T, -1, 1))
            cell = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([u.tobytes() for u in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], names=["rep", "u", "cell", "angle"])

    homes = scratch.keep(reps.select("rep", "v").mapInArrow(assign, f"rep {kind}, u binary, cell int, angle double"), "homes")
    cells = {r["cell"]: (r["n"], r["radius"]) for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    parts = {c: max(1, -(-n // block)) for c, (n, _) in cells.items()}

    names = sorted(cells)
    start = dict(zip(names, np.r_[0, np.cumsum([parts[c] for c in names])][:-1].tolist(), strict=True))
    fields = [pa.field("u", pa.binary()), pa.field("p", pa.int32()), pa.field("q", pa.int32()), pa.field("right", pa.bool_())]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to the blocks (p <= q) of its part and any part of a cell that may hold a vector within reach."""
        for b in batches:
            schema, out = pa.schema([pa.field("rep", b.schema.field(0).type), *fields]), []
            for rep, u, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                mine = start[cell] + zlib.crc32(str(rep).encode()) % parts[cell]
                angle = np.arccos(np.clip(centre @ np.frombuffer(u), -1, 1))
                for c in names:
                    if c == cell or angle[c] - cells[c][1] <= reach:
                        out += [(rep, u, min(mine, o), max(mine, o), o < mine) for o in range(start[c], start[c] + parts[c])]
                while len(out) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[:4000], strict=True), schema, strict=True)], schema=schema)
                    del out[:4000]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block pair by block pair; TILE products are looked at at once."""
        held, key = [], None
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in (2, 3)])
            cuts = np.r_[0, np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, b.num_rows]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi > lo:
                    if held and key != tuple(at[:, lo]):
                        yield from compared(held, key)
                        held = []
                    key = tuple(at[:, lo])
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from compared(held, key)

    def compared(held: list[pa.RecordBatch], key: tuple) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        x = np.frombuffer(b"".join(whole.column("u").to_pylist())).reshape(whole.num_rows, -1)
        names, right = whole.column("rep").combine_chunks(), whole.column("right").to_numpy()
        same = key[0] == key[1]
        rows, columns = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(~right), np.flatnonzero(right))
        if not len(rows) or not len(columns):
            return
        left, other, step = names.take(pa.array(rows)), names.take(pa.array(columns)), max(1, TILE // len(columns))
        y = x[columns].T
        for lo in range(0, len(rows), step):
            s = x[rows[lo : lo + step]] @ y
            i, j = np.nonzero(s >= threshold)
            a, b = left.take(pa.array(i + lo)), other.take(pa.array(j))
            if same:  # each pair is met twice, and each vector by itself
                keep = pc.less(a, b)
                a, b, near = a.filter(keep), b.filter(keep), s[i, j][keep.to_numpy(zero_copy_only=False)]
            else:
                swap, near = pc.less(b, a), s[i, j]
                a, b = pc.if_else(swap, b, a), pc.if_else(swap, a, b)
            for k in range(0, len(near), EDGES):
                yield pa.RecordBatch.from_arrays([a.slice(k, EDGES), b.slice(k, EDGES), pa.array(near[k : k + EDGES])], names=["a", "b", "similarity"])

    sent = homes.mapInArrow(spread, f"rep {kind}, u binary, p int, q int, right boolean").repartition("p", "q").sortWithinPartitions("p", "q")
    return scratch.keep(sent.mapInArrow(meet, f"a {kind}, b {kind}, similarity double"), "edges"), classes


# Character MinHash


def minhash(text: str) -> tuple[list[int], list[int]] | None:
    """Signature and band buckets over character n-grams; none for a text shorter than one."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < CHARACTERS:
        return None
    h = np.zeros(len(codes) - CHARACTERS + 1, np.uint64)
    for k in range(CHARACTERS):
        h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - CHARACTERS + 1 + k]
    h = np.unique((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32))
    rng = np.random.Generator(np.random.PCG64(SEED))
    a, b = rng.integers(1, 1 << 61, PLACES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 61, PLACES, dtype=np.uint64)
    sig = np.full(PLACES, ~np.uint64(0))
    for lo in range(0, len(h), 4096):
        np.minimum(sig, (h[lo : lo + 4096, None] * a + b >> np.uint64(32)).min(axis=0), out=sig)
    buckets = [int.from_bytes(blake2b(bytes([k]) + sig[k * 8 : k * 8 + 8].tobytes(), digest_size=8).digest(), "little", signed=True) for k in range(BANDS)]
    return sig.astype(np.int64).tolist(), buckets


def evidence(docs: DataFrame) -> DataFrame:
    """doc_id, exact_hash, minhash, lsh_buckets; the last two null for short texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [minhash(t) for t in b.column(2).to_pylist()]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f and f[0] for f in found], longs), pa.array([f and f[1] for f in found], longs)], names=["doc_id", "exact_hash", "minhash", "lsh_buckets"])

    return docs.select("doc_id", "content", "text").mapInArrow(run, f"doc_id {kind}, exact_hash string, minhash array<bigint>, lsh_buckets array<bigint>")


def minhash_edges(docs: DataFrame, threshold: float, n: int = 5, order_by: Sequence[Ordering] = ()) -> tuple[DataFrame, DataFrame]:
    """Pairs that share a bucket and whose word n-gram sets reach the threshold: a subset of jaccard_edges."""
    check_threshold(threshold, n)
    scratch = Scratch(docs.sparkSession, "minhash")
    classes = jaccard_classes(with_order(docs, order_by, scratch), n, scratch)
    reps = docs.join(classes.where("doc_id = rep and n_grams > 0").select("doc_id"), "doc_id", "left_semi")
    buckets = scratch.keep(evidence(reps).select(F.col("doc_id").alias("rep"), F.posexplode("lsh_buckets").alias("band", "bucket")), "buckets")
    a, b = (buckets.select("band", "bucket", F.col("rep").alias(x)) for x in "ab")
    pairs = a.join(b, ["band", "bucket"]).where("a < b").select("a", "b").distinct()
    return scratch.keep(verified(pairs, classes, threshold), "edges"), classes


# Greedy selection


def _sequential(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sequential rule over all edges (better, worse), with ranks as positions in an order."""
    worse: dict = {}
    order: dict = {}
    kinds = None
    for b in batches:
        kinds = b.schema.field(0).type
        for u, v, ru, rv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            worse.setdefault(v, []).append(u)
            order[u], order[v] = ru, rv
    key = lambda x: tuple(order[x].values()) if isinstance(order[x], dict) else order[x]
    dropped = set()
    for x in sorted(order, key=key):
        if any(u not in dropped for u in worse.get(x, ())):
            dropped.add(x)
    if dropped:
        yield pa.RecordBatch.from_arrays([pa.array(list(dropped), kinds)], names=["node"])


def greedy(edges: DataFrame, ranks: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, kept of each node that a better kept neighbour removes. edges: a, b; ranks: doc_id, _rank for every node.

    In a round, every node without an undecided better neighbour stays and its worse neighbours go; the result is that of
    walking all nodes in order. When at most ALONE edges are undecided, one task walks them.
    """
    kind = edges.schema["a"].dataType.simpleString()
    of = lambda x: ranks.select(F.col("doc_id").alias(x), F.col("_rank").alias(f"r_{x}"))
    both = edges.join(of("a"), "a").join(of("b"), "b")
    first = F.col("r_a") < F.col("r_b")
    swap = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    all_edges = scratch.keep(both.select(swap("a", "b").alias("u"), swap("b", "a").alias("v"), swap("r_a", "r_b").alias("ru"), swap("r_b", "r_a").alias("rv")), "directed")
    left, gone, turn = all_edges, None, 0
    while (n := left.count()) > ALONE:
        stay = left.select("u").distinct().join(left.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        out = scratch.keep(left.join(stay, "u", "left_semi").select(F.col("v").alias("node")).distinct(), f"out{turn}")
        left = left.join(out.select(F.col("node").alias("u")), "u", "left_anti").join(out.select(F.col("node").alias("v")), "v", "left_anti")
        left = scratch.keep(left.select("u", "v", "ru", "rv"), f"left{turn}")
        gone = out if gone is None else gone.unionByName(out)
        turn += 1
    if n:
        out = scratch.keep(left.repartition(1).mapInArrow(_sequential, f"node {kind}"), "rest")
        gone = out if gone is None else gone.unionByName(out)
    if gone is None:
        return all_edges.select(F.col("v").alias("doc_id"), F.col("u").alias("kept"))
    live = all_edges.join(gone.select(F.col("node").alias("u")), "u", "left_anti")
    return live.groupBy("v").agg(F.min_by("u", "ru").alias("kept")).select(F.col("v").alias("doc_id"), "kept")


def similarity_losers(docs: DataFrame, threshold: float, n: int = 5, order_by: Sequence[Ordering] = (), vector: str | None = None, method: str = "jaccard") -> DataFrame:
    """doc_id, kept of each document that greedy selection removes; copies go with their representative."""
    check_threshold(threshold, n)
    scratch = Scratch(docs.sparkSession, "greedy")
    rows = with_order(docs, order_by, scratch)
    if threshold == 0 and method == "jaccard" and not vector:
        best = rows.agg(F.min_by("doc_id", "_rank").alias("kept")).first()["kept"]
        return rows.where(F.col("doc_id") != F.lit(best)).select("doc_id", F.lit(best).alias("kept"))
    if vector:
        found, classes = cosine_edges(docs, threshold, vector)
        best = classes.join(rows.select("doc_id", "_rank"), "doc_id").groupBy("rep").agg(F.min_by("doc_id", "_rank").alias("best"), F.min("_rank").alias("_rank"))
        best = scratch.keep(best, "best")  # the best document of equal vectors stands for them
        name = lambda x: best.select(F.col("rep").alias(x), F.col("best").alias(f"best_{x}"))
        found = found.join(name("a"), "a").join(name("b"), "b").select(F.col("best_a").alias("a"), F.col("best_b").alias("b"))
        classes = classes.join(best.select("rep", "best"), "rep").select("doc_id", F.col("best").alias("rep"))
        ranks = best.select(F.col("best").alias("doc_id"), "_rank")
    else:
        found, classes = (minhash_edges if method == "minhash" else jaccard_edges)(docs, threshold, n, order_by)
        ranks = classes.where("doc_id = rep").select("doc_id", F.col("rep_rank").alias("_rank"))
        if method == "minhash":  # copies are candidates by their equal signatures only if they have one
            found, classes = found, classes.where("n_grams > 0 or doc_id = rep")
    lost = scratch.keep(greedy(found.select("a", "b"), ranks, scratch), "lost")
    members = classes.select("doc_id", "rep").join(lost.select(F.col("doc_id").alias("rep"), "kept"), "rep", "left")
    return members.where("doc_id <> rep or kept is not null").select("doc_id", F.coalesce("kept", "rep").alias("kept"))
