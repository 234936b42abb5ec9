"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full shingle sets, union-find.

Signatures. Each element of a set visits the places of the signature in the order of a random permutation of its own and
leaves step + fraction there; a place keeps the least. So the ranks within an element are correlated (no place is visited
twice), which gives lower variance than independent hashes, and a set stops as soon as no later step can lower a place.

Grouping. Documents of equal sets form a class, represented by its smallest id; only classes go on. 32 bands of 4 places
make buckets: of two sets of similarity 0.8 at least one bucket is shared but for 5 in 10**8. A bucket is never expanded
into all its pairs. In the first round, each member meets one hub, of the hubs of its buckets (a bucket's hub is the member
that shares most buckets with others) the one that shares most, so that a large group falls together at little cost; links
are verified on the full sets and union-find joins them. Buckets that still hold several components go on: in each round,
some members outside the bucket's largest component (OUTSIDERS, then MORE times as many) meet all members of other components.
A bucket is left when all of its outsiders have met all others or joined, so no link between components is lost. Before the
full sets are compared, two bits of each place must agree as often as for similarity 0.8 less six standard deviations, and
the parities of the elements by PARITY parts of the hash may differ in no more bits than the sets may in elements (each
element in one set alone flips one bit, so this loses nothing). In the first round these bits are joined once a pair; in later
ones they stand in the rows of the few buckets that go on, so that pairs are tested where they meet. A bucket of unlinked
components costs as many such tests as it has pairs, in parts of PART members, but only pairs that pass are sent on. Members of a
bucket and partners of a hub are dealt into parts, with a copy of the hub each, so no task takes a whole group.

Texts of any length are handled in pieces; only the shingles of one text need to fit in memory, 8 bytes each. Edges up to ALONE
are joined by one task (at most 16 MB of numbers), which gives the same components as the parallel way.

Defined results: no shingles (null, empty or white text) means no links; a null doc_id is linked with nothing and kept.
Repeated rows are copies of each other and report alike. A doc_id that stands for several texts is one node with the
links of all. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import words as wd
from millrace.llm.common import Scratch, by_ids, pick, table

PLACES, BANDS = 128, 32
ROWS = PLACES // BANDS
PARITY = 1024
#: Elements whose permutations are held at once.
BLOCK = 1 << 14
#: Outsiders of a bucket that meet all others in the second round; each later round takes MORE times as many.
OUTSIDERS, MORE = 256, 16
#: Members of a bucket, or partners of a hub, that one part of a join takes.
PART = 1 << 12
#: Up to so many edges one task joins alone; more are contracted in parallel first.
ALONE = 1 << 20


def signatures(elements: np.ndarray, off: np.ndarray, m: int = PLACES, block: int = BLOCK) -> np.ndarray:
    """SuperMinHash of each set elements[off[i]:off[i+1]] as uint32: step << 24 | fraction; an empty set is all ones.

    Elements go in blocks: a set's signature is the least of its parts' by place, so a later part begins from what earlier ones left.
    """
    sig = np.full((len(off) - 1, m), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(elements), block):
        hi = min(lo + block, len(elements))
        first, last = np.searchsorted(off, [lo, hi - 1], "right") - 1
        doc = np.repeat(np.arange(last - first + 1), np.diff(np.clip(off[first : last + 2], lo, hi)))
        _lower(sig[first : last + 1], doc, elements[lo:hi])
    return sig


def _lower(sig: np.ndarray, doc: np.ndarray, h: np.ndarray) -> None:
    """Lower rows of sig by the elements h of the rows named in doc."""
    m = sig.shape[1]
    flat, perm, salts = sig.reshape(-1), None, np.arange(1, m + 1, dtype=np.uint64) * wd.GOLD
    for j in range(m):
        open_ = (sig.max(axis=1) >= j << 24)[doc]  # no later step lowers a set whose places are all of earlier steps
        doc, h = doc[open_], h[open_]
        if not len(h):
            return
        rows = np.arange(len(h))
        x = wd.mix(h + salts[j])
        k = j + (((x >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            place, perm = k, np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
            perm[rows, k] = 0
        else:
            perm = perm[open_]
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(flat, doc * m + place, ((j << 24) | (x & np.uint64(0xFFFFFF)).astype(np.int64)).astype(np.uint32))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """docs x BANDS keys as int64, distinct by band."""
    rows = sig.astype(np.uint64).reshape(len(sig), BANDS, -1)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * wd.GOLD, (len(sig), BANDS)).copy()
    for r in range(rows.shape[2]):
        key = wd.mix(key ^ rows[:, :, r]) + wd.GOLD
    return wd.mix(key).view(np.int64)


def planes(sig: np.ndarray) -> np.ndarray:
    """docs x 4 longs: the lowest bit of all 128 places, then the next."""
    bits = np.stack([(sig >> b & 1).astype(np.uint8) for b in (0, 1)], axis=1)
    return np.packbits(bits.reshape(len(sig), -1), axis=1).copy().view("<i8").reshape(len(sig), 4)


def parities(elements: np.ndarray, off: np.ndarray) -> np.ndarray:
    """docs x PARITY / 64 longs: for each part of the hash whether it has an odd number of elements."""
    out = np.zeros((len(off) - 1, PARITY // 64), np.int64)
    place = (elements >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
    for lo in range(0, len(out), 1024):
        hi = min(lo + 1024, len(out))
        doc = np.repeat(np.arange(hi - lo), np.diff(off[lo : hi + 1]))
        odd = np.bincount(doc * PARITY + place[off[lo] : off[hi]], minlength=(hi - lo) * PARITY) & 1
        out[lo:hi] = np.packbits(odd.astype(np.uint8)).view("<i8").reshape(hi - lo, -1)
    return out


def least_agreement(percent: int) -> int:
    """Places whose two bits agree, six standard deviations below what sets of that similarity have."""
    p = percent / 100 + (1 - percent / 100) / 4
    return max(0, math.floor(PLACES * p - 6 * math.sqrt(PLACES * p * (1 - p))))


_SKETCH = "doc_id long, n long, digest binary, bands array<bigint>, bits array<bigint>"


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = wd.buffers(b.column(1))
            for lo, hi in wd.slices(off):
                part = off[lo : hi + 1]
                els, at = wd.sets(data[part[0] : part[-1]], part - part[0], n)
                sig = signatures(els, at)
                keys = band_keys(sig)
                bits = np.concatenate([planes(sig), parities(els, at)], axis=1)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.reshape(-1)))
                digests = [hashlib.blake2b(els[s:e].tobytes(), digest_size=16).digest() for s, e in zip(at[:-1], at[1:], strict=True)]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(digests, pa.binary()), bands, bits], names=["doc_id", "n", "digest", "bands", "bits"])

    return run


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = wd.buffers(b.column(1))
            for lo, hi in wd.slices(off):
                part = off[lo : hi + 1]
                els, at = wd.sets(data[part[0] : part[-1]], part - part[0], n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(els.view(np.int64)))], names=["rep", "els"])

    return run


class UnionFind:
    """Path halving; the smaller root wins."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as (node, root) of its own forest."""
    uf = UnionFind()
    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            uf.join(a, c)
    nodes = [x for x in uf.up if uf.find(x) != x]
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([uf.find(x) for x in part], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, comp for each node that is not the smallest of its component.

    Each task contracts its own edges by union-find. What is left goes to one task if it is at most ALONE edges; of more, large
    and small stars alternate until only stars are left.
    """
    e = scratch.keep(edges.select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), f"{name}0")
    if e.count() <= ALONE:
        return scratch.keep(e.repartition(1).mapInArrow(_forest, "a long, b long"), f"{name}1").toDF("node", "comp")
    k = 0
    while not _stars(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m")), f"{name}-least")
        large = both.join(least, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large, f"{name}-large{k}")
        least = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-less")
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        e, old = scratch.keep(small.mapInArrow(_forest, "a long, b long").distinct(), f"{name}{k + 1}"), f"{name}{k}"
        scratch.drop(old)
        scratch.drop(f"{name}-large{k}")
        k += 1
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _stars(e: DataFrame) -> bool:
    """Whether each node has one root and no root has one."""
    twice = e.groupBy("a").count().where("count > 1").select("a")
    chained = e.join(e.select(F.col("b").alias("r")).distinct(), F.col("a") == F.col("r"), "left_semi").select("a")
    return twice.union(chained).isEmpty()


def _copies(weight) -> Column:
    """Into how many parts the partners of a hub, or the members of a bucket, are dealt."""
    return (F.floor(weight / PART) + 1).cast("int")


def _dealt(df: DataFrame, weight: str) -> DataFrame:
    """df with a part for each row by rep; each(df, weight) is its counterpart."""
    return df.withColumn("part", F.pmod(F.xxhash64("rep"), _copies(F.col(weight))).cast("int"))


def _each(df: DataFrame, weight: str) -> DataFrame:
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), _copies(F.col(weight)) - 1)))


def _verified(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of met pairs (rep, hub_rep, hub_weight) those whose full sets are similar enough, as a < b; a hub's partners are dealt into parts."""
    hubs = _each(met.select("hub_rep", "hub_weight").distinct().join(sets.select(F.col("rep").alias("hub_rep"), F.col("els").alias("hub_els")), "hub_rep"), "hub_weight")
    both = _dealt(met, "hub_weight").join(sets, "rep").drop("hub_weight").join(hubs.drop("hub_weight"), ["hub_rep", "part"])
    inter = F.size(F.array_intersect("els", "hub_els"))
    near = both.select("rep", "hub_rep", inter.alias("i"), (F.size("els") + F.size("hub_els") - inter).alias("u")).where(F.expr(f"100 * i >= {percent} * u"))
    return near.select(F.least("rep", "hub_rep").alias("a"), F.greatest("rep", "hub_rep").alias("b")).distinct()


def near_classes(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, Scratch]:
    """Sketches (doc_id, n, digest), and classes of equal sets (digest, rep, size, comp)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketch = scratch.keep(rows.mapInArrow(_sketch(shingle), _SKETCH), "sketch")
    known = sketch.where("n > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = scratch.keep(classes, "classes")
    banded = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = scratch.keep(banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    live = scratch.keep(banded.join(shared.hint("merge"), "band"), "banded")
    weights = scratch.keep(live.groupBy("rep").agg(F.sum("members").alias("weight")), "weights")
    nodes = scratch.keep(classes.select("rep", "n", "bits").join(weights.hint("merge"), "rep"), "nodes")
    reps = weights.select("rep")
    sets = by_ids(rows, reps, "doc_id", "left_semi").select("doc_id", "text")
    sets = scratch.keep(sets.mapInArrow(_full_sets(shingle), "rep long, els array<bigint>").where("size(els) > 0"), "sets")
    live = scratch.keep(live.join(weights.hint("merge"), "rep").withColumn("comp", F.col("rep")), "live")
    scratch.drop("banded")

    # First round: a bucket's hub is met by its members; bits follow once a pair, not once a bucket.
    first = F.max_by(F.struct("rep", "n", "weight"), F.struct("weight", -F.col("rep")))
    hubs = live.groupBy("band").agg(first.alias("hub"), F.first("members").alias("members")).select("band", "members", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("rep", "n", "weight")])
    hubs = _each(hubs, "members").drop("members")
    pairs = _dealt(live, "members").join(hubs, ["band", "part"]).where((F.col("rep") != F.col("hub_rep")) & F.expr(_sizes(percent)))
    pairs = pairs.select("rep", "hub_rep", "hub_weight").distinct()
    of_hubs = _each(hubs.select("hub_rep", "hub_weight").distinct().join(nodes.select(F.col("rep").alias("hub_rep"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits")), "hub_rep"), "hub_weight")
    pairs = _dealt(pairs, "hub_weight").join(nodes.select("rep", "n", "bits"), "rep").join(of_hubs.drop("hub_weight"), ["hub_rep", "part"]).where(F.expr(_near(percent)))
    met = scratch.keep(pairs.groupBy("rep").agg(F.max_by(F.struct("hub_rep", "hub_weight"), F.struct("hub_weight", -F.col("hub_rep"))).alias("hub")).select("rep", "hub.*"), "met0")

    comps, turn, most, stored = None, 0, OUTSIDERS, "live"
    while True:
        found = _verified(met, sets, percent)
        if comps is not None:  # a component so far counts as links to its smallest node
            found = found.union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        comps = components(found, scratch, f"cc{turn}-")
        live = scratch.keep(_relabelled(live, comps), f"live{turn}")
        scratch.drop(stored)
        stored = f"live{turn}"
        # Members outside the largest component of their bucket, as many as this round takes.
        sizes = live.groupBy("band", "comp").count().groupBy("band").agg(F.max_by("comp", F.struct("count", -F.col("comp"))).alias("main"), F.count("*").alias("comps")).where("comps > 1")
        rank = F.row_number().over(W.partitionBy("band").orderBy(F.desc("weight"), "rep"))
        outside = live.join(sizes.select("band", "main").hint("merge"), "band").where("comp <> main").withColumn("rank", rank).where(F.col("rank") <= most + 1)
        outside = scratch.keep(outside.drop("bits"), f"outside{turn}")
        if outside.isEmpty():
            break
        if not turn:  # only buckets of several components go on, and with bits
            live = scratch.keep(live.join(outside.select("band").distinct().hint("merge"), "band", "left_semi").join(nodes.select("rep", "bits"), "rep"), "live-on")
            scratch.drop(stored)
            stored = "live-on"
        bits = nodes.select(F.col("rep").alias("hub_rep"), F.col("bits").alias("hub_bits"))
        hubs = outside.where(F.col("rank") <= most).select("band", "members", *[F.col(c).alias(f"hub_{c}") for c in ("rep", "n", "comp", "weight")]).join(bits, "hub_rep")
        near = _dealt(live, "members").join(_each(hubs, "members").drop("members"), ["band", "part"]).where((F.col("comp") != F.col("hub_comp")) & F.expr(f"{_sizes(percent)} and {_near(percent)}"))
        turn += 1
        met = scratch.keep(near.select("rep", "hub_rep", "hub_weight").distinct(), f"met{turn}")
        live = live.join(outside.where(F.col("rank") > most).select("band").hint("merge"), "band", "left_semi")
        most *= MORE
    known = classes.select("digest", "rep", "size", F.col("rep").alias("comp"))
    return sketch, _relabelled(known, comps), scratch


def _sizes(percent: int) -> str:
    return f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"


def _near(percent: int) -> str:
    """Whether signature bits and parities let two sets be similar enough."""
    differ = " + ".join(f"bit_count((bits[{k}] ^ hub_bits[{k}]) | (bits[{k + 2}] ^ hub_bits[{k + 2}]))" for k in (0, 1))
    flipped = " + ".join(f"bit_count(bits[{k}] ^ hub_bits[{k}])" for k in range(4, 4 + PARITY // 64))
    return f"{PLACES} - ({differ}) >= {least_agreement(percent)} and {100 + percent} * ({flipped}) <= {100 - percent} * (n + hub_n)"


def _relabelled(df: DataFrame, comps: DataFrame) -> DataFrame:
    return df.drop("comp").join(comps, df["rep"] == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "rep")).drop("node")


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; shingle words, at least `percent` % similarity."""
    sketch, classes, _ = near_classes(docs, shingle, percent, text, doc_id)
    others = classes.where("size > 1 or comp <> rep").select(F.col("digest").alias("_d"), "comp")
    joined = sketch.join(others, (F.col("digest") == F.col("_d")) & F.col("doc_id").isNotNull(), "left")
    comp = F.coalesce("comp", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), comp.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each group: the one with the smallest id."""
    scratch = Scratch(docs.sparkSession, "near-kept")
    dropped = scratch.keep(near_dedup(docs, shingle, percent, text, doc_id).where("not kept").select("doc_id").distinct(), "dropped")
    return by_ids(docs, dropped, doc_id, "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=4, percent=80)
