"""Packing occurrences into sequences of fixed length, with exact totals before any token exists.

Offsets are running sums in two levels (sorted ranges, then what ranges before hold), each occurrence is cut into pieces by
the sequences it touches, and only pieces are shuffled.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from dataclasses import fields as dataclass_fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.model import running
from millrace.scratch import Scratch


@dataclass(frozen=True)
class Concat:
    """A separator follows every occurrence, empty ones too. Padding is given if and only if the remainder is kept."""

    length: int
    separator: int | None = None
    padding: int | None = None

    def __post_init__(self):
        if self.length < 1:
            raise ValueError("a sequence has one token at least")
        if self.separator is not None and self.separator == self.padding:
            raise ValueError("separator and padding must differ")

    @property
    def extra(self) -> int:
        return int(self.separator is not None)


def totals(occurrences: DataFrame, plan: Concat, size: str = "size") -> DataFrame:
    """One row: content, separators, dropped_content, dropped_separators, padding, sequences, output, occurrences.

    The dropped tail is shorter than a sequence, so it touches at most the last `length` non-empty occurrences; it is found
    from the running sums in `placed`, not by walking.
    """
    one = occurrences.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("content"), F.count("*").alias("occurrences"))
    total = F.col("content") + F.col("occurrences") * plan.extra
    count = F.floor(total / plan.length) if plan.padding is None else F.ceil(total / plan.length)
    one = one.withColumn("total", total).withColumn("sequences", count.cast("long")).withColumn("output", F.col("sequences") * plan.length)
    return one.select("content", (F.col("occurrences") * plan.extra).alias("separators"), F.greatest(F.lit(0), F.col("output") - F.col("total")).alias("padding"), "sequences", "output", "occurrences")


def placed(occurrences: DataFrame, order: list[Column], plan: Concat, scratch: Scratch, size: str = "size") -> tuple[DataFrame, dict]:
    """Occurrences with start (first token's place), emitted and emitted_separator; and the totals as a dict."""
    rows = scratch.keep(occurrences, "occurrences")
    t = totals(rows, plan, size).first().asDict()
    placed_rows = running(rows.withColumn("_span", F.col(size) + plan.extra), order, "_span", scratch, "start").drop("_span")
    out = F.lit(t["output"])
    placed_rows = placed_rows.withColumn("emitted", F.greatest(F.lit(0), F.least(F.col(size), out - F.col("start"))).cast("long"))
    placed_rows = placed_rows.withColumn("emitted_separator", (F.lit(bool(plan.extra)) & (F.col("start") + F.col(size) < out)).cast("long"))
    kept = scratch.keep(placed_rows, "placed")
    gone = kept.agg(F.coalesce(F.sum(F.col(size) - F.col("emitted")), F.lit(0)).alias("c"), F.coalesce(F.sum(plan.extra - F.col("emitted_separator")), F.lit(0)).alias("s")).first()
    return kept, t | {"dropped_content": gone["c"], "dropped_separators": gone["s"]}


def geometry(kept: DataFrame, plan: Concat, output: int) -> DataFrame:
    """documents (distinct in a sequence; separators count, padding doesn't), sequences."""
    end = F.least(F.col("start") + F.col("size") + plan.extra, F.lit(output))
    touched = kept.where(end > F.col("start")).select("doc_id", F.explode(F.sequence(F.floor(F.col("start") / plan.length), F.floor((end - 1) / plan.length))).alias("sequence"))
    each = touched.groupBy("sequence").agg(F.countDistinct("doc_id").alias("documents"))
    return each.groupBy("documents").agg(F.count("*").alias("sequences"))


def crossings(kept: DataFrame, plan: Concat, output: int) -> DataFrame:
    """One row: crossing, the number of sequences that hold a boundary between documents (two of them at least)."""
    return geometry(kept, plan, output).agg(F.coalesce(F.sum(F.when(F.col("documents") > 1, F.col("sequences"))), F.lit(0)).cast("long").alias("crossing"))


def source_tokens(kept: DataFrame, sources: DataFrame, column: str = "corpus_id") -> DataFrame:
    """column, tokens: the content tokens that are emitted, by source; a source all of whose tokens are dropped has none."""
    return kept.join(sources.select("doc_id", column), "doc_id").groupBy(column).agg(F.sum("emitted").cast("long").alias("tokens"))


def sequences(kept: DataFrame, tokens: DataFrame, plan: Concat, output: int) -> DataFrame:
    """sequence, tokens, loss_mask, regions (start, end, kind, doc_id, offset) of every whole sequence.

    kept: of placed(); tokens: doc_id, tokens. Separators and padding are regions of their own.
    """
    length = plan.length
    own = kept.select("doc_id", "start", "size", "emitted").join(tokens, "doc_id")
    piece = lambda at, n, ids, kind, doc, offset, sequence: F.struct((at - sequence * length).cast("int").alias("at"), n.cast("int").alias("n"), ids.alias("ids"), F.lit(kind).alias("kind"), doc.alias("doc_id"), offset.cast("long").alias("offset"))
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("emitted") - 1) / length)

    def cut(sequence: Column) -> Column:
        lo, hi = F.greatest(F.col("start"), sequence * length), F.least(F.col("start") + F.col("emitted"), (sequence + 1) * length)
        ids = F.slice("tokens", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
        return F.struct(sequence.alias("sequence"), piece(lo, hi - lo, ids, "content", F.col("doc_id"), lo - F.col("start"), sequence).alias("p"))

    # Cut before the explosion: a row of it carries its own piece, not all tokens of the document.
    parts = own.where("emitted > 0").select(F.explode(F.transform(F.sequence(first, last), cut)).alias("x")).select("x.*")
    if plan.extra:
        place = F.col("start") + F.col("size")
        sep = kept.where(place < output).withColumn("sequence", F.floor(place / length))
        parts = parts.unionByName(sep.select("sequence", piece(place, F.lit(1), F.array(F.lit(plan.separator)), "separator", F.col("doc_id"), F.col("size"), F.col("sequence")).alias("p")))
    whole = parts.groupBy("sequence").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    filled = F.aggregate("parts", F.lit(0), lambda n, p: n + p["n"])
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    pad = F.lit(length) - filled
    if plan.padding is not None:
        ids = F.concat(ids, F.array_repeat(F.lit(plan.padding), pad.cast("int")))
    regions = F.transform("parts", lambda p: F.struct(p["at"].alias("start"), (p["at"] + p["n"]).alias("end"), p["kind"].alias("kind"), p["doc_id"].alias("doc_id"), p["offset"].alias("offset")))
    return whole.select("sequence", ids.alias("tokens"), F.concat(F.array_repeat(F.lit(1), filled), F.array_repeat(F.lit(0), pad.cast("int"))).alias("loss_mask"), regions.alias("regions"))


def preview(kept: DataFrame, docs: DataFrame, tokenizer, plan: Concat, output: int, limit: int = 10, max_tokens: int = 256) -> DataFrame:
    """sequence, tokens (the first max_tokens), text (those in readable form), truncated; only documents of the prefix are encoded."""
    if not 0 < limit <= 1000 or not 0 < max_tokens <= 1_000_000:
        raise ValueError("a preview has at most 1000 sequences of at most a million tokens")
    end = min(output, limit * plan.length)
    if not end:
        end, kept = 0, kept.where("false")
    prefix = kept.where(F.col("start") < end).withColumn("emitted", F.greatest(F.lit(0), F.least("emitted", F.lit(end) - F.col("start"))))
    encoded = tokenizer.encode(docs.join(prefix.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")).select("doc_id", "tokens")
    first = sequences(prefix, encoded, plan, end).select("sequence", F.slice("tokens", 1, max_tokens).alias("tokens"), (F.size("tokens") > max_tokens).alias("truncated"))
    readable = F.udf(lambda ids: tokenizer.readable(ids, plan.separator, plan.padding), "string")  # at most 1000 rows
    return first.withColumn("text", readable("tokens"))


def batches(packed: DataFrame) -> DataFrame:
    """input_ids, attention_mask, labels (-100 where nothing is learned)."""
    labels = F.transform(F.arrays_zip("tokens", "loss_mask"), lambda x: F.when(x["loss_mask"] == 1, x["tokens"]).otherwise(-100))
    return packed.select("sequence", F.col("tokens").alias("input_ids"), F.col("loss_mask").alias("attention_mask"), labels.alias("labels"))


def reader(packed: DataFrame, rank: int, world: int, worker: int = 0, workers: int = 1, start: int = 0) -> DataFrame:
    """The sequences of one reader, from a checkpoint on."""
    if not (0 <= rank < world and 0 <= worker < workers and start >= 0):
        raise ValueError("rank and worker lie within their numbers")
    stride = world * workers
    return packed.where((F.col("sequence") % stride == rank * workers + worker) & (F.col("sequence") >= start))


@dataclass(frozen=True)
class Checkpoint:
    """Where one reader of a packed dataset stands: the dataset's identity, its share, and the next sequence it hasn't had."""

    dataset: str
    rank: int = 0
    world: int = 1
    worker: int = 0
    workers: int = 1
    next: int = 0

    def __post_init__(self):
        numbers = (self.rank, self.world, self.worker, self.workers, self.next)
        if any(type(x) is not int for x in numbers) or not (0 <= self.rank < self.world and 0 <= self.worker < self.workers and self.next >= 0):
            raise ValueError("rank and worker lie within their numbers, and the place isn't negative")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str, dataset: str) -> Checkpoint:
        """Of the same dataset, or an error; so is a document with other entries."""
        held = json.loads(text)
        if not isinstance(held, dict) or set(held) != {f.name for f in dataclass_fields(cls)}:
            raise ValueError("no reader's checkpoint")
        if held["dataset"] != dataset:
            raise ValueError(f"a checkpoint of {held['dataset']!r}, not of {dataset!r}")
        return cls(**held)

    def rest(self, packed: DataFrame) -> DataFrame:
        return reader(packed, self.rank, self.world, self.worker, self.workers, self.next)

    def after(self, sequence: int) -> Checkpoint:
        """The checkpoint once that sequence has been had."""
        if sequence % (self.world * self.workers) != self.rank * self.workers + self.worker or sequence < self.next:
            raise ValueError(f"sequence {sequence} isn't one of this reader's next")
        return replace(self, next=sequence + 1)


def window(packed: DataFrame, first: int, end: int) -> DataFrame:
    """A half-open range of parent ordinals, numbered anew."""
    return packed.where((F.col("sequence") >= first) & (F.col("sequence") < end)).withColumn("sequence", F.col("sequence") - first)


def concatenated(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Sequences of several packings (and their numbers) one after another; none crosses a boundary."""
    out, at = None, 0
    for df, n in parts:
        moved = df.withColumn("sequence", F.col("sequence") + at)
        out, at = moved if out is None else out.unionByName(moved), at + n
    return out


def permuted(packed: DataFrame, seed: int) -> DataFrame:
    """A seeded order of the sequences."""
    from millrace.functions import text as T

    return packed.withColumn("order_key", T.seeded("permute", seed, F.col("sequence")))
