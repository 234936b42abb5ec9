"""Queries: an ordered list of steps over a union of snapshots, then decontamination, then sampling.

compile() gives every input document with `active` and `decision` (kind, step, kept): retained, filtered, duplicate,
duplicate_unit, contaminated or not_sampled. Steps apply in the order given; each sees what the ones before kept.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.fields import Field, Ordering, Predicate
from millrace.model import few
from millrace.operators import decontaminate as dc
from millrace.operators import dedupe as dd
from millrace.operators import profiles, sampling
from millrace.operators.similarity import check_threshold, similarity_losers
from millrace.scratch import Scratch


@dataclass(frozen=True)
class Where:
    predicate: Predicate

    def recipe(self):
        return ["where", *self.predicate.recipe()]


@dataclass(frozen=True)
class Dedupe:
    algorithm: str = "document"
    order_by: tuple[Ordering, ...] = ()
    separator: str | None = None
    indexed: str | None = None  # a column of verified hashes

    def __post_init__(self):
        if self.algorithm not in ("document", "line") or self.indexed and (self.algorithm != "document" or self.separator):
            raise ValueError("exact dedup is by document or line; by an index, of documents only")

    def recipe(self):
        return ["dedupe", self.algorithm, [o.recipe() for o in self.order_by], self.separator, self.indexed]


@dataclass(frozen=True)
class Similar:
    threshold: float
    n: int = 5
    vector: str | None = None
    method: str = "jaccard"
    order_by: tuple[Ordering, ...] = ()

    def __post_init__(self):
        check_threshold(self.threshold, self.n)
        if self.method not in ("jaccard", "minhash"):
            raise ValueError("similarity is by jaccard or minhash, or of a vector")

    def recipe(self):
        return ["similar", float(self.threshold).hex(), self.n, self.vector, self.method, [o.recipe() for o in self.order_by]]


@dataclass(frozen=True)
class Decontaminate:
    references: tuple[DataFrame, ...] = ()
    algorithm: str = "ngram"
    n: int = 13
    granularity: str = "document"

    def __post_init__(self):
        if self.granularity not in ("document", "span") or self.algorithm not in ("ngram", "line", "document") or not 1 <= self.n <= 1024:
            raise ValueError("decontamination is by ngram (n 1 to 1024), line or document, of documents or spans")

    def reference(self) -> DataFrame:
        both = self.references[0].select("doc_id", "text")
        for r in self.references[1:]:
            both = both.unionByName(r.select("doc_id", "text"))
        return both

    def recipe(self):
        return ["decontaminate", self.algorithm, self.n, self.granularity, len(self.references)]


@dataclass(frozen=True)
class Sample:
    unit: str = "fraction"
    amount: float = 1.0
    seed: int = 0
    domains: tuple[Field, ...] = ()
    weights: Mapping[str, float] | None = None
    replacement: bool = False

    def stratum(self):
        return T.stratum([(d.column, d.kind == "text") for d in self.domains])

    def recipe(self):
        return ["sample", self.unit, float(self.amount).hex(), self.seed, [d.name for d in self.domains], sorted((self.weights or {}).items()), self.replacement]


def where(predicate: Predicate) -> Where:
    if not isinstance(predicate, Predicate):
        raise TypeError("where() takes one comparison")
    return Where(predicate)


_DECISION = "struct<kind:string,step:int,kept:{id}>"


@dataclass(frozen=True)
class Query:
    """names: of the snapshots that `docs` is the union of; they and the steps make the identity."""

    docs: DataFrame
    steps: tuple = ()
    decontaminate: Decontaminate | None = None
    sample: Sample | None = None
    names: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def identity(self) -> str:
        """Canonical JSON of the recipe; nothing of the session enters."""
        later = [x.recipe() for x in (self.decontaminate, self.sample) if x]
        recipe = [sorted(set(self.names)), [s.recipe() for s in self.steps], later, sorted(set(self.fields))]
        return hashlib.sha256(json.dumps(recipe, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def compile(self) -> DataFrame:
        if "rows" not in self._cache:
            self._cache["rows"] = self._compiled()
        return self._cache["rows"]

    def _compiled(self) -> DataFrame:
        scratch = Scratch(self.docs.sparkSession, "query")
        kind = _DECISION.format(id=self.docs.schema["doc_id"].dataType.simpleString())
        rows = self.docs.withColumn("decision", F.lit(None).cast(kind))
        decided = lambda name, k, kept=None: F.struct(F.lit(name).alias("kind"), F.lit(k).alias("step"), (F.lit(None) if kept is None else kept).alias("kept")).cast(kind)
        for k, step in enumerate(self.steps):
            if isinstance(step, Where):  # filters cost no pass of their own
                holds = F.coalesce(step.predicate.column, F.lit(False))
                rows = rows.withColumn("decision", F.when(F.col("decision").isNull() & ~holds, decided("filtered", k)).otherwise(F.col("decision")))
                continue
            active = rows.where("decision is null").drop("decision")
            if isinstance(step, Dedupe) and step.algorithm == "document" and not step.separator:
                lost, name = dd.exact_losers(active, step.order_by, step.indexed), "duplicate"
            elif isinstance(step, Dedupe):
                lost, name = dd.unit_losers(active, step.algorithm, step.order_by, step.separator), "duplicate_unit" if step.algorithm == "line" else "duplicate"
            else:
                lost, name = similarity_losers(active, step.threshold, step.n, step.order_by, step.vector, step.method), "duplicate"
            rows = self._marked(rows, scratch.keep(lost.select("doc_id", "kept"), f"step{k}"), decided(name, k, F.col("_kept")))
        n = len(self.steps)
        if self.decontaminate and self.decontaminate.references:
            d, active = self.decontaminate, rows.where("decision is null")
            if d.granularity == "document":
                hit = scratch.keep(dc.contaminated(active, d.reference(), d.algorithm, d.n).withColumn("kept", F.lit(None).cast(self.docs.schema["doc_id"].dataType)), "hit")
                rows = self._marked(rows, hit, decided("contaminated", n, F.col("_kept")))
            else:
                rows = dc.retained(rows, scratch.keep(dc.cut_spans(active, d.reference(), d.algorithm, d.n), "cuts"))
            n += 1
        if self.sample:
            s = self.sample
            chosen, self._cache["statistics"] = sampling.sample(rows.where("decision is null"), s.unit, s.amount, s.seed, s.stratum(), s.weights, s.replacement)
            self._cache["occurrences"] = chosen
            rows = rows.join(chosen.select("doc_id").distinct().withColumn("_in", F.lit(True)), "doc_id", "left")
            rows = rows.withColumn("decision", F.when(F.col("decision").isNull() & F.col("_in").isNull(), decided("not_sampled", n)).otherwise(F.col("decision"))).drop("_in")
        return rows.withColumn("active", F.col("decision").isNull()).withColumn("decision", F.coalesce("decision", decided("retained", None)))

    @staticmethod
    def _marked(rows: DataFrame, lost: DataFrame, decision) -> DataFrame:
        both = rows.join(few(lost.select("doc_id", F.col("kept").alias("_kept"), F.lit(True).alias("_lost"))), "doc_id", "left")
        return both.withColumn("decision", F.when(F.col("_lost"), decision).otherwise(F.col("decision"))).drop("_kept", "_lost")

    def rows(self) -> DataFrame:
        """Retained documents, one row an occurrence. Where only filters are asked for, they are filters, and so reach the scan."""
        if self.sample is None and self.decontaminate is None and all(isinstance(s, Where) for s in self.steps):
            kept, kind = self.docs, _DECISION.format(id=self.docs.schema["doc_id"].dataType.simpleString())
            for s in self.steps:
                kept = kept.where(s.predicate.column)
            retained = F.struct(F.lit("retained").alias("kind"), F.lit(None).cast("int").alias("step"), F.lit(None).alias("kept")).cast(kind)
            return kept.withColumns({"decision": retained, "active": F.lit(True), "occurrence": F.lit(0).cast("long")})
        kept = self.compile().where("active")
        if "occurrences" in self._cache:
            return kept.join(self._cache["occurrences"].select("doc_id", "occurrence"), "doc_id")
        return kept.withColumn("occurrence", F.lit(0).cast("long"))

    def projected(self) -> DataFrame:
        """The retained documents' identity, sizes and the fields asked for, whether or not a filter uses them."""
        core = ("doc_id", "corpus_id", "source_key", "n_bytes", "n_chars", "occurrence")
        if missing := [f for f in self.fields if f not in self.docs.columns]:
            raise ValueError(f"no such fields: {missing}")
        return self.rows().select(*core, *[f for f in self.fields if f not in core])

    def numbered(self) -> DataFrame:
        """rows() in final order: by document, with ordinals from 0."""
        from millrace.model import ranked

        kept = self.rows()
        return ranked(kept, [F.col("doc_id"), F.col("occurrence")], Scratch(kept.sparkSession, "numbered"), "ordinal")

    def preview(self, limit: int = 10, offset: int = 0, max_characters: int = 1000) -> DataFrame:
        if not 0 < limit <= 1000 or offset < 0 or not 0 < max_characters <= 1_000_000:
            raise ValueError("a preview has at most 1000 rows of at most a million characters")
        page = self.rows().orderBy("doc_id", "occurrence").offset(offset).limit(limit)
        return page.select("doc_id", F.substring("text", 1, max_characters).alias("text"), (F.length("text") > max_characters).alias("truncated"))

    def profile(self) -> DataFrame:
        n = len(self.steps) + bool(self.decontaminate and self.decontaminate.references) + bool(self.sample)
        return profiles.steps(self.compile(), n)

    def lineage(self) -> DataFrame:
        return self.compile().select("doc_id", "decision.*")

    def origins(self) -> DataFrame:
        """Retained documents and bytes by corpus."""
        return profiles.counts(self.rows(), "corpus_id")
