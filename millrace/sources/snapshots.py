"""Corpora as immutable Parquet snapshots under one root, with a manifest each; capture against a base; listings.

Layout: <root>/corpora/<name>/<snapshot>/documents and /manifest. The snapshot's name is a digest of its content, so a capture
that changes nothing gives the base back. Missing committed data is an error, never made anew.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.model import document_id
from millrace.scratch import Scratch

CHANGES = ("added", "changed", "removed", "unchanged")
RECORDS = ("queries", "mixtures", "datasets", "executions")


def changes(new: DataFrame, base: DataFrame | None) -> DataFrame:
    """One row: documents added, changed, removed and unchanged by source key and content."""
    if base is None:
        return new.agg(F.count("*").alias("added"), *[F.lit(0).cast("long").alias(c) for c in CHANGES[1:]])
    both = new.select("source_key", F.col("content").alias("n")).join(base.select("source_key", F.col("content").alias("b")), "source_key", "fullouter")
    n, b = F.col("n"), F.col("b")
    return both.agg(F.count_if(b.isNull()).alias("added"), F.count_if(n.isNotNull() & b.isNotNull() & (n != b)).alias("changed"), F.count_if(n.isNull()).alias("removed"), F.count_if(n == b).alias("unchanged"))


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _write(self, path: str, value: dict) -> None:
        """Whole or not at all: written aside, then renamed. A pointer that a crash took away between is found aside."""
        p, fs = self._fs(path)
        aside, _ = self._fs(f"{path}.new")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        fs.delete(p, False)
        if not fs.rename(aside, p):
            raise OSError(f"{path} can't be put in place")

    def _read(self, path: str) -> dict:
        p, fs = self._fs(path)
        return json.loads(self.spark.read.text(path if fs.exists(p) else f"{path}.new", wholetext=True).first()["value"])

    def corpora(self) -> list[str]:
        return self._names(f"{self.root}/corpora")

    def latest(self, name: str) -> str | None:
        if name not in self.corpora():
            return None
        return self._read(f"{self.root}/corpora/{name}/latest.json")["snapshot"]

    def snapshots(self, name: str) -> list[dict]:
        found = [x for x in self._names(f"{self.root}/corpora/{name}") if not x.startswith("latest.json")]
        return [self.manifest(name, x) for x in found if "manifest.json" in self._names(f"{self.root}/corpora/{name}/{x}")]

    def manifest(self, name: str, snapshot: str | None = None) -> dict:
        return self._read(f"{self.root}/corpora/{name}/{snapshot or self.latest(name)}/manifest.json")

    def record(self, kind: str, name: str, value: dict) -> None:
        """Note a query, mixture, dataset or execution; a name that is there keeps its place and takes the new value."""
        if kind not in RECORDS or not name or "/" in name:
            raise ValueError(f"records are of {RECORDS} and have a plain name; got {kind!r}, {name!r}")
        self._write(f"{self.root}/{kind}/{name}.json", value | {"name": name})

    def listing(self, kind: str, limit: int = 100, offset: int = 0) -> list[dict]:
        """A page in order of name: corpora (with their latest manifest), snapshots (of all corpora) or records of a kind."""
        if not 0 < limit <= 1000 or offset < 0:
            raise ValueError("a page has 1 to 1000 entries")
        page = slice(offset, offset + limit)
        if kind == "corpora":
            return [self.manifest(c) for c in self.corpora()[page]]
        if kind == "snapshots":
            return [m for c in self.corpora() for m in self.snapshots(c)][page]
        if kind not in RECORDS:
            raise ValueError(f"no listing of {kind!r}")
        names = sorted({x.removesuffix(".new").removesuffix(".json") for x in self._names(f"{self.root}/{kind}")})
        return [self._read(f"{self.root}/{kind}/{x}.json") for x in names[page]]

    def documents(self, name: str, limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of a corpus's documents by key, without texts."""
        return self.open(name).drop("text").orderBy("source_key").offset(offset).limit(limit)

    def capture(self, name: str, docs: DataFrame, base: str | None = None) -> str:
        """A snapshot of (source_key, text); its name. base: a snapshot of the same corpus to count changes against."""
        scratch = Scratch(self.spark, "capture")
        body = F.col("text")
        rows = docs.select(document_id(F.lit(name), F.col("source_key"), body).alias("doc_id"), F.lit(name).alias("corpus_id"), "source_key", "text", T.content(body).alias("content"), T.n_bytes(body).alias("n_bytes"), T.n_chars(body).alias("n_chars"), T.newlines(body).alias("n_lines"))
        rows = scratch.keep(rows, "rows")
        twice = rows.groupBy("source_key").count().where("count > 1").first()
        if twice:
            raise ValueError(f"the key {twice['source_key']!r} comes more than once")
        mark = lambda k: F.sum(F.conv(F.substring("doc_id", k, 12), 16, 10).cast("decimal(38,0)")).cast("string")
        one = rows.agg(F.count("*").alias("documents"), F.sum("n_bytes").alias("bytes"), F.sum("n_chars").alias("characters"), F.sum("n_lines").alias("newlines"), *[mark(k).alias(f"m{k}") for k in (1, 13, 25, 37)]).first()
        snapshot = self.spark.range(1).select(F.sha2(F.lit("/".join(str(one[f"m{k}"]) for k in (1, 13, 25, 37)) + f"/{one['documents']}"), 256)).first()[0][:40]
        at = f"{self.root}/corpora/{name}/{snapshot}"
        if base == snapshot or "manifest.json" in self._names(at):
            self._write(f"{self.root}/corpora/{name}/latest.json", {"snapshot": snapshot})
            return snapshot
        delta = changes(rows, self.open(name, base) if base else None).first().asDict()
        rows.write.mode("overwrite").parquet(f"{at}/documents")
        self._write(f"{at}/manifest.json", {k: one[k] or 0 for k in ("documents", "bytes", "characters", "newlines")} | delta | {"snapshot": snapshot, "corpus": name, "base": base})
        self._write(f"{self.root}/corpora/{name}/latest.json", {"snapshot": snapshot})
        return snapshot

    def open(self, name: str, snapshot: str | None = None) -> DataFrame:
        snapshot = snapshot or self.latest(name)
        if snapshot is None or "manifest.json" not in self._names(f"{self.root}/corpora/{name}/{snapshot}"):
            raise LookupError(f"no snapshot {snapshot} of {name}")
        return self.spark.read.parquet(f"{self.root}/corpora/{name}/{snapshot}/documents")
