"""Readers, snapshots, sinks, streaming capture, CLI."""

import gzip
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from millrace.cli import main
from millrace.model import population, union
from millrace.sources import readers as rd
from millrace.sources import sinks
from millrace.sources.snapshots import Catalog
from millrace.streaming.capture import capture_stream, latest_by_key

ROWS = [{"text": "hello 🌍\r\n"}, {"text": "second"}, {"text": ""}]


def as_map(df):
    return {r["source_key"]: r["text"] for r in df.collect()}


def test_json_lines(spark, tmp_path):
    data = "".join(json.dumps(r) + "\n" for r in ROWS).encode()
    (tmp_path / "shard.jsonl").write_bytes(data)
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "shard.jsonl.gz").write_bytes(gzip.compress(data))
    got = as_map(rd.from_jsonl(spark, f"{tmp_path}/shard.jsonl"))
    assert got == {f"shard.jsonl/{k:08d}": r["text"] for k, r in enumerate(ROWS)}
    packed = as_map(rd.from_jsonl(spark, f"{tmp_path}/z/shard.jsonl.gz"))
    assert list(packed.values()) == list(got.values()) or sorted(packed.values()) == sorted(got.values())
    (tmp_path / "keyed.jsonl").write_text('{"id": "a", "body": "x"}\n{"id": "b", "body": "y"}\nnot json\n')
    keyed = dict(text_column="body", key_column="id", prefix="p/")
    assert as_map(rd.from_jsonl(spark, f"{tmp_path}/keyed.jsonl", limit=2, **keyed)) == {"p/a": "x", "p/b": "y"}
    with pytest.raises(Exception, match="keyed.jsonl row 2"):
        rd.from_jsonl(spark, f"{tmp_path}/keyed.jsonl", **keyed).collect()


def test_files_objects_and_tables(spark, tmp_path):
    (tmp_path / "d" / "deep").mkdir(parents=True)
    (tmp_path / "d" / "a b.txt").write_text("one\ntwo\n")
    (tmp_path / "d" / "deep" / "é+.txt").write_text("three")
    assert as_map(rd.from_files(spark, f"{tmp_path}/d")) == {"a b.txt": "one\ntwo\n", "deep/é+.txt": "three"}
    path = str(tmp_path / "d" / "deep" / "é+.txt")
    assert list(as_map(rd.from_objects(spark, {path: hashlib.sha256(b"three").hexdigest()})).values()) == ["three"]
    with pytest.raises(Exception, match="digest differs"):
        rd.from_objects(spark, {path: "0" * 64}).collect()
    df = spark.createDataFrame([("1", "x")], "id string, text string")
    assert as_map(rd.from_table(df, "id", template="hf://repo/config/train/{}")) == {"hf://repo/config/train/1": "x"}
    assert as_map(rd.from_namespace(df, "ns")) == {"2:ns:1": "x"}
    assert as_map(rd.first(rd.from_rows(spark, [("b", "2"), ("a", "1")]), 1)) == {"a": "1"}
    for bad in ((" ", "x"), ("k", None)):
        with pytest.raises(Exception, match="needs a key and a text"):
            rd.from_rows(spark, [bad]).collect()


def test_capture_and_listings(spark, tmp_path, capsys):
    catalog = Catalog(spark, f"{tmp_path}/db")
    first = catalog.capture("demo", rd.from_rows(spark, [("a", "x"), ("b", "é\n"), ("c", "z")]))
    assert catalog.capture("demo", rd.from_rows(spark, [("c", "z"), ("a", "x"), ("b", "é\n")]), base=first) == first
    second = catalog.capture("demo", rd.from_rows(spark, [("a", "x"), ("b", "changed"), ("d", "new")]), base=first)
    m = catalog.manifest("demo")
    assert second != first and [m[k] for k in ("added", "changed", "removed", "unchanged", "documents")] == [1, 1, 1, 1, 3]
    assert catalog.manifest("demo", first)["newlines"] == 1 and len(catalog.snapshots("demo")) == 2
    both = union({"1": catalog.open("demo", first), "2": catalog.open("demo", second)})
    assert {r["source_key"]: r["origins"] for r in both.where("text <> 'changed'").collect()} == {"a": ["1", "2"], "b": ["1"], "c": ["1"], "d": ["2"]}
    with pytest.raises(ValueError, match="more than once"):
        catalog.capture("demo", rd.from_rows(spark, [("a", "x"), ("a", "y")]))
    with pytest.raises(LookupError):
        catalog.open("demo", "none")
    catalog.record("queries", "long", {"identity": "x", "steps": 2})
    catalog.record("queries", "all", {"identity": "y", "steps": 0})
    catalog.record("queries", "long", {"identity": "z", "steps": 1})
    assert [(r["name"], r["identity"]) for r in catalog.listing("queries")] == [("all", "y"), ("long", "z")]
    assert [r["name"] for r in catalog.listing("queries", 1, 1)] == ["long"] and catalog.listing("executions") == []
    assert [r["corpus"] for r in catalog.listing("corpora")] == ["demo"] and len(catalog.listing("snapshots")) == 2
    assert [r["source_key"] for r in catalog.documents("demo", 2, 1).collect()] == ["b", "d"]
    for bad in (lambda: catalog.record("queries", "a/b", {}), lambda: catalog.record("other", "a", {}), lambda: catalog.listing("other"), lambda: catalog.listing("queries", 0)):
        with pytest.raises(ValueError):
            bad()
    for what in (["queries"], ["corpora"], ["profile", "demo"], ["preview", "demo"], ["snapshots", "demo"]):
        assert main([f"{tmp_path}/db", "--json", *what], spark) == 0
    assert '"documents": 3' in capsys.readouterr().out


def test_sinks(spark, tmp_path):
    packed = spark.createDataFrame([(0, [1, 70000], [1, 0])], "sequence long, tokens array<int>, loss_mask array<int>")
    sinks.write_shards(packed, f"{tmp_path}/shards")
    row = spark.read.parquet(f"{tmp_path}/shards").first()
    assert struct.unpack("<2I", row["data"]) == (1, 70000) and bytes(row["mask"]) == b"\1\0"
    assert row["digest"] == hashlib.sha256(bytes(row["data"]) + bytes(row["mask"])).hexdigest()
    chosen = spark.createDataFrame([(2, "éé" * 600, 2400), (1, "a", 1), (3, "", 0), (5, "b" * 9, 9)], "doc_id long, text string, n_bytes long")
    sinks.write_selection(chosen, f"{tmp_path}/selection", shard_bytes=10)
    held = sinks.read_selection(spark, f"{tmp_path}/selection", 4).orderBy("ordinal").collect()
    assert [(r["doc_id"], r["ordinal"], r["shard"]) for r in held] == [(1, 0, 0), (2, 1, 0), (3, 2, 240), (5, 3, 240)]
    first = sinks.read_preview(spark, f"{tmp_path}/selection").orderBy("ordinal").collect()
    assert [(len(r["text"]), r["truncated"]) for r in first] == [(1, False), (1000, True), (0, False), (9, False)]
    with pytest.raises(ValueError, match="were committed"):
        sinks.read_selection(spark, f"{tmp_path}/selection", 2)
    sinks.write_selection(chosen.limit(0), f"{tmp_path}/none")
    assert sinks.read_selection(spark, f"{tmp_path}/none", 0).count() == sinks.read_preview(spark, f"{tmp_path}/none").count() == 0
    sinks.write_lineage(packed.select("sequence"), f"{tmp_path}/lineage")
    sinks.write_fields(packed.select("sequence"), packed, f"{tmp_path}/fields")
    assert spark.read.json(f"{tmp_path}/lineage").count() == spark.read.json(f"{tmp_path}/fields/fields").count() == 1


def test_streaming_capture(spark, tmp_path):
    catalog, arrive = Catalog(spark, f"{tmp_path}/db"), tmp_path / "in"
    arrive.mkdir()
    for k, rows in enumerate(([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")])):
        (arrive / f"{k}.json").write_text("".join(json.dumps({"source_key": a, "text": b}) + "\n" for a, b in rows))
        capture_stream(catalog, "live", str(arrive), f"{tmp_path}/checkpoint").awaitTermination(60)
    assert as_map(catalog.open("live")) == {"a": "1", "b": "3", "c": "4"}
    assert catalog.manifest("live")["changed"] == 1
    df = spark.createDataFrame([("a", 1), ("a", 2)], "source_key string, at int")
    assert latest_by_key(df, "at").first()["at"] == 2


def test_population_takes_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "s", "x"), (2, "é", None, "y")], "doc_id long, text string, source string, content string")
    rows = population(df).orderBy("doc_id").collect()
    assert [(r["text"], r["n_bytes"], r["n_chars"]) for r in rows] == [("", 0, 0), ("é", 2, 1)]
    assert population(df.limit(0)).count() == 0 and rows[0]["content"] == hashlib.sha256(b"").hexdigest()
    assert population(df).where(F.col("source_key") == "2").count() == 1


def test_small_shards_share_files(spark, tmp_path):
    rows = spark.range(50).selectExpr("id as doc_id", "repeat('x', 10) as text", "10L as n_bytes").repartition(5)
    sinks.write_selection(rows, f"{tmp_path}/s", shard_bytes=20)
    held = sinks.read_selection(spark, f"{tmp_path}/s", 50).collect()
    assert sorted((r["doc_id"], r["ordinal"], r["shard"]) for r in held) == [(k, k, k // 2) for k in range(50)]
    assert len(list((tmp_path / "s" / "rows").glob("*.parquet"))) == 1
