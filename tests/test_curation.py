"""Dedup, similarity, decontamination and whole queries on small hand-made corpora."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import fields as fl
from millrace.model import population, ranked, running
from millrace.operators import decontaminate as dc
from millrace.operators import dedupe as dd
from millrace.operators import similarity as si
from millrace.operators import units as un
from millrace.plans import query as q
from millrace.scratch import Scratch


def pop(spark, rows, corpus="c"):
    """rows: key -> text, or (corpus, key) -> text; identifiers in order."""
    flat = [(k, *(key if isinstance(key, tuple) else (corpus, key)), text) for k, (key, text) in enumerate(rows.items())]
    return population(spark.createDataFrame(flat, "doc_id long, source string, key string, text string"), key="key")


def keys(df):
    return sorted(r["source_key"] for r in df.select("source_key").collect())


LINES = {"a": "é\n", "b": "other\né\nshared", "c": "shared", "cr": "é\r\n", "empty": "\n\n", "repeat": "unique\nunique"}


def test_line_dedupe(spark):
    p = pop(spark, LINES)
    assert keys(q.Query(p, (q.Dedupe("line"),)).rows()) == ["a", "cr", "empty", "repeat"]
    lost = {r["doc_id"]: r for r in dd.unit_losers(p).collect()}
    assert tuple(lost[1])[1:] == (0, 0, 2, 1, 6, 8) and tuple(lost[2])[1:3] == (1, 9)


def test_source_groups(spark):
    p = pop(spark, {("x", "a/first"): "shared", ("x", "b/match"): "shared", ("x", "b/sibling"): "unique", ("y", "b/safe"): "different"})
    assert keys(q.Query(p, (q.Dedupe(separator="/"),)).rows()) == ["a/first", "b/safe"]
    p = pop(spark, {"a→best": "no match", "a→z": "shared\ntail", "b→x": "shared"})
    assert keys(q.Query(p, (q.Dedupe("line", separator="→"),)).rows()) == ["a→best", "a→z"]
    for bad in ("", "ab", "\0"):
        with pytest.raises(ValueError):
            q.Query(p, (q.Dedupe(separator=bad),)).rows() if bad else dd.T.group_prefix(F.lit("x"), bad)


def test_evidence_groups(spark):
    p = pop(spark, {"a": "\né\né\n", "b": "é", "c": "é\r", "d": "", "e": "é"})
    assert sorted(r["documents"] for r in dd.evidence_groups(p, "document").collect()) == [1, 1, 1, 2]
    lines = sorted((r["places"], r["documents"]) for r in dd.evidence_groups(p, "line").collect())
    assert lines == [(1, 1), (4, 3)]
    assert [(s, e) for _, s, e in un.line_units("\né\né\n")] == [(1, 3), (4, 6)]


def test_order_matters_and_nulls_come_last(spark):
    p = pop(spark, {"a": "same", "b": "same", "c": "same"}).join(spark.createDataFrame([(0, None, "x"), (1, 5, "y"), (2, 7, "z")], "doc_id long, n int, s string"), "doc_id")
    n, s = fl.Field("n", "integer"), fl.Field("s", "text")
    kept = lambda *o: keys(q.Query(p, (q.Dedupe(order_by=o),)).rows())
    assert [kept(n.asc()), kept(n.desc()), kept(s.desc()), kept()] == [["b"], ["c"], ["c"], ["a"]]
    before = q.Query(p, (q.Dedupe(), q.where(n >= 5))).rows()
    after = q.Query(p, (q.where(n >= 5), q.Dedupe())).rows()
    assert keys(before) == [] and keys(after) == ["b"]


def test_jaccard_chain(spark):
    p = pop(spark, {"1": "a b", "2": "a b c", "3": "b c"})
    step = q.Similar(0.6, n=1, order_by=(fl.BYTES.asc(), fl.URI.asc()))
    assert keys(q.Query(p, (step,)).rows()) == ["1", "3"]
    edges, _ = si.jaccard_edges(p, 2 / 3, 1)
    assert sorted((r["a"], r["b"]) for r in edges.collect()) == [(0, 1), (1, 2)]
    assert keys(q.Query(p, (q.Similar(0.0),)).rows()) == ["1"]
    same = pop(spark, {"x": "a b", "y": "a b", "z": "b a"})
    assert keys(q.Query(same, (q.Similar(1.0, n=5),)).rows()) == ["x", "z"]  # no grams: equal by text


def sequential(ranks, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept, lost = [], {}
    for x in sorted(ranks, key=ranks.get):
        hit = [k for k in kept if k in near.get(x, ())]
        if hit:
            lost[x] = hit[0]
        else:
            kept.append(x)
    return lost


@pytest.mark.parametrize("alone", [si.ALONE, 0])
def test_greedy_equals_walking(spark, monkeypatch, alone):
    monkeypatch.setattr(si, "ALONE", alone)
    rng = random.Random(3)
    ranks = {k: rng.random() for k in range(60)}
    edges = list({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    e = spark.createDataFrame(edges, "a long, b long")
    r = spark.createDataFrame(list(ranks.items()), "doc_id long, _rank double")
    got = {x["doc_id"]: x["kept"] for x in si.greedy(e, r, Scratch(spark, "test")).collect()}
    assert got == sequential(ranks, edges)
    assert si.greedy(e.limit(0), r, Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_edges_equal_all_pairs(spark, threshold):
    rng = random.Random(6)
    rows = {}
    for g in range(8):
        base = [f"w{rng.randrange(30)}" for _ in range(rng.choice([2, 5, 20]))]
        for k in range(6):
            rows[f"{g}/{k}"] = " ".join(w if rng.random() > 0.08 * k else f"v{rng.randrange(30)}" for w in base)
    p = pop(spark, rows)
    sets = {k: {tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)} for k, t in enumerate(rows.values())}
    want = {(a, b) for a in sets for b in sets if a < b and (sets[a] or sets[b] or True) and (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else float(list(rows.values())[a] == list(rows.values())[b])) >= threshold}
    edges, classes = si.jaccard_edges(p, threshold, 2)
    assert {(r["a"], r["b"]) for r in si.expanded(edges, classes).collect()} == want
    lost = {r["doc_id"]: r["kept"] for r in si.similarity_losers(p, threshold, 2).collect()}
    assert lost == sequential({k: k for k in sets}, want)
    some, classes = si.minhash_edges(p, threshold, 2)
    assert {(r["a"], r["b"]) for r in some.collect()} <= want


def test_cosine(spark):
    vectors = [[1e200, 0.0], [1e-200, 0.0], [0.0, 1.0]]
    rows = [(k, vectors[k % 3]) for k in range(65)] + [(65, None), (66, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    edges, classes = si.cosine_edges(df, 1.0)
    assert si.expanded(edges, classes).count() == 44 * 43 // 2 + 21 * 20 // 2
    lost = {r["doc_id"] for r in si.similarity_losers(df, 1.0, vector="embedding").collect()}
    assert sorted(set(range(67)) - lost) == [0, 2, 65, 66]
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6])], "doc_id long, embedding array<double>")
    assert si.cosine_edges(two, 0.8)[0].count() == 1 and si.cosine_edges(two, 0.81)[0].count() == 0
    rng = random.Random(2)
    many = spark.createDataFrame([(k, [rng.gauss(0, 1) + 2 * (k % 5 == j) for j in range(6)]) for k in range(300)], "doc_id long, embedding array<double>")
    rows = {r["doc_id"]: r["embedding"] for r in many.collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = {(a, b) for a in rows for b in rows if a < b and sum(x * y for x, y in zip(rows[a], rows[b], strict=True)) / norm(rows[a]) / norm(rows[b]) >= 0.9}
    for block, pivots in ((2048, 256), (40, 20), (8, 7)):
        got, _ = si.cosine_edges(many, 0.9, block=block, pivots=pivots)
        assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(want)
    assert si.cosine_edges(df.where("doc_id > 64"), 0.5)[0].count() == 0


def test_span_decontamination(spark):
    p, ref = pop(spark, {"t": "pré\n秘密\nfin", "s": "safe"}), pop(spark, {"r": "秘密"})
    d = q.Decontaminate((ref,), algorithm="line", granularity="span")
    assert sorted(r["text"] for r in q.Query(p, (), d).rows().collect()) == ["pré\n\nfin", "safe"]
    m = dc.matches(p, ref, "line").first()
    assert (m["start"], m["end"], m["ref_id"]) == (5, 11, 0)
    whole = q.Query(pop(spark, {"t": "秘密"}), (), d).rows().first()
    assert (whole["text"], whole["n_bytes"], whole["active"]) == ("", 0, True)
    stats = dc.statistics(p, ref, "line", granularity="span").first()
    assert tuple(stats) == (1, 0, 1, 6)


@pytest.mark.parametrize("small", [dc.SMALL, 0])
def test_gram_decontamination_and_sampling(spark, monkeypatch, small):
    monkeypatch.setattr(dc, "SMALL", small)
    p, ref = pop(spark, {"a": "one two three", "b": "clean", "c": "also clean"}), pop(spark, {"r": "xx one two yy"})
    run = q.Query(p, (), q.Decontaminate((ref,), n=2), q.Sample("documents", 2))
    assert keys(run.rows()) == ["b", "c"]
    assert {r["doc_id"]: r["kind"] for r in run.lineage().collect()} == {0: "contaminated", 1: "retained", 2: "retained"}
    assert [tuple(r) for r in run.profile().orderBy("step").collect()] == [(0, 3, 2), (1, 2, 2)]
    assert keys(q.Query(p, (), q.Decontaminate()).rows()) == ["a", "b", "c"]


def test_strata_on_retained_length(spark):
    p, ref = pop(spark, {"a": "ab\n秘密\ncd", "b": "uvwxyz"}), pop(spark, {"r": "秘密"})
    run = q.Query(p, (), q.Decontaminate((ref,), algorithm="line", granularity="span"), q.Sample("documents", 2, domains=(fl.CHARACTERS,), weights={"[6]": 1}))
    run.compile()
    assert run._cache["statistics"]["realized_domains"] == {"[6]": 2}


def test_witness_of_references(spark):
    p, ref = pop(spark, {"t": "é\nunique"}), pop(spark, {"a": "é\nreference", "b": "é\nreference"})
    rows = dc.matches(p, ref, "line").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 2, 0, 0, 2)]


def test_grams_and_ranges():
    text = "é one  two three"
    grams = list(un.gram_units(text, 2))
    data = text.encode()
    assert [data[s:e].decode() for _, s, e in grams] == ["é one", "one  two", "two three"]
    assert grams[1][0] == next(iter(un.gram_units("one two", 2)))[0]
    assert un.coalesce([(4, 6), (0, 2), (2, 3), (5, 9)]) == [(0, 3), (4, 9)]


def test_identity(spark):
    p = pop(spark, {"a": "x"})
    one = lambda *s, names=("n",): q.Query(p, s, names=names).identity
    a, b = q.where(fl.BYTES > 3), q.Dedupe()
    assert one(a, b) == one(a, b) != one(b, a)
    assert q.Query(p, names=("x", "y", "x")).identity == q.Query(p, names=("y", "x")).identity
    with pytest.raises(TypeError):
        q.where(True)
    for bad in (lambda: q.Similar(1.5), lambda: q.Similar(0.5, n=0), lambda: q.Decontaminate(n=0), lambda: q.Dedupe("word")):
        with pytest.raises(ValueError):
            bad()


def test_preview(spark):
    run = q.Query(pop(spark, {"a": "abcdef", "b": "ab"}))
    assert [tuple(r) for r in run.preview(5, 0, 3).collect()] == [(0, "abc", True), (1, "ab", False)]
    assert [r["ordinal"] for r in run.numbered().orderBy("doc_id").collect()] == [0, 1]
    with pytest.raises(ValueError):
        run.preview(1001)


def test_ranks_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 1, 2, 3]), rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, x int, n long").repartition(7)
    order = [F.col("x").desc_nulls_last(), F.col("id").asc()]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = ranked(df, order, Scratch(spark, "test")).orderBy("rank").collect()
    assert [r["id"] for r in got] == [r[0] for r in want] and [r["rank"] for r in got] == list(range(500))
    total, expect = 0, {}
    for k, _, n in want:
        expect[k], total = total, total + n
    assert {r["id"]: r["before"] for r in running(df, order, "n", Scratch(spark, "test")).collect()} == expect
    assert running(df.limit(0), order, "n", Scratch(spark, "test")).count() == 0


def test_cosine_in_small_tiles(spark, monkeypatch):
    """Few products and edges at once give the same edges, and the default block sends a vector to few others."""
    many = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 5), k / 9]) for k in range(60)], "doc_id long, embedding array<double>")
    whole = sorted(map(tuple, si.cosine_edges(many, 0.9)[0].select("a", "b").collect()))
    real = si.cosine_edges.__defaults__
    assert real[1] >= 1 << 14 and si.TILE <= 1 << 22
    monkeypatch.setattr(si, "TILE", 64)
    monkeypatch.setattr(si, "EDGES", 3)
    assert whole and sorted(map(tuple, si.cosine_edges(many, 0.9, block=20, pivots=3)[0].select("a", "b").collect())) == whole
