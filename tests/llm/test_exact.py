import hashlib

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import exact, filters

from .conftest import EDGES, same

STRIP = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault((text or "").translate(STRIP), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for doc, text, *_ in rows:
        plain = (text or "").translate(STRIP)
        keep = min(groups[plain])[3]
        out.append((doc, keep, len(groups[plain]), doc == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return out


def test_edges(spark, edges, nothing):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    same(exact.exact_dedup(edges), brute(EDGES), columns)
    assert exact.exact_dedup(nothing).count() == 0
    assert exact.drop_copies(nothing).columns == nothing.columns
    kept = [r["doc_id"] for r in exact.drop_copies(edges).collect()]
    assert sorted(x for x in kept if x) == [1, 5, 6, 8, 9, 10, 11] and kept.count(None) == 2  # rows without an id are kept


def test_oracle(spark, small):
    df = exact.op2_exact_dedup(spark, small)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{small}/documents.parquet'")
    same(df, duckdb.sql(exact.SQL).fetchall(), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"])


def test_digest_clash_is_told_apart(spark, edges):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    plain = F.translate("text", exact.WHITE, "")
    digest = rows.select("doc_id", "text").select(plain.alias("plain"), F.unhex(F.sha2(plain, 256)).alias("digest")).distinct()
    got = exact._by_text(rows, plain, digest)
    same(got, [(1, 3), (2, 2), (3, 3)], ["doc_id", "keep_id"])


def test_clash_is_found_among_all_rows(spark, edges, monkeypatch):
    """With a digest of the first character alone, most texts clash; decisions are those of the texts."""
    sha2 = F.sha2
    monkeypatch.setattr(exact.F, "sha2", lambda c, bits: sha2(F.substring(c, 1, 1), bits))
    same(exact.exact_dedup(edges), [r[:4] for r in brute(EDGES)], ["doc_id", "keep_id", "group_size", "kept"])


def test_stores_digests_and_no_texts(spark, monkeypatch):
    """In a local folder each file stored makes an executor start processes: two tables of numbers and digests are stored, and the clashes."""
    rows = spark.range(0, 4000, 1, 40).selectExpr("id as doc_id", "concat('text ', repeat('long ', 50), cast(id % 900 as string)) as text")
    made, keep = {}, exact.Scratch.keep

    def watched(self, df, name):
        out = keep(self, df, name)
        made[name] = (out.dtypes, len(out.inputFiles()))
        return out

    monkeypatch.setattr(exact.Scratch, "keep", watched)
    assert exact.exact_dedup(rows).where("kept").count() == 900
    assert {kind for dtypes, _ in made.values() for _, kind in dtypes} == {"bigint", "binary"}
    assert sum(files for _, files in made.values()) <= 40 + int(spark.conf.get("spark.sql.shuffle.partitions")) + 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(-9, 0), st.integers(0, 99)), max_size=200), st.integers(2, 9))
def test_merge_index_equals_a_dict(items, memtable):
    index, want = exact.MergeIndex(memtable=memtable, fanout=2), {}
    for key, rank, ident in items:
        digest = hashlib.sha256(bytes([key])).digest()
        index.put(digest, rank, ident)
        old = want.get(digest)
        want[digest] = (*min(old[:2], (rank, ident)), old[2] + 1) if old else (rank, ident, 1)
    assert {d: index.get(d) for d in want} == want
    assert index.get(hashlib.sha256(b"absent").digest()) is None
    run = index.compact()
    assert (len(run) if run else 0) == len(want)


def test_bloom_has_no_false_negatives():
    keys = np.array([hashlib.sha256(str(k).encode()).digest() + b"\x01" for k in range(3000)], "S33")
    other = np.array([hashlib.sha256(b"x%d" % k).digest() + b"\x01" for k in range(3000)], "S33")
    bloom = exact.Bloom.sized(len(keys))
    bloom.add(*exact._halves(keys))
    assert bloom.may_hold(*exact._halves(keys)).all() and bloom.may_hold(*exact._halves(other)).mean() < 0.05


def test_filter_of_a_table_loses_no_key_at_any_size(spark):
    """Of numbers and of digests, nulls too; a filter of the least size still passes every key."""
    numbers = spark.range(2000).selectExpr("id * 7919 as id").union(spark.sql("select cast(null as bigint)"))
    digests = numbers.select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("id"))
    for keys in (numbers, digests):
        for most in (64, 1 << 20):
            may = filters.passes(keys, most)
            assert keys.where(~may(F.col("id"))).count() == 0
    other = spark.range(2000).select((F.col("id") * 7919 + 1).alias("id"))
    assert other.where(filters.passes(numbers)(F.col("id"))).count() < 100


def test_compaction_in_blocks_equals_one_sort(tmp_path):
    rng = np.random.default_rng(2)
    index = exact.MergeIndex(memtable=8, fanout=3, folder=str(tmp_path))
    want: dict[bytes, tuple] = {}
    for _ in range(500):
        digest, rank, ident = hashlib.sha256(bytes([int(rng.integers(0, 120))])).digest(), int(rng.integers(-4, 0)), int(rng.integers(0, 50))
        index.put(digest, rank, ident)
        old = want.get(digest, (0, 0, 0))
        want[digest] = (*min([old[:2], (rank, ident)] if old[2] else [(rank, ident)]), old[2] + 1)
    run = index.compact()
    got = {bytes(k)[:-1]: tuple(map(int, v)) for k, *v in zip(*run.arrays, strict=True)}
    assert got == want and all(a < b for a, b in zip(run.arrays[0][:-1], run.arrays[0][1:], strict=True))


def test_same_id_with_two_texts_loses_neither(spark):
    rows = [(3, "B"), (5, "A"), (5, "B"), (5, "A"), (None, "A"), (7, "long only here")]
    got = exact.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got, [(3, "B"), (5, "A"), (None, "A"), (7, "long only here")], ["doc_id", "text"])
