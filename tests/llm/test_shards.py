import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import shards

from .conftest import EDGES, documents


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(1, 6))
def test_lpt_equals_brute_force(sizes, n):
    loads = [0] * n
    placed = dict(shards.lpt(((s, k) for k, s in enumerate(sizes)), loads))
    want, by = [0] * n, {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        by[k] = min(range(n), key=lambda j: (want[j], j))
        want[by[k]] += sizes[k]
    assert placed == by and loads == want


def held(rows, texts, n):
    """The contract: sizes, checksums, groups together, slots without gaps, sizes near equal."""
    by, load, group = defaultdict(list), [0] * n, {}
    for r in rows:
        by[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(n))
    for r in rows:
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]]
            data = (text or "").encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
            assert group.setdefault(text, r["shard"]) == r["shard"]
    return load


def test_edges(spark, edges, nothing):
    rows = shards.shard_lpt(edges, 5).collect()
    assert len(rows) == len(EDGES)
    held(rows, {r[0]: r[1] for r in EDGES}, 5)
    assert shards.shard_lpt(nothing).count() == 0


def test_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    rows = shards.op10_shard_lpt(spark, tiny).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in docs)
    load = held(rows, dict(docs), shards.SHARDS)
    largest = max(r["size"] for r in rows)
    assert max(load) - min(load) <= 2 * largest


def test_small_groups_and_a_hot_one(spark):
    rows = [(k, "hot " * 20 if k % 3 == 0 else f"text {k % 1700} " * (k % 13), "en", "s") for k in range(6000)]
    got = shards.shard_lpt(documents(spark, rows), 4).collect()
    load = held(got, {r[0]: r[1] for r in rows}, 4)
    hot = sum(r["size"] for r in got if r["text_crc32"] == zlib.crc32(b"hot " * 20))
    assert max(load) - min(load) <= max(hot - sum(load) // 4, 0) * 2 + 2000
