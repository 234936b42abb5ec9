import random
import re

import numpy as np
import pytest

from millrace.llm import superminhash as sm

from .conftest import EDGES, documents, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    """Components by comparing all pairs."""
    sets = [(d, shingles(t, n)) for d, t, *_ in rows]
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if a is not None and b is not None and sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [(d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in sets]


COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def test_edges(spark, edges, nothing):
    same(sm.near_dedup(edges, shingle=4), brute(EDGES, 4, 80), COLUMNS)
    assert sm.near_dedup(nothing).count() == 0
    assert sm.drop_near(nothing).columns == nothing.columns
    kept = sm.drop_near(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 8, 10, 11]


def edited(rng, words, share):
    return [rng.choice("alpha beta gamma delta".split()) if rng.random() < share else w for w in words]


def test_edited_copies_in_groups(spark):
    rng = random.Random(5)
    rows, k = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 20, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            rows.append((rng.randrange(10_000) * 1000 + k, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.1]))), "en", "s"))
            k += 1
    same(sm.near_dedup(documents(spark, rows), shingle=4), brute(rows, 4, 80), COLUMNS)
    same(sm.near_dedup(documents(spark, rows), shingle=5), brute(rows, 5, 80), COLUMNS)


@pytest.mark.parametrize("alone", [sm.ALONE, 0])
def test_a_chain_joins_its_ends(spark, monkeypatch, alone):
    """Each text is near the next only, and the whole is one component; in one task, or by stars."""
    monkeypatch.setattr(sm, "ALONE", alone)
    words = [f"w{k}" for k in range(400)]
    rows = [(100 - k, " ".join(words[k * 5 : k * 5 + 100]), "en", "s") for k in range(50)]
    same(sm.near_dedup(documents(spark, rows), shingle=4), brute(rows, 4, 80), COLUMNS)


def test_a_bucket_of_many_components_takes_rounds(spark, monkeypatch):
    """Texts that share buckets with all others, but are near few."""
    monkeypatch.setattr(sm, "OUTSIDERS", 2)
    monkeypatch.setattr(sm, "MORE", 2)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base, *[f"x{rng.randrange(40)}" for _ in range(rng.choice([9, 12, 30, 40]))]]), "en", "s") for k in range(60)]
    want = brute(rows, 4, 80)
    assert 1 < len({r[2] for r in want}) < 60
    same(sm.near_dedup(documents(spark, rows), shingle=4), want, COLUMNS)


def test_query_equals_brute_force(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    same(sm.op5_near_dedup(spark, tiny), brute(rows, 4, 80), COLUMNS)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (160, 20, 20))
        off = np.array([0, 180, 360])
        sig = sm.signatures(np.concatenate([both, a, both, b]), off)
        errors.append((sig[0] == sig[1]).mean() - 160 / 200)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < np.sqrt(0.8 * 0.2 / sm.PLACES) * 1.15


def test_each_element_visits_a_permutation():
    """A set of one element fills every place, once each, in steps 0 to m - 1."""
    sig = sm.signatures(np.array([12345], np.uint64), np.array([0, 1]))
    assert sorted(sig[0] >> 24) == list(range(sm.PLACES))
    assert (sm.signatures(np.zeros(0, np.uint64), np.array([0, 0])) == 0xFFFFFFFF).all()


def test_parities_bound_the_difference():
    rng = np.random.default_rng(9)
    both, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (300, 40, 25))
    p = sm.parities(np.concatenate([both, a, both, b]), np.array([0, 340, 665, 665]))
    flipped = sum(int(x).bit_count() for x in (p[0] ^ p[1]).view(np.uint64))
    assert 45 <= flipped <= 65 and (p[2] == 0).all()
    assert sum(int(x).bit_count() for x in p[0].view(np.uint64)) == (np.bincount((np.concatenate([both, a]) >> np.uint64(54)).astype(int)) % 2).sum()


def test_blocks_change_no_signature():
    rng = np.random.default_rng(6)
    els = rng.integers(0, 2**63, 5000).astype(np.uint64)
    off = np.array([0, 0, 7, 3000, 3000, 4990, 5000])
    want = sm.signatures(els, off)
    for block in (1, 13, 512):
        assert (sm.signatures(els, off, block=block) == want).all()


def test_pieces_change_no_word():
    rng = random.Random(3)
    for _ in range(30):
        texts = ["".join(rng.choice("ab c\t\u00e9") for _ in range(rng.randrange(0, 60))).encode() for _ in range(8)]
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        want = [(off[d] + m.start(), off[d] + m.end(), d) for d, t in enumerate(texts) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        whole = sm.wd.words(data, off)
        assert list(zip(*(x.tolist() for x in whole[1:]), strict=True)) == want
        for piece in (1, 2, 3, 7):
            assert all((x == y).all() for x, y in zip(sm.wd.words(data, off, piece=piece), whole, strict=True))


def test_a_text_of_50_mb_needs_little_more_than_its_words():
    import tracemalloc

    import pyarrow as pa

    text = " ".join(f"w{k * 7919 % 1000003}" for k in range(6_500_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text], pa.string())], names=["doc_id", "text"])
    n = len(text)
    del text
    tracemalloc.start()
    out = next(sm._sketch(5)(iter([batch])))
    assert n > 50_000_000 and tracemalloc.get_traced_memory()[1] < 600 << 20 and out.column(1)[0].as_py() > 1_000_000
    tracemalloc.stop()


def test_a_bucket_of_many_unlinked_classes(spark):
    """All texts share a passage, so buckets hold many of them, yet few are near each other; parts of a bucket lose nothing."""
    rng = random.Random(21)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(5000):
        tail = [f"t{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((2 * k, " ".join([*passage, *tail]), "en", "s"))
        if k % 50 == 0:
            rows.append((2 * k + 1, " ".join([*passage, *tail[:-1], "other"]), "en", "s"))
    got = sm.near_dedup(documents(spark, rows), shingle=4).select("doc_id", "component_id").collect()
    assert sum(r["doc_id"] != r["component_id"] for r in got) == 100
    assert all(r["component_id"] == r["doc_id"] - r["doc_id"] % 2 for r in got)


def test_parts_of_buckets_and_hubs_lose_nothing(spark, monkeypatch, tiny):
    monkeypatch.setattr(sm, "PART", 3)
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + k, f"{rows[0][1]} and then {k % 7}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(sm.near_dedup(df, shingle=4), brute(rows, 4, 80), COLUMNS)
