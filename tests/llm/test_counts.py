import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import counts as ct

from .conftest import EDGES

COUNTER = ct.Counter(ct.load_ranks(open(ct.RANKS, "rb").read()))
TEXT = st.text(st.one_of(st.sampled_from("ab  c'sdl l1 2.,!\n\t é"), st.characters(blacklist_categories=["Cs"])), max_size=200)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-3, 220), st.integers(-3, 220), st.text(st.sampled_from("ab 's1.\n"), max_size=12)), max_size=8))
def test_edits_count_as_counting_anew(text, edits):
    tree = ct.TokenTree(text, COUNTER)
    assert tree.tokens == COUNTER(text) and tree.text() == text
    for start, end, new in edits:
        tree.edit(start, end, new)
        start = min(max(0, start), len(text))
        text = text[:start] + new + text[min(max(start, end), len(text)) :]
        assert tree.text() == text and tree.length == len(text)
        assert tree.tokens == COUNTER(text)


def test_an_edit_touches_few_pre_tokens():
    text = "some words in a row, and then others. " * 5000
    tree = ct.TokenTree(text, COUNTER)
    before = tree.counted
    for place in (10, 90_001, len(text) - 4):
        tree.edit(place, place + 3, "xyz ")
    assert tree.counted - before < 100 and tree.tokens == COUNTER(tree.text())
    for _ in range(300):
        tree.edit(100, 100, "more and more words here ")
    assert tree.tokens == COUNTER(tree.text())


def test_an_edit_encodes_its_region_only_and_depth_stays_low(monkeypatch):
    """As many calls as are reported, however often one place is edited; trees stay balanced and linked."""
    tree, calls = ct.TokenTree("word and another " * 4000, COUNTER), []
    count = ct.Counter.count
    monkeypatch.setattr(ct.Counter, "count", lambda self, piece: calls.append(piece) or count(self, piece))
    before = tree.counted
    for _ in range(2000):
        tree.edit(30_000, 30_000, " more")
    assert len(calls) == tree.counted - before < 2000 * 8
    tree.edit(10, 60_000, "")
    depth = lambda n: 1 + max(depth(n.left), depth(n.right)) if n.left else 1
    leaves = list(tree._each())
    assert len(leaves) == tree.root.leaves and depth(tree.root) <= 3 * len(leaves).bit_length() + 4
    assert all(a.after is b and b.before is a for a, b in zip(leaves[:-1], leaves[1:]))
    monkeypatch.undo()
    assert tree.tokens == COUNTER(tree.text())


def edited(text):
    n = len(text)
    text = text[: n // 3] + " inserted" + text[n // 3 :]
    two = 2 * n // 3
    text = text[:two] + text[two + min(40, n // 4) :]
    return text + " appended words."


def test_edges(spark, edges, nothing):
    rows = ct.token_counts(edges, ct.standard_edits(F.col("text"))).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    plain = tiktoken.Encoding("own", pat_str=ct.PATTERN, mergeable_ranks=ct.load_ranks(open(ct.RANKS, "rb").read()), special_tokens={})
    for doc, text, *_ in EDGES:
        if doc:
            assert by[doc]["n_tokens"] == len(plain.encode_ordinary(text or "")) and by[doc]["chars_after"] == len(edited(text or ""))
            assert by[doc]["tokens_after"] == len(plain.encode_ordinary(edited(text or "")))
    assert ct.token_counts(nothing, ct.standard_edits(F.col("text"))).count() == 0
    none = ct.token_counts(edges, F.lit(None).cast("array<struct<start:long,end:long,text:string>>")).collect()
    assert all(r["n_tokens"] == r["tokens_after"] and r["n_edits"] == 0 for r in none)


def test_query(spark, tiny):
    texts = dict(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect())
    for r in ct.op8_token_counts(spark, tiny).collect():
        assert (r["n_tokens"], r["tokens_after"]) == (COUNTER(texts[r["doc_id"]]), COUNTER(edited(texts[r["doc_id"]])))
