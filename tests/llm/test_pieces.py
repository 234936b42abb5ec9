import math

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pieces as pc

from .conftest import EDGES


@pytest.fixture(scope="module")
def codec():
    return pc.Pieces(pc.load_pieces(open(pc.MODEL, "rb").read()))


def brute(codec, text):
    """The best sum of scores over all ways to cut the whole text, by dynamic programming over every substring."""
    known = {p: s for p, s, kind in codec.pieces if kind in (pc.NORMAL, pc.USER)}
    marked = pc.MARK + text.replace(" ", pc.MARK)
    best = [0.0] + [-math.inf] * len(marked)
    for j in range(1, len(marked) + 1):
        best[j] = max([best[j - 1] + pc.UNKNOWN, *(best[i] + known[marked[i:j]] for i in range(max(0, j - 20), j) if marked[i:j] in known)])
    return best[-1]


def score(codec, text, ids):
    total = sum(codec.pieces[i][1] for i in ids if codec.pieces[i][2] != pc.BYTE)
    raw = b"".join(bytes([int(codec.pieces[i][0][3:5], 16)]) for i in ids if codec.pieces[i][2] == pc.BYTE)
    return total + pc.UNKNOWN * len(raw.decode())


TEXT = st.text(st.one_of(st.sampled_from("abcdetnrs   the.,é\n\t"), st.characters(blacklist_categories=["Cs"], blacklist_characters=pc.MARK)), max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_viterbi_finds_the_best_path_and_decodes(codec, text):
    ids = codec.encode(text)
    assert codec.decode(ids) == text
    if text:
        assert score(codec, text, ids) == pytest.approx(brute(codec, text), abs=1e-3)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab ▁é\n"), max_size=20))
def test_literal_marks_come_back(codec, text):
    assert codec.decode(codec.encode(text)) == text


def test_library_decodes_the_same(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=pc.MODEL)
    for text in ("the quick brown fox", "Größe señor ça 漢字 🌍", "a  b   c ", "x" * 500):
        ids = codec.encode(text)
        assert library.decode(ids) == text
        assert score(codec, text, ids) >= score(codec, text, library.encode(text)) - 1e-3


def test_edges(spark, edges, nothing):
    df = pc.encode_pieces(edges)
    rows = df.collect()
    assert len(rows) == len(EDGES) and all(r["round_trip"] for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {3: 0, 4: 0}
    texts = {r["doc_id"]: r["text"] for r in pc.decode_pieces(df).collect()}
    assert all(texts[d] == (t or "") for d, t, *_ in EDGES if d)
    assert pc.encode_pieces(nothing).count() == 0


def test_query_gives_every_text_back(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    back = pc.decode_pieces(pc.op9_sentencepiece(spark, tiny)).selectExpr("doc_id", "text as back")
    assert docs.join(back, "doc_id").where("text = back").count() == docs.count()
