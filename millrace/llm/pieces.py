"""SentencePiece encoding and decoding: an Aho-Corasick automaton over pieces drives a single-pass Viterbi.

The automaton reports, at each position, every piece that ends there by following output links; each relaxes the best
score of its end. No piece has the space mark after another character, so the best path of a text is the best paths of
its chunks (marks, then other characters) end to end, and a worker remembers the chunks it has seen (up to MEMO), each with its
ids as four bytes apiece, which are joined to a text's ids and go to Arrow as they are.
Characters that no piece covers become byte pieces. The model file's normalization is the identity with a space put
before the text, so decoding gives the text back exactly; a literal space mark (U+2581) in a text goes through byte pieces.

The model's scores are used as they stand and the path of the greatest sum wins; of equal sums the longer last piece does.

Defined results: null and empty texts have no tokens and decode to the empty text. Repeated rows repeat. An empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pick, prepare, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, MEMO, UNKNOWN = "▁", 1 << 19, -1e12
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NORMAL, UNK, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = data[at]
        out, at, shift = out | (x & 127) << shift, at + 1, shift + 7
        if x < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = (4, at) if tag & 7 == 5 else (8, at) if tag & 7 == 1 else _varint(data, at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def load_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """piece, score and kind by id."""
    import struct

    out = []
    for number, value in _fields(model):
        if number == 1:
            f = dict(_fields(value))
            out.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
    return out


class Pieces:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces, so texts could not be given back")
        self.automaton = ahocorasick.Automaton()
        for i, (p, score, kind) in enumerate(pieces):
            if kind in (NORMAL, USER):
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {p!r} has the space mark inside")
                self.automaton.add_word(p, (len(p), score, i))
        self.automaton.make_automaton()
        self.memo: dict[str, bytes] = {}
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"" for p, _, kind in pieces]

    def _viterbi(self, chunk: str) -> list[int]:
        n = len(chunk)
        best, last = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        reached = 0

        def uncovered(to: int) -> None:
            nonlocal reached
            for j in range(reached + 1, to + 1):  # what no piece reaches goes by bytes
                if best[j - 1] + UNKNOWN > best[j]:
                    best[j], last[j] = best[j - 1] + UNKNOWN, (1, -1)
            reached = max(reached, to)

        for end, (size, score, i) in self.automaton.iter(chunk):
            uncovered(end)
            j = end + 1
            s = best[j - size] + score
            if s > best[j] or s == best[j] and size > last[j][0]:
                best[j], last[j] = s, (size, i)
        uncovered(n)
        out, j = [], n
        while j:
            size, i = last[j]
            if i < 0:
                out += [self.byte[b] for b in reversed(chunk[j - 1].encode())]
            else:
                out.append(i)
            j -= size
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def packed(self, text: str | None) -> bytes:
        """The ids of encode(), four bytes each."""
        if not text:
            return b""
        if MARK in text:
            return self._escaped(text)
        return self._run(MARK + text.replace(" ", MARK))

    def _run(self, marked: str) -> bytes:
        memo, out = self.memo, []
        for chunk in _CHUNK.findall(marked):
            ids = memo.get(chunk)
            if ids is None:
                ids = array("i", self._viterbi(chunk)).tobytes()
                if len(chunk) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def _escaped(self, text: str) -> bytes:
        raw, out = array("i", [self.byte[b] for b in MARK.encode()]).tobytes(), []
        for k, part in enumerate(text.split(MARK)):
            out += [raw] if k else []
            marked = (MARK if k == 0 else "") + part.replace(" ", MARK)
            out.append(self._run(marked))
        return b"".join(out)

    def decode(self, ids: list[int] | array) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")[1:]


_loaded: dict[int, Pieces] = {}


def _codec(pieces: list[tuple[str, float, int]]) -> Pieces:
    """The worker's own, made once."""
    key = hash(tuple(pieces))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(pieces)
    return _loaded[key]


def _encoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                ids = [codec.packed(t) for t in part]
                same = [codec.decode(array("i", x)) == (t or "") for x, t in zip(ids, part, strict=True)]
                n = np.array([len(x) >> 2 for x in ids], np.int64)
                flat = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(ids))])
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, n.cumsum()].astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)), pa.array(n), tokens, pa.array(same)], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    return run


def _decoded(model):
    def run(column: pa.Array) -> pa.Array:
        codec = _codec(model.value)
        return pa.array([None if x is None else codec.decode(x) for x in column.to_pylist()], pa.string())

    return run


def _shared(spark: SparkSession, model: str):
    """The pieces as a broadcast; the file's size is fixed. It is read by Spark, so it may lie in any store."""
    path = model if "://" in model else f"file://{model}"
    data = spark.read.format("binaryFile").load(path).select("content").first()[0] if "://" in model else open(model, "rb").read()
    return spark.sparkContext.broadcast(load_pieces(bytes(data)))


def encode_pieces(docs: DataFrame, model: str = MODEL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, tokens, round_trip (whether decoding gives the text back) for every row."""
    spark = prepare(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_encoded(_shared(spark, model)), "doc_id long, n_tokens long, tokens array<int>, round_trip boolean")


def decode_pieces(tokens: DataFrame, model: str = MODEL, column: str = "tokens") -> DataFrame:
    """tokens with a column text."""
    spark = prepare(tokens.sparkSession)
    return tokens.withColumn("text", F.arrow_udf(_decoded(_shared(spark, model)), "string")(column))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))
