"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A text is cut into pre-tokens by the tokenizer's pattern, and byte-pair encoding never crosses them, so a document's count
is a sum. The leaves of its tree hold some LEAF pre-tokens and the count of each, and inner nodes hold sums of lengths and counts. An edit
finds its place by descending the tree by lengths, re-cuts text from a little before (the pattern looks one character
ahead) until a new boundary falls on an old one, counts only the new pre-tokens, and updates the sums on the paths.

Edits of a document are a list of (start, end, replacement) in code points of the text as the edits before have left it.

Defined results: null texts are empty and have no tokens; an edit beyond the end is cut to the end, one whose end is before its
start inserts at its start; null edits are none. Repeated rows repeat. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pick, prepare, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, MEMO = 16, 1 << 19


class Counter:
    """Tokens of a pre-token, remembered up to MEMO of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bpe = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("text", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.memo: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            n = len(self.bpe.encode_ordinary(piece))
            if len(piece) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = n
        return n

    def __call__(self, text: str | None) -> int:
        """The count without a tree."""
        return len(self.whole.encode_ordinary(text)) if text else 0


class _Node:
    """An inner node with two children, or a leaf with pre-tokens and their counts; leaves are linked in order."""

    __slots__ = ("up", "left", "right", "chars", "tokens", "leaves", "pieces", "counts", "before", "after")

    def __init__(self, pieces: list[str] | None = None, counts: list[int] | None = None):
        self.up = self.left = self.right = self.before = self.after = None
        self.leaves = 1
        if pieces is not None:
            self.fill(pieces, counts)

    def fill(self, pieces: list[str], counts: list[int]) -> None:
        self.pieces, self.counts = pieces, counts
        self.chars, self.tokens = sum(map(len, pieces)), sum(counts)

    def sum(self) -> None:
        a, b = self.left, self.right
        self.chars, self.tokens, self.leaves = a.chars + b.chars, a.tokens + b.tokens, a.leaves + b.leaves


class TokenTree:
    """length, tokens and counted (pre-tokens encoded so far) of a text that can be edited.

    Only the pre-tokens of the region that an edit changes are encoded. A leaf that grows is split, an empty one is removed, and where
    one side of a node has far more leaves than the other its leaves are joined anew, by sums alone; so depth stays logarithmic.
    """

    def __init__(self, text: str | None, counter: Counter):
        self.counter = counter
        pieces = counter.cut.findall(text or "")
        counts = list(map(counter.count, pieces))
        self.counted = len(pieces)
        leaves = self._leaves(pieces, counts)
        self.first, self.root = leaves[0], self._joined(leaves)

    @staticmethod
    def _leaves(pieces: list[str], counts: list[int]) -> list[_Node]:
        """Leaves of LEAF pre-tokens, linked with each other; one empty leaf for none."""
        out = [_Node(pieces[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, max(1, len(pieces)), LEAF)]
        for a, b in zip(out[:-1], out[1:], strict=True):
            a.after, b.before = b, a
        return out

    def _joined(self, leaves: list[_Node]) -> _Node:
        """A balanced tree over leaves."""
        if len(leaves) == 1:
            leaves[0].up = None
            return leaves[0]
        node, half = _Node(), len(leaves) // 2
        node.left, node.right = self._joined(leaves[:half]), self._joined(leaves[half:])
        node.left.up = node.right.up = node
        node.sum()
        return node

    @property
    def tokens(self) -> int:
        return self.root.tokens

    @property
    def length(self) -> int:
        return self.root.chars

    def _each(self) -> Iterator[_Node]:
        leaf = self.first
        while leaf:
            yield leaf
            leaf = leaf.after

    def text(self) -> str:
        return "".join(p for leaf in self._each() for p in leaf.pieces)

    def _leaf_at(self, place: int) -> tuple[_Node, int]:
        """The leaf of a code point and where it begins; the last leaf with text for the end."""
        node, begin = self.root, 0
        while node.left:
            if place - begin >= node.left.chars and node.right.chars:
                begin += node.left.chars
                node = node.right
            else:
                node = node.left
        return node, begin

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(0, start), self.length)
        end = min(max(start, end), self.length)
        # From two pre-tokens before the edit: one may grow, and the one before it looks a character ahead.
        first, begin = self._leaf_at(max(0, start - 1))
        while first.before and not self._back(first, begin, start):
            first = first.before
            begin -= first.chars
        keep, offset = self._back(first, begin, start) or (0, begin)
        # The old pre-tokens that the edit touches, and then as many as it takes to meet an old boundary again.
        leaf, k, at, old = first, keep, offset, []

        def more() -> bool:
            nonlocal leaf, k, at
            while leaf and k >= len(leaf.pieces):
                leaf, k = leaf.after, 0
            if not leaf:
                return False
            old.append((leaf, k))
            at += len(leaf.pieces[k])
            k += 1
            return True

        while at <= end and more():
            pass
        step = 4
        while True:
            alive = True
            for _ in range(step):
                alive = alive and more()
            was = [x.pieces[j] for x, j in old]
            joined = "".join(was)
            pieces, shift = self.counter.cut.findall(joined[: start - offset] + new + joined[end - offset :]), len(new) - (end - start)
            if not alive:
                break
            # The text goes on, so the last pre-tokens may yet change; boundaries well before its end are final.
            ends, place = {}, offset
            for j, p in enumerate(was):
                place += len(p)
                ends[place] = j
            place, met = offset, None
            for j, p in enumerate(pieces[:-2]):
                place += len(p)
                if place - shift > end and ends.get(place - shift, len(was)) < len(was) - 1:
                    met = (j + 1, ends[place - shift] + 1)
                    break
            if met:
                pieces, (leaf, k) = pieces[: met[0]], old[met[1]]
                break
            step *= 2
        counts = list(map(self.counter.count, pieces))
        self.counted += len(pieces)
        pieces, counts = first.pieces[:keep] + pieces, first.counts[:keep] + counts
        if leaf:
            pieces, counts = pieces + leaf.pieces[k:], counts + leaf.counts[k:]
        if leaf is not first:  # all leaves from the first to this one become one
            gone, stop = first.after, leaf.after if leaf else None
            while gone is not stop:
                gone, nothing = gone.after, gone
                self._removed(nothing)
        self._set(first, pieces, counts)

    def _back(self, leaf: _Node, begin: int, start: int) -> tuple[int, int] | None:
        """In a leaf, the pre-token two before the first that ends at or after start, and where it begins; none if it is further back."""
        ends, place = [], begin
        for p in leaf.pieces:
            place += len(p)
            ends.append(place)
        before = sum(e < start for e in ends)
        if before >= 2:
            keep = before - 2
            return keep, begin if keep == 0 else ends[keep - 1]
        return None if leaf.before else (0, begin)

    def _put(self, old: _Node, new: _Node) -> None:
        """new in the place of old below old's parent."""
        up = new.up = old.up
        if not up:
            self.root = new
        elif up.left is old:
            up.left = new
        else:
            up.right = new

    def _removed(self, leaf: _Node) -> None:
        """Take a leaf that isn't the only one out of the tree."""
        if leaf.before:
            leaf.before.after = leaf.after
        else:
            self.first = leaf.after
        if leaf.after:
            leaf.after.before = leaf.before
        other = leaf.up.right if leaf.up.left is leaf else leaf.up.left
        self._put(leaf.up, other)
        self._summed(other.up)

    def _set(self, leaf: _Node, pieces: list[str], counts: list[int]) -> None:
        if not pieces and (leaf.before or leaf.after):
            self._removed(leaf)
            return
        if len(pieces) <= 2 * LEAF:
            leaf.fill(pieces, counts)
            self._summed(leaf.up)
            return
        parts = self._leaves(pieces, counts)
        parts[0].before, parts[-1].after = leaf.before, leaf.after
        if leaf.before:
            leaf.before.after = parts[0]
        else:
            self.first = parts[0]
        if leaf.after:
            leaf.after.before = parts[-1]
        node = self._joined(parts)
        self._put(leaf, node)
        self._summed(node.up)

    def _summed(self, node: _Node | None) -> None:
        """New sums from a node to the root; the highest node out of balance is joined anew."""
        uneven = None
        while node:
            node.sum()
            if max(node.left.leaves, node.right.leaves) > 3 + 0.7 * node.leaves:
                uneven = node
            node = node.up
        if uneven:
            leaf = uneven
            while leaf.left:
                leaf = leaf.left
            leaves = [leaf]
            while len(leaves) < uneven.leaves:
                leaves.append(leaves[-1].after)
            self._put(uneven, self._joined(leaves))


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


_made: dict[int, Counter] = {}


def _counter(data: bytes) -> Counter:
    key = hash(data)
    if key not in _made:
        _made.clear()
        _made[key] = Counter(load_ranks(data))
    return _made[key]


_DDL = "doc_id long, n_pieces long, n_tokens long, n_edits long, tokens_after long, chars_after long, recounted long"


def _tracked(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks.value)
        for b in batches:
            rows = []
            for doc, text, edits in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                tree = TokenTree(text, counter)
                before, pieces = tree.tokens, tree.counted
                for e in edits or []:
                    tree.edit(e["start"], e["end"], e["text"] or "")
                rows.append((doc, pieces, before, len(edits or []), tree.tokens, tree.length, tree.counted - pieces))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=[x.split()[0] for x in _DDL.split(", ")])

    return run


def token_counts(docs: DataFrame, edits: Column, ranks: str = RANKS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Token counts before and after each row's edits (array of struct start, end, text), and how many pre-tokens the edits re-encoded."""
    spark = prepare(docs.sparkSession)
    data = open(ranks, "rb").read() if "://" not in ranks else bytes(spark.read.format("binaryFile").load(ranks).first()["content"])
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), edits.alias("edits"))
    return rows.mapInArrow(_tracked(spark.sparkContext.broadcast(data)), _DDL)


def standard_edits(text: Column) -> Column:
    """Three edits of any text: a word put in at a third, a quarter-long stretch of at most 40 characters cut at two thirds, words added at the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda start, end, new: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("text"))
    third, two = F.floor(n / 3), F.floor(2 * n / 3)
    return F.array(edit(third, third, " inserted"), edit(two, two + F.least(F.lit(40), F.floor(n / 4)), ""), edit(n + 1000, n + 1000, " appended words."))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), standard_edits(F.col("text")))
