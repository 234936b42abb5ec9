"""Finding edited copies of known passages in long texts: an index of word n-grams, then alignment by words.

Texts are compared by words: runs of letters and digits, lower case (characters whose lower case has another length in
UTF-8 keep their case beyond ASCII, so byte offsets hold). Passages longer than SEGMENT words are cut into segments, so
an alignment is small whatever the lengths are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm import words as wd

SEGMENT = 256
#: Words of a text that one table of an alignment decides on, and hits of seeds that are held at once.
STRIDE, HITS = 1 << 12, 1 << 19
MATCH, MISMATCH, GAP = 2, -1, -1


def folded(column: pa.Array) -> pa.Array:
    column = column.fill_null("") if column.null_count else column
    low = pc.utf8_lower(column)
    same = pc.equal(pc.binary_length(low), pc.binary_length(column))
    return low if pc.all(same, min_count=0).as_py() else pc.if_else(same, low, pc.ascii_lower(column))


def _table(a: np.ndarray, b: np.ndarray, middle: int | None, band: int) -> np.ndarray:
    """Smith-Waterman scores of ending at each pair of places."""
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1), np.int32)
    steps = np.arange(m + 1, dtype=np.int32) * -GAP
    for i in range(1, n + 1):
        lo, hi = (1, m + 1) if middle is None else (max(1, i + middle - band), min(m + 1, i + middle + band + 1))
        if lo >= hi:
            continue
        best = np.maximum(h[i - 1, lo - 1 : hi - 1] + np.where(b[lo - 1 : hi - 1] == a[i - 1], MATCH, MISMATCH), h[i - 1, lo:hi] + GAP)
        np.maximum(best, 0, out=best)
        h[i, lo:hi] = np.maximum.accumulate(best + steps[lo:hi]) - steps[lo:hi]
    return h


def align(a: np.ndarray, b: np.ndarray, middle: int | None = None, band: int = 0, stride: int = STRIDE) -> tuple[int, int, int, int, int, int]:
    """Smith-Waterman over words: score, equal words, start and end in a, start and end in b.

    With a middle, only cells (i, j) with |j - i - middle| <= band. Of equal scores the first in a, then in b, ends.

    An alignment of positive score spans less than 3 * len(a) words of b, as each word of a gains MATCH at most and each gap costs one.
    So a long b is aligned in pieces that begin six such lengths before the ends they decide on, and memory doesn't grow with b.
    """
    lead, stride = 6 * len(a), max(stride, 6 * len(a))
    best, score = None, 0
    for lo in range(0, len(b), stride):
        base = max(0, lo - lead)
        h = _table(a, b[base : lo + stride], None if middle is None else middle - base, band)
        own = h[:, lo - base + 1 :]
        i, j = map(int, np.unravel_index(int(own.argmax()), own.shape))
        if int(own[i, j]) > score or best and int(own[i, j]) == score and i < best[1]:
            score, best = int(own[i, j]), (h, i, j + lo - base + 1, base)
    if not best:
        return 0, 0, 0, 0, 0, 0
    h, i, j, base = best
    end_a, end_b, equal = i, j, 0
    while h[i, j] > 0:
        same = a[i - 1] == b[base + j - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            equal += bool(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, equal, i, end_a, base + j, base + end_b


@dataclass
class Passages:
    """Segments of known texts and the grams that seed them: owner, words, and n -> (hash, segment, place)."""

    owners: list = field(default_factory=list)
    texts: list[np.ndarray] = field(default_factory=list)
    _seeds: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)

    def add(self, owner, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Register a text; yields (segment, its words) to be seeded."""
        for lo in range(0, len(hashes), SEGMENT):
            self.owners.append(owner)
            self.texts.append(hashes[lo : lo + SEGMENT])
            yield len(self.texts) - 1, self.texts[-1]

    def seed(self, n: int, gram: int, segment: int, place: int) -> None:
        self._seeds.setdefault(n, []).append((gram, segment, place))

    def freeze(self) -> Passages:
        """The index: of a gram's places in a segment, those within reach of each other are one interval."""
        self.index = {}
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        for n, rows in self._seeds.items():
            joined: list[list[int]] = []
            for gram, segment, place in sorted(set(rows)):
                if joined and joined[-1][:2] == [gram, segment] and place - joined[-1][3] <= self.reach(segment):
                    joined[-1][3] = place
                else:
                    joined.append([gram, segment, place, place])
            grams = np.array([r[0] for r in joined], np.uint64)
            filter_ = np.zeros(1 << 20, bool)
            filter_[(grams >> np.uint64(44)).astype(np.int64)] = True
            self.index[n] = (grams, *(np.array([r[k] for r in joined], np.int64) for k in (1, 2, 3)), filter_)
        self._seeds = {}
        return self

    def reach(self, segment):
        """Diagonals of hits at most so far apart belong together."""
        return 4 + self.lengths[segment] // 4

    def _joined(self, hits: np.ndarray) -> np.ndarray:
        """Rows document, segment, least and greatest diagonal; those within reach of each other as one."""
        d, s, low, high = hits[:, np.lexsort((hits[2], hits[1], hits[0]))]
        own = np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])]
        group = np.cumsum(own) - 1
        room = int(np.abs(hits[2:]).max()) * 2 + 2 if hits.size else 1  # so that a running maximum never crosses groups
        top = np.maximum.accumulate(high + group * room) - group * room
        new = own.copy()
        new[1:] |= low[1:] - top[:-1] > self.reach(s[1:])
        first = np.flatnonzero(new)
        return np.stack([d[first], s[first], low[first], top[np.r_[first[1:], len(d)] - 1]])

    def clusters(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """document, segment, least and greatest diagonal (place in the document - place in the segment) of hits that belong together."""
        count = np.diff(at)
        doc = np.repeat(np.arange(len(count)), count)
        left = at[1:][doc] - np.arange(len(h))  # words from here to the document's end
        found, held = [], 0
        for n, (grams, segment, least, most, filter_) in self.index.items():
            s = wd.shingles(h, n)
            hit = np.flatnonzero(filter_[(s >> np.uint64(44)).astype(np.int64)] & (left >= n))
            lo, hi = np.searchsorted(grams, s[hit]), np.searchsorted(grams, s[hit], "right")
            hit, lo, size = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(size)
            begin = 0
            while begin < len(hit):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HITS, "right")))
                part = size[begin:end]
                to = np.repeat(lo[begin:end], part) + np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
                where = np.repeat(hit[begin:end], part)
                place = where - at[doc[where]]
                found.append(self._joined(np.stack([doc[where], segment[to], place - most[to], place - least[to]])))
                held += found[-1].shape[1]
                if held > HITS:
                    found = [self._joined(np.concatenate(found, axis=1))]
                    held = 0
                begin = end
        if found:
            yield from zip(*(x.tolist() for x in self._joined(np.concatenate(found, axis=1))), strict=True)


def document_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of the column: its first row, word hashes, words' offsets by document, words' starts and ends, bytes and byte offsets."""
    data, off = wd.buffers(folded(column))
    for lo, hi in wd.slices(off):
        part = off[lo : hi + 1] - off[lo]
        own = data[off[lo] : off[hi]]
        h, s, e, doc = wd.words(own, part, wd.ALNUM)
        yield lo, h, np.r_[0, np.cumsum(np.bincount(doc, minlength=hi - lo))], s, e, own, part


def char_span(own: np.ndarray, base: int, start: int, end: int) -> tuple[int, int]:
    """Code points before two byte offsets of a document that begins at base."""
    lead = (own[base:end] & 0xC0) != 0x80
    return int(lead[: start - base].sum()), int(lead.sum())


def text_hashes(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, h, at, *_ in document_words(pa.array(texts, pa.string())):
        out += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out
