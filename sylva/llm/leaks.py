"""Passages of held-out items inside a corpus, by the q-gram lemma over diagonal bands.

Both sides are reduced to lower-case words joined by single blanks. A passage of L characters that stands in a
document with at most e edits shares at least L - q + 1 - e q of its q-grams with it, all within e + 1 neighbouring
diagonals (document position minus item position). Four steps, each on what the one before has kept:

1. a bit table of the items' q-grams marks document positions; stretches with too few marks are dropped;
2. the marks that are left are looked up exactly, and hits are counted in overlapping bands of 2 (e + 1) diagonals;
3. the passages of a region that meets the bound are aligned in its band: equal stretches of a diagonal first, then, if
   edits are allowed, edit distance within the band, all passages at once;
4. without edits a passage is compared with the blanks around it, so that whole words agree.

Items are the stated query set: they are read in blocks of bounded size, each block shipped to the executors, and all
documents pass each block. No documents are shuffled. Texts are taken whole, in overlapping pieces where they are long.

Defined cases: null and empty texts and items, and items with fewer words than asked for, have no result; repeated
items each get their rows; repeated documents too; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sylva.runtime import Scratch

#: Characters of item texts in one block.
ITEM_BLOCK = 4_000_000
#: Characters of document texts handled at once.
SLICE = 2_000_000
#: Hits looked at together, about.
HITS = 4_000_000
Q = 8
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ASCII = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_SPACE, _END = 32, 10
_OTHER = re.compile(r"[\W_]+")


def plain(text: str) -> bytes:
    """Runs of letters and digits in lower case, joined and surrounded by one blank, as UTF-8."""
    if not text.isascii():
        return b" " + _OTHER.sub(" ", text).lower().strip().encode("utf-8", "surrogatepass") + b" "
    raw = np.frombuffer(b" " + text.encode("ascii").translate(_ASCII) + b" ", np.uint8)
    blank = raw == _SPACE
    return raw[np.concatenate([[True], ~(blank[1:] & blank[:-1])])].tobytes()


def characters(text: str) -> np.ndarray:
    """The same as code points, one number a character, so that edits are edits of characters."""
    return np.frombuffer(plain(text).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")


def folded(codes: np.ndarray) -> np.ndarray:
    """One byte a character: equal characters, equal bytes. What bytes find is verified on the characters."""
    return np.where(codes < 128, codes, 128 + (codes * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each position, as a number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray(len(data) - Q + 1, "<u8", data.tobytes(), strides=(1,))


class ItemIndex:
    """The q-grams of one block of items, and the bound that a region must meet."""

    def __init__(self, items: list[tuple[int, str]], words: int, edits: int):
        self.words, self.edits = words, edits
        texts = [(i, self.read(t)) for i, t in items]
        texts = [(i, t) for i, t in texts if (t == _SPACE).sum() > words]
        self.ids = np.array([i for i, _ in texts], np.int64)
        end = np.array([_END], np.uint32 if edits else np.uint8)
        self.codes = np.concatenate([end, *(x for _, t in texts for x in (t, end))])
        self.text = folded(self.codes) if edits else self.codes
        self.item = np.cumsum(self.codes == _END) - 1
        # Passages of each item: from the blank before a word to the blank after the last of ``words`` words.
        self.passages, spans, at = [], [], 1
        for _, t in texts:
            blank = at + np.flatnonzero(t == _SPACE)
            self.passages.append((blank[:-words], blank[words:] + 1))
            spans.append(blank[words:] - blank[:-words] - 1)
            at += len(t) + 1
        self.shortest = min((int(x.min()) for x in spans), default=0)
        self.longest = max((int(x.max()) for x in spans), default=0)
        self.need = max(1, self.shortest - Q + 1 - edits * Q)
        self.span = max(self.need, self.shortest - Q + 1 + edits)
        all_ = grams(self.text)
        inside = np.ones(len(all_), bool)
        for k in range(Q):
            inside &= self.text[k : k + len(all_)] != _END
        place = np.flatnonzero(inside)
        self.place = place[np.argsort(all_[place], kind="stable")]
        self.keys, self.first, self.count = np.unique(all_[self.place], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self._slot(self.keys)] = True

    def read(self, text: str) -> np.ndarray:
        return characters(text) if self.edits else np.frombuffer(plain(text), np.uint8)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)

    def regions(self, data: np.ndarray):
        """``first, last, band, item`` of every region that meets the bound: positions of its first and last hit in the
        document, and the lowest of the 2 (e + 1) diagonals of its band."""
        key = grams(data)
        if not len(self.keys) or len(key) < self.need:
            return
        mark = self.bits[self._slot(key)]
        total = np.concatenate([[0], np.cumsum(mark, dtype=np.int32)])
        span = min(self.span, len(key))
        rich = np.flatnonzero(total[span:] - total[:-span] >= self.need)
        if not len(rich):
            return
        cover = np.zeros(len(key) + 1, np.int32)
        np.add.at(cover, rich, 1)
        np.add.at(cover, rich + span, -1)
        at = np.flatnonzero((np.cumsum(cover[:-1]) > 0) & mark)
        slot = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
        real = self.keys[slot] == key[at]
        at, slot = at[real], slot[real]
        # q-grams that stand in very many items make very many hits: they are taken in stretches of the document that
        # overlap by a passage, so that memory stays bounded and no passage is cut.
        hits = np.concatenate([[0], np.cumsum(self.count[slot])])
        begin, overlap = 0, self.longest + self.span + (self.edits + 1) * (Q + 2)
        while begin < len(at):
            end = max(int(np.searchsorted(hits, hits[begin] + HITS, "right")) - 1, int(np.searchsorted(at, at[begin] + 2 * overlap)))
            yield from self._stretch(at[begin:end], slot[begin:end])
            begin = end if end >= len(at) else int(np.searchsorted(at, at[end] - overlap))

    def _stretch(self, at: np.ndarray, slot: np.ndarray):
        n, step = self.count[slot], self.edits + 1
        p = np.repeat(at, n)
        inner = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        s = self.place[np.repeat(self.first[slot], n) + inner]
        low = (p - s) // step
        p, s, low = np.concatenate([p, p]), np.concatenate([s, s]), np.concatenate([low, low - 1])
        # Items stand one after another in one text, so that neighbouring ones may share a band: each has bands of its own.
        band = low * len(self.ids) + self.item[s]
        order = np.lexsort((p, band))
        p, band = p[order], band[order]
        if len(p) < self.need:
            return
        m = self.need - 1
        full = np.flatnonzero((band[m:] == band[: len(band) - m]) & (p[m:] - p[: len(p) - m] < self.span))
        if not len(full):
            return
        cover = np.zeros(len(p) + 1, np.int32)
        np.add.at(cover, full, 1)
        np.add.at(cover, full + m + 1, -1)
        inside = np.cumsum(cover[:-1]) > 0
        split = np.concatenate([[True], (band[1:] != band[:-1]) | (p[1:] - p[:-1] >= self.span)])
        begin = np.flatnonzero(inside & (split | np.concatenate([[True], ~inside[:-1]])))
        last = np.flatnonzero(inside & np.concatenate([split[1:] | ~inside[1:], [True]]))
        for b, e in zip(begin.tolist(), last.tolist()):
            yield int(p[b]), int(p[e]), int(band[b] // len(self.ids)) * step, int(band[b] % len(self.ids))

    def found(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """``position, item, words`` of every verified passage in a piece of reduced text."""
        out = []
        for p0, p1, low, item in self.regions(folded(codes) if self.edits else codes):
            if n := self._aligned(codes, p0, p1, low, item):
                out.append((p0, int(self.ids[item]), n))
        return out

    def _aligned(self, codes: np.ndarray, p0: int, p1: int, low: int, item: int) -> int:
        """The words of the longest run of passages of the region that stand in its band within the edit budget, or 0."""
        e, width = self.edits, 2 * (self.edits + 1)
        slack = (Q + 1) * e + 1
        a, b = self.passages[item]
        near = (a >= p0 - (low + width - 1) - slack) & (b <= p1 + Q - low + slack)
        which = np.flatnonzero(near)
        if not len(which):
            return 0
        a, b = a[which], b[which]
        first, last = int(a[0]), int(b[-1])
        ok = np.zeros(len(a), bool)
        for d in range(low, low + width):
            lo, hi = max(first, -d), min(last, len(codes) - d)
            if lo < hi:
                wrong = np.concatenate([[0], np.cumsum(codes[lo + d : hi + d] != self.codes[lo:hi])])
                fits = (a >= lo) & (b <= hi)
                ok[fits] |= wrong[b[fits] - lo] == wrong[a[fits] - lo]
        if e and not ok.all():
            rest = np.flatnonzero(~ok)
            ok[rest] = within_band(self.codes, a[rest] + 1, b[rest] - 1, codes, low - e, width + 2 * e, e)
        if not ok.any():
            return 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ok & np.concatenate([[True], np.diff(which) == 1])).view(np.int8), [0]])))
        runs = (edge[1::2] - edge[::2]) if len(edge) else np.ones(1, np.int64)
        return int(max(runs.max(), 1)) - 1 + self.words


def within_band(text: np.ndarray, begin: np.ndarray, end: np.ndarray, region: np.ndarray, low: int, width: int, edits: int) -> np.ndarray:
    """Whether each passage ``text[begin:end]`` is within ``edits`` edits of a part of ``region`` that lies on the diagonals
    ``low`` ... ``low + width - 1``: all passages at once, a row of the band for each of their characters."""
    length = end - begin
    lo = max(0, int(begin.min()) + low)
    inner = np.concatenate([region[lo : max(lo, int(end.max()) + low + width)].astype(np.int64), [-1]])
    beyond = len(inner) - 1
    step = np.arange(width)
    cost = np.zeros((len(begin), width), np.int32)
    result = np.zeros(len(begin), bool)
    for i in range(int(length.max())):
        at = np.minimum(begin + i, len(text) - 1)
        spot = begin[:, None] + i + low + step - lo
        new = cost + (inner[np.where((spot < 0) | (spot > beyond), beyond, spot)] != text[at][:, None])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = (np.minimum.accumulate(new - step, axis=1) + step).astype(np.int32)
        done = length == i + 1
        if done.any():
            result[done] = cost[done].min(1) <= edits
    return result


def leaks(documents: DataFrame, items: DataFrame, words: int = 10, edits: int = 0) -> DataFrame:
    """``doc_id, item_id, words``: each document and item that share a passage of at least ``words`` words.

    ``documents`` has doc_id, text; ``items`` has item_id, item_text. ``words`` is the length of the longest run of item
    words found of which each ``words`` words are a passage. Edits are insertions, deletions and changes of characters.
    """
    sized = items.where("item_text is not null and item_id is not null").select("item_id", "item_text")
    total = sized.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-total // ITEM_BLOCK))
    scratch, result = Scratch(documents.sparkSession, "leaks"), None
    for k in range(blocks):
        part = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else sized
        shared = documents.sparkSession.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in part.collect()], words, edits))
        found = _pass(documents, shared)
        if blocks > 1:  # one block at a time on the driver and the executors
            found = scratch.save(found, f"block{k}")
            shared.destroy()
        result = found if result is None else result.union(found)
    return result


def _pass(documents: DataFrame, shared) -> DataFrame:
    """All documents against the index in a broadcast."""

    def run(batches):
        import pyarrow as pa

        at = shared.value
        overlap = at.longest + 4 * Q + 4 * at.edits
        end = np.array([_END], np.uint32 if at.edits else np.uint8)
        for batch in batches:
            best: dict[tuple[int, int], int] = {}

            def flush(pieces, docs):
                data = np.concatenate(pieces)
                start = np.cumsum([0] + [len(p) for p in pieces])
                for p, item, n in at.found(data):
                    pair = (docs[int(np.searchsorted(start, p, "right")) - 1], item)
                    best[pair] = max(n, best.get(pair, 0))

            pieces, docs, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                whole = np.concatenate([end, at.read(text), end])
                for begin in range(0, len(whole), SLICE):
                    pieces.append(np.concatenate([whole[begin : begin + SLICE + overlap], end]))
                    docs.append(doc)
                    size += len(pieces[-1])
                    if size > SLICE:
                        flush(pieces, docs)
                        pieces, docs, size = [], [], 0
            flush(pieces, docs) if pieces else None
            rows = [(d, i, n) for (d, i), n in best.items()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "item_id": pa.array([r[1] for r in rows], pa.int64()),
                    "words": pa.array([r[2] for r in rows], pa.int32()),
                }
            )

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, words int")
