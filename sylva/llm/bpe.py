"""Byte-level BPE over a whole corpus by batched merge rounds.

A text is cut into words by the vocabulary's pattern; equal words have equal ids, so each batch encodes only words
that the worker has not met. All new words lie in one flat array of symbols. In each round every word finds its
lowest-rank adjacent pair, by binary search over the sorted pair keys, and all its occurrences of that pair merge at
once; a word leaves when no pair is left. Rounds are as many as the longest word has distinct merges, and each is a
few array operations, however many words there are.

Defined cases: a null and an empty text give an empty list; strings that look like special tokens are ordinary text;
texts of any length are encoded whole; equal texts give equal ids; other columns of the input are not read.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame

#: Texts of one Arrow batch are encoded in slices of about so many characters.
SLICE = 2_000_000
#: The word memory of a worker starts anew beyond so many words; results do not depend on it.
MEMORY = 300_000

# Fixed values of the vocabulary's format: the pattern that cuts words, and its form for ASCII text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r\x1c- A-Za-z0-9]+|[\t-\r\x1c- ]+(?![^\t-\r\x1c- ])|[\t-\r\x1c- ]+"


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file: printable Latin-1 bytes stand for
    themselves, all others for the code points from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of words for one vocabulary file with ``model.vocab`` and ``model.merges``."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.byte_id = np.zeros(256, np.uint32)
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.pattern, self.ascii_pattern = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.flat, self.start, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    def words(self, text: str) -> list[str]:
        return (self.ascii_pattern if text.isascii() else self.pattern).findall(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin: n + 1 offsets."""
        if len(self.known) > MEMORY:
            self._forget()
        number, counts, before = self.known.__getitem__, [0], len(self.known)
        at: list[int] = []
        for text in texts:
            if text:
                at.extend(map(number, self.words(text)))
            counts.append(len(at))
        new = len(self.known) - before
        if new:
            self._learn(list(self.known)[before:] if before else list(self.known), before)
        at_ = np.fromiter(at, np.int64, len(at))
        first = self.start[at_]
        length = self.start[at_ + 1] - first
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[np.array(counts)]

    def _learn(self, words: list[str], before: int) -> None:
        ids, sizes = self.merge(words)
        need = self.used + len(ids)
        while len(self.flat) < need:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < before + len(words) + 1:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : need] = ids
        self.start[before + 1 : before + len(words) + 1] = self.used + np.cumsum(sizes)
        self.used = need

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(raw)), size)
        done_word, done_symbol = [], []
        none = np.int64(len(self.keys))
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.searchsorted(self.keys, key)
            np.minimum(at, none - 1, out=at)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, begin)
            span = np.diff(np.append(begin, len(word)))
            live = np.repeat(lowest < none, span)
            if not live.all():
                done_word.append(word[~live]), done_symbol.append(symbol[~live])
                hit = (rank == np.repeat(lowest, span))[live]
                symbol, word, rank = symbol[live], word[live], rank[live]
                if not len(symbol):
                    break
            else:
                hit = rank == np.repeat(lowest, span)
            # In a run of overlapping hits (aaa) the 1st, 3rd, ... merge, from the left.
            place = np.flatnonzero(hit)
            fresh = np.concatenate([[True], np.diff(place) != 1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            symbol[place] = self.merged[rank[place]]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(raw), np.int64)
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(raw))


class _Numbers(dict):
    """Words numbered as they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def encode_corpus(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` of every row; ``vocabulary`` is the file's path on the executors. No shuffle."""

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < len(texts):
                part, chars, begin = [], 0, at
                while at < len(texts) and (chars < SLICE or not part):
                    value = texts[at].as_py()
                    part.append(value)
                    chars += len(value or "")
                    at += 1
                ids, ends = encoder.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), lists], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
