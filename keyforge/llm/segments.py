"""Distinct marked words of a block of texts, and pair merges over all of them at once.

A block is what one Arrow batch holds.  Its texts lie in one byte array, each
behind one space; words are cut out of that array without copying, and Arrow
numbers the distinct ones.  Merges run over all distinct words together: every
round each word replaces its best pair (lowest rank, then leftmost), so rounds
are as many as one word needs, not as many as there are words.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keyforge.llm.common import ship

ship(__name__)

#: Symbols merged in one go, and the length from which a word is merged by a heap.
SLICE_SYMBOLS, LONG_WORD = 400_000, 400
_NONE = np.int64(1) << 62


def firsts(length: np.ndarray) -> np.ndarray:
    """Where each of the parts with these lengths begins."""
    return np.cumsum(length) - length


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each part, one part after another."""
    return np.repeat(start - firsts(length), length) + np.arange(int(length.sum()))


def sums(values: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The sum of each part."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(length)
    return total[end] - total[end - length]


@dataclass
class Words:
    """``data`` holds the texts, each behind a space; text ``k`` has the next
    ``per_text[k]`` words; word ``i`` is ``distinct[index[i]]``."""

    data: np.ndarray
    text_length: np.ndarray
    per_text: np.ndarray
    length: np.ndarray
    distinct: pa.BinaryArray
    index: np.ndarray


def marked_words(texts: pa.Array, cuts) -> Words:
    """Words of non-empty ``texts``; ``cuts(data)`` says of each byte whether a word may begin there."""
    spaced = pc.binary_join_element_wise(pa.scalar(b" "), texts.cast(pa.binary()), pa.scalar(b""))
    if not len(spaced):
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint8), none, none, none, pa.array([], pa.binary()), none)
    offsets = np.frombuffer(spaced.buffers()[1], dtype=np.int32)[: len(spaced) + 1].astype(np.int64)
    data = np.frombuffer(spaced.buffers()[2], dtype=np.uint8)[: offsets[-1]]
    begin = cuts(data)
    begin[offsets[:-1]] = True
    start = np.flatnonzero(begin)
    bounds = np.concatenate([start, offsets[-1:]])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    per_text = np.diff(np.searchsorted(start, offsets))
    return Words(data, np.diff(offsets), per_text, np.diff(bounds), coded.dictionary, np.asarray(coded.indices).astype(np.int64))


def bytes_of(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a freshly made binary array, and the length of each entry."""
    if not len(words):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset: words.offset + len(words) + 1].astype(np.int64)
    blob = words.buffers()[2]
    data = np.frombuffer(blob, dtype=np.uint8)[offsets[0]:offsets[-1]] if blob is not None else np.zeros(0, dtype=np.uint8)
    return data, np.diff(offsets)


class Merges:
    """A table of pairs of symbols: the rank of each pair and the symbol it makes.
    Symbols below 0 are in no pair."""

    def __init__(self, left, right, rank, made):
        key = np.asarray(left, dtype=np.int64) << 32 | np.asarray(right, dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key = np.append(key[order], _NONE)
        self.rank = np.append(np.asarray(rank, dtype=np.int64)[order], _NONE >> 32)
        self.made = np.append(np.asarray(made, dtype=np.int64)[order], -1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table; the last place if it is in none."""
        key = left << 32 | right
        at = np.searchsorted(self.key[:-1], key)
        return np.where(self.key[at] == key, at, len(self.key) - 1)

    def apply(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words with these symbols and lengths after all merges."""
        symbols, length = symbols.astype(np.int64), length.astype(np.int64)
        start = firsts(length)
        out, size = [], []
        slices = np.flatnonzero(np.diff(start // SLICE_SYMBOLS, prepend=-1))
        for a, b in zip(slices, np.append(slices[1:], len(length)), strict=True):
            got, n = self._rounds(symbols[start[a]:start[b - 1] + length[b - 1]], length[a:b])
            out.append(got)
            size.append(n)
        return (np.concatenate(out), np.concatenate(size)) if out else (symbols, length)

    def _rounds(self, tok: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_words, place = len(length), firsts(length)
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(length > LONG_WORD):
            got = self._heap(tok[place[w]:place[w] + length[w]])
            ended.append((np.array([w]), np.array([len(got)]), got))
        word = np.flatnonzero((length > 0) & (length <= LONG_WORD))
        tok, length = tok[ragged(place[word], length[word])], length[word]
        start = firsts(length)
        at = np.full(len(tok), len(self.key) - 1)
        if len(tok) > 1:
            at[:-1] = self.find(tok[:-1], tok[1:])
        at[start + length - 1] = len(self.key) - 1
        while len(word):
            best = np.minimum.reduceat(self.rank[at] << 32 | np.arange(len(tok)), start)
            open_ = best >> 32 < _NONE >> 32
            if not open_.all():
                gone = np.repeat(~open_, length)
                ended.append((word[~open_], length[~open_], tok[gone]))
                p = (best[open_] & 0xFFFFFFFF) - np.cumsum(gone)[best[open_] & 0xFFFFFFFF]
                tok, at, word, length = tok[~gone], at[~gone], word[open_], length[open_]
                start = firsts(length)
            else:
                p = best & 0xFFFFFFFF
            if not len(word):
                break
            tok[p] = self.made[at[p]]
            stays = np.ones(len(tok), dtype=bool)
            stays[p + 1] = False
            tok, at = tok[stays], at[stays]
            p, length = p - np.arange(len(p)), length - 1
            start = firsts(length)
            last = p == start + length - 1
            at[p] = np.where(last, len(self.key) - 1, self.find(tok[p], tok[np.minimum(p + 1, len(tok) - 1)]))
            q = p[p > start]
            at[q - 1] = self.find(tok[q - 1], tok[q])
        size = np.zeros(n_words, dtype=np.int64)
        for w, n, _ in ended:
            size[w] = n
        place = firsts(size)
        out = np.zeros(int(size.sum()), dtype=np.int64)
        for w, n, got in ended:
            out[ragged(place[w], n)] = got
        return out, size

    def _heap(self, symbols: np.ndarray) -> np.ndarray:
        """One long word: the same order of merges from a heap of pairs."""
        tok, n, none = symbols.tolist(), len(symbols), len(self.key) - 1
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        at = self.find(symbols[:-1], symbols[1:]).tolist()
        heap = [(int(self.rank[k]), p, tok[p], tok[p + 1], k) for p, k in enumerate(at) if k != none]
        heapq.heapify(heap)
        while heap:
            _, p, left, right, k = heapq.heappop(heap)
            q = after[p]
            if q < 0 or tok[p] != left or tok[q] != right:
                continue
            tok[p], tok[q] = int(self.made[k]), None
            after[p] = after[q]
            if after[q] >= 0:
                before[after[q]] = p
            after[q] = -1
            for a in (before[p], p):
                if a >= 0 and (b := after[a]) >= 0 and (k := int(self.find(np.int64(tok[a]), np.int64(tok[b])))) != none:
                    heapq.heappush(heap, (int(self.rank[k]), a, tok[a], tok[b], k))
        return np.array([t for t in tok if t is not None], dtype=np.int64)
