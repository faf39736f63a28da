"""Elias-Fano sequences and the n-gram trie made of them, as memory-mapped arrays."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd

_WORD = np.uint64(64)
# Place of the n-th set bit of each byte value; 8 if there is none.
_SELECT = np.full((256, 8), 8, np.uint8)
for _value in range(256):
    for _n, _bit in enumerate(b for b in range(8) if _value >> b & 1):
        _SELECT[_value, _n] = _bit


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in an unnamed file of the task's temporary folder, mapped into memory."""
    if not array.nbytes:
        return array
    with tempfile.TemporaryFile() as file:
        array.tofile(file)
        file.flush()
        return np.memmap(file, array.dtype, "r", shape=array.shape)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, offset = (at // _WORD).astype(np.int64), at % _WORD
        np.bitwise_or.at(words, word, values << offset)
        over = offset > np.uint64(64 - width)
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (_WORD - offset[over]))
    return words


class EliasFano:
    """A sorted sequence of whole numbers: packed low bits, and high bits in unary."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        most = int(values[-1]) if self.n else 0
        self.width = max(0, (most // max(1, self.n)).bit_length() - 1)
        self.mask = np.uint64((1 << self.width) - 1)
        self.low = mapped(_packed(values & self.mask, self.width))
        high = (values >> np.uint64(self.width)).astype(np.int64)
        self.highest = int(high[-1]) if self.n else -1
        set_bits = high + np.arange(self.n)
        words = np.zeros((self.n + self.highest + 1) // 64 + 1, np.uint64)
        np.bitwise_or.at(words, set_bits >> 6, np.uint64(1) << (set_bits & 63).astype(np.uint64))
        self.high = mapped(words)
        zeros = 64 - np.bitwise_count(words).astype(np.int64)
        zeros = np.r_[0, np.cumsum(zeros)]
        self.zeros, self.ones = mapped(zeros), mapped(np.arange(len(zeros)) * 64 - zeros)

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, offset = (bit // _WORD).astype(np.int64), bit % _WORD
        upper = np.where(offset > 0, self.low[word + 1] << ((_WORD - offset) % _WORD), np.uint64(0))
        return (self.low[word] >> offset | upper) & self.mask

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left = k - self.zeros[word]
        free = (~self.high[word]).view(np.uint8).reshape(-1, 8)
        counts = np.bitwise_count(free)
        before = np.cumsum(counts, axis=1, dtype=np.int64) - counts
        byte = (before <= left[:, None]).sum(axis=1) - 1
        rows = np.arange(len(k))
        return word * 64 + byte * 8 + _SELECT[free[rows, byte], left - before[rows, byte]]

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first element at or above each x, and whether it equals x."""
        x = x.astype(np.uint64)
        high = x >> np.uint64(self.width)
        inside = (high <= np.uint64(max(self.highest, 0))) & (self.n > 0)
        at = np.full(len(x), self.n, np.int64)
        equal = np.zeros(len(x), bool)
        own = np.flatnonzero(inside)
        if not len(own):
            return at, equal
        h, low = high[own].astype(np.int64), x[own] & self.mask
        start = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - h + 1, 0)
        # The last bucket has no zero behind it.
        end = np.where(h < self.highest, self._zero(np.minimum(h, max(self.highest - 1, 0))) - h, self.n) if self.highest else np.full(len(own), self.n)
        a, b = start.copy(), end.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            middle = (a[open_] + b[open_]) // 2
            less = self._low(middle) < low[open_]
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)
        at[own] = a
        hit = np.flatnonzero(a < end)
        equal[own[hit]] = self._low(a[hit]) == low[hit]
        return at, equal

    def access(self, at: np.ndarray) -> np.ndarray:
        """The elements with these numbers."""
        if not len(at):
            return np.zeros(0, np.uint64)
        word = np.searchsorted(self.ones, at, "right") - 1
        left = at - self.ones[word]
        taken = self.high[word].view(np.uint8).reshape(-1, 8)
        counts = np.bitwise_count(taken)
        before = np.cumsum(counts, axis=1, dtype=np.int64) - counts
        byte = (before <= left[:, None]).sum(axis=1) - 1
        rows = np.arange(len(at))
        place = word * 64 + byte * 8 + _SELECT[taken[rows, byte], left - before[rows, byte]]
        return (place - at).astype(np.uint64) << np.uint64(self.width) | self._low(at)


class Level:
    """Words seen after each context, in order, with a one-byte code each.

    Monotone pointers bound a context's range of places.  A range holds the local numbers of
    its words above the last element of the range before it, so that the whole level is one
    rising sequence over a small universe; a word is the successor of its number, counted
    from where its context begins.
    """

    def __init__(self, contexts: int, owner: np.ndarray, words: np.ndarray, codes: np.ndarray):
        """Pairs (owner, word) sorted and distinct, owners below ``contexts``, each with its code."""
        known = np.unique(words)
        self.words = EliasFano(known)
        local = np.searchsorted(known, words)
        sizes = np.bincount(owner, minlength=contexts)
        pointers = np.r_[0, np.cumsum(sizes)]
        self.pointers = EliasFano(pointers)
        tops = np.zeros(contexts, np.int64)
        used = np.flatnonzero(sizes)
        tops[used] = local[pointers[used + 1] - 1] + 1
        self.elements = EliasFano((np.cumsum(tops) - tops)[owner] + local)
        self.codes = mapped(codes)

    def ranges(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place behind each context's range, and what its elements are counted from."""
        start, end = self.pointers.access(owner).astype(np.int64), self.pointers.access(owner + 1).astype(np.int64)
        base = np.zeros(len(owner), np.int64)
        later = np.flatnonzero(start)
        base[later] = self.elements.access(start[later] - 1).astype(np.int64) + 1
        return end, base

    def find(self, owner: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each word after its context; -1 where it was not seen or the context is -1.

        Neighbours with the same context share the look-up of its range, equal words that of
        their number.
        """
        places = np.full(len(words), -1, np.int64)
        kind, kinds = pd.factorize(words)
        local, known = (x[kind] for x in self.words.successor(kinds))
        own = np.flatnonzero(known & (owner >= 0))
        if not len(own):
            return places
        context = owner[own]
        first = np.r_[True, context[1:] != context[:-1]]
        end, base = (x[np.cumsum(first) - 1] for x in self.ranges(context[first]))
        at, equal = self.elements.successor((base + local[own]).astype(np.uint64))
        hit = equal & (at < end)
        places[own[hit]] = at[hit]
        return places

    def code(self, places: np.ndarray) -> np.ndarray:
        """The codes at these places, 0 for -1."""
        found = np.zeros(len(places), np.uint8)
        there = places >= 0
        found[there] = self.codes[places[there]]
        return found


class Trie:
    """Contexts of one word, the words seen after each, and the words seen after such pairs.

    The contexts of the third level are the places of the second.
    """

    def __init__(self, contexts: np.ndarray, pairs: Level, triples: Level):
        """``contexts`` sorted and distinct."""
        self.contexts = EliasFano(contexts)
        self.pairs, self.triples = pairs, triples

    def context(self, words: np.ndarray) -> np.ndarray:
        """The number of each word as a context, -1 if it is none."""
        at, equal = self.contexts.successor(words)
        return np.where(equal, at, -1)
