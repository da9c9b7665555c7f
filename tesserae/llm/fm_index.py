"""A compressed full-text index over sequences of numbers, searched backward for many patterns at once.

The Burrows-Wheeler transform of the sequences is kept as a wavelet matrix: one packed bit vector with rank counts for
each bit of a symbol. Backward search turns the interval of suffixes that begin with w into that of those that begin
with c + w by two ranks. Where no suffix does, the interval is widened to its parent in the suffix tree, by the lengths
that neighbouring suffixes share, so that every step ends with the longest match; matches longer than `cap` are held
at `cap`. All patterns take a step together, as numpy arrays.

Sequences end in marks of their own that match nothing, so that no match spans two of them. Empty sequences are
allowed; an index of none matches nothing.
"""

from __future__ import annotations

import numpy as np

#: Bits in a word of a packed vector.
WORD = 64


class Bits:
    """A packed bit vector with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // WORD) * WORD, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for level in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = symbols >> level & 1
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before each lo and each hi."""
        start = np.zeros_like(lo)
        for level, bits, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            start, lo, hi = (np.where(one, zeros + r, x - r) for x, r in ((x, bits.rank(x)) for x in (start, lo, hi)))
        return lo - start, hi - start


def suffix_order(text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the length that each shares with the one before it, by doubling; no shared part is over longest."""
    n = len(text)
    rank, h, ranks = text.astype(np.int64), 1, [text.astype(np.int32)]
    order = np.argsort(rank, kind="stable")
    while h <= longest and n:
        second = np.zeros(n, np.int64)
        second[:-h] = rank[h:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        ranks.append(rank.astype(np.int32))
        h *= 2
        if fresh[-1] == n - 1:
            break
    shared = np.zeros(n, np.int32)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in reversed(range(len(ranks))):
        live = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[live] = ranks[k][a[live]] == ranks[k][b[live]]
        shared[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, shared


class FmIndex:
    """The index of sequences: `symbols` end to end, `lengths` of each; matches are held at `cap`."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, cap: int):
        self.cap, m = cap, len(lengths)
        self.known = np.unique(symbols)
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(len(symbols) + m, np.int64)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[ends] = np.arange(m)
        text[inner] = m + np.searchsorted(self.known, symbols)
        self.order, self.shared = suffix_order(text, int(lengths.max(initial=0)))
        plain = np.where(inner, np.where(inner, text - m + 1, 0), 0)
        self.wavelets = WaveletMatrix(plain[self.order - 1], len(self.known) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(plain, minlength=len(self.known) + 1))])
        #: Suffixes with the same first `cap` symbols make a class; classes are runs of the order.
        begins = np.flatnonzero(np.concatenate([[True], self.shared[1:] < cap])) if len(text) else np.zeros(0, np.int64)
        self.bounds = np.append(begins, len(text))
        self.least = [self.shared]
        while 1 << len(self.least) <= len(text):
            low, step = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(low[:-step], low[step:]))

    def classes(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def least_by_class(self, value: np.ndarray) -> np.ndarray:
        """The least value (given for each place of the sequences end to end, their marks included) of each class."""
        return np.minimum.reduceat(value[self.order], self.bounds[:-1]) if len(self.order) else value[:0]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest wider interval of suffixes that share a shorter beginning, and that beginning's length."""
        n = len(self.order)
        left, right = self.shared[lo], np.where(hi < n, self.shared[np.minimum(hi, n - 1)], 0)
        length = np.maximum(left, right)
        lo, hi = lo.copy(), hi.copy()
        for k in reversed(range(len(self.least))):  # over as many neighbours as share that much, by powers of two
            low, size = self.least[k], 1 << k
            ok = lo - size + 1 >= 0
            ok[ok] = low[lo[ok] - size + 1] >= length[ok]
            lo[ok] -= size
            ok = hi + size <= n
            ok[ok] = low[hi[ok]] >= length[ok]
            hi[ok] += size
        whole = length == 0
        lo[whole], hi[whole] = 0, n
        return lo, hi, length

    def matches(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the patterns end to end: the length of the longest match that begins there (held at cap), and the least suffix with it."""
        n, ends = len(self.order), np.cumsum(lengths)
        place = np.searchsorted(self.known, symbols)
        code = np.where(self.known[np.minimum(place, max(0, len(self.known) - 1))] == symbols, place + 1, 0) if len(self.known) else np.zeros(len(symbols), np.int64)
        size, least = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int64)
        lo, hi, length = np.zeros(len(lengths), np.int64), np.full(len(lengths), n, np.int64), np.zeros(len(lengths), np.int32)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > step)
            at = ends[live] - 1 - step
            c = code[at]
            unknown = live[c == 0]
            lo[unknown], hi[unknown], length[unknown] = 0, n, 0
            todo, sought = live[c > 0], c[c > 0]
            while len(todo):
                a, b = self.wavelets.ranks(sought, lo[todo], hi[todo])
                found = b > a
                done = todo[found]
                lo[done], hi[done] = self.first[sought[found]] + a[found], self.first[sought[found]] + b[found]
                length[done] += 1
                todo, sought = todo[~found], sought[~found]
                if len(todo):  # known symbols match at length 1 at the latest
                    lo[todo], hi[todo], length[todo] = self.parent(lo[todo], hi[todo])
            over = live[length[live] >= self.cap]
            if len(over):  # held at cap: all suffixes with these first symbols
                of = self.classes(lo[over])
                lo[over], hi[over], length[over] = self.bounds[of], self.bounds[of + 1], self.cap
            size[at], least[at] = length[live], lo[live]
        return size, least
