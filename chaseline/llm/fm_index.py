"""A compressed FM-index over word codes: a bit-packed wavelet matrix of the Burrows-Wheeler transform.

Texts are short pieces that end with code 0; every helper works on arrays of queries at
once, so that a step of many searches is a handful of NumPy calls.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """A wavelet matrix: a level of packed bits, with a count every 64, for each bit of the largest symbol."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.depth = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        row = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = (row >> level) & 1 == 1
            packed = np.zeros((self.n >> 6) * 8 + 8, dtype=np.uint8)
            some = np.packbits(bits, bitorder="little")
            packed[: len(some)] = some
            words = packed.view(np.uint64)
            counts = np.zeros(len(words), dtype=np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(self.n - int(bits.sum()))
            row = np.concatenate([row[~bits], row[bits]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` lands after following its symbol through all levels; less the same for 0, the rank of the symbol."""
        for k in range(self.depth):
            ones = self._ones(k, at)
            at = np.where((symbols >> (self.depth - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest symbol in each of the non-empty ranges [lo, hi)."""
        found = np.zeros(len(lo), dtype=np.int64)
        for k in range(self.depth):
            a, b = self._ones(k, lo), self._ones(k, hi)
            left = (hi - b) > (lo - a)
            found = (found << 1) | ~left
            lo, hi = np.where(left, lo - a, self.zeros[k] + a), np.where(left, hi - b, self.zeros[k] + b)
        return found


def suffix_order(codes: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes up to the next 0; ``rest`` is how many codes stand before it, itself included.

    Prefix doubling that sorts again only what is still tied before its end.
    """
    n, bits = len(codes), max(1, int(codes.max(initial=0)).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        key <<= bits
        key[: n - k] |= codes[k:]
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, dtype=np.int64)
    slots, sorted_keys = np.arange(n), key[order]
    while True:
        new = np.ones(len(slots), dtype=bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        group = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        rank[order[slots]] = group
        tied = np.zeros(len(slots), dtype=bool)
        tied[1:] = ~new[1:]
        tied[:-1] |= ~new[1:]
        tied &= rest[order[slots]] >= depth
        slots = slots[tied]
        if not len(slots):
            return order
        at = order[slots]
        sorted_keys = (rank[at] << 31) | rank[np.minimum(at + depth, n)]
        again = np.argsort(sorted_keys, kind="stable")
        order[slots], sorted_keys = at[again], sorted_keys[again]
        depth *= 2


class FmIndex:
    """Backward search over pieces of codes of at least 1, each with an owner; an owner is a small number that bears an order."""

    def __init__(self, codes: np.ndarray, rest: np.ndarray, owners: np.ndarray):
        """``codes``: all pieces, each with a 0 behind it; ``rest`` as in ``suffix_order``; ``owners``: of each position."""
        order = suffix_order(codes, rest)
        self.codes, self.n = codes, len(codes)
        self.transform = Wavelet(codes[order - 1])
        self.row_owner = owners[order]
        self.owners = Wavelet(self.row_owner)
        counts = np.bincount(codes)
        symbols = np.arange(len(counts))
        self.shift = np.cumsum(counts) - counts - self.transform.walk(symbols, np.zeros(len(counts), dtype=np.int64))

    def prepend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns with ``symbols`` before them."""
        both = np.concatenate([symbols, symbols])
        at = self.transform.walk(both, np.concatenate([lo, hi])) + self.shift[both]
        return at[: len(lo)], at[len(lo) :]

    def reach(self, ends: np.ndarray, floors: np.ndarray, below: np.ndarray, least: int) -> np.ndarray:
        """Matching statistics: the leftmost start, not before ``floors``, from which the codes up to ``ends`` stand in a piece of an owner under ``below``.

        Starts that leave fewer than ``least`` codes may lie too far left: they are looked at only while one occurrence is left.
        """
        starts = ends + 1
        lo, hi, size = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64), np.zeros(len(ends), dtype=np.int64)
        live = np.arange(len(ends))
        while len(live):
            at = starts[live] - 1
            a, b = self.prepend(self.codes[at], lo[live], hi[live])
            held = b > a
            one = held & (b - a == 1)
            held[one] = self.row_owner[a[one]] < below[live[one]]
            check = held & (ends[live] - at + 1 >= least) & (b - a > 1) & (b - a != size[live])  # as many as before are the same
            held[check] = self.owners.smallest(a[check], b[check]) < below[live[check]]
            lo[live], hi[live], size[live] = a, b, np.where(check, b - a, size[live])
            live, at = live[held], at[held]
            starts[live] = at
            live = live[at > floors[live]]
        return starts
