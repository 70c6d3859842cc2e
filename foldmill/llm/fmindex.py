"""An FM-index over word numbers: suffix order, Burrows-Wheeler transform and a wavelet matrix with packed bits.

All searches of a batch step backward together. Suffixes are ordered by their
first ``depth`` words, which gives exact intervals for patterns of up to that length.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """A bit vector, 64 to a word, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view(U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int64)
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        word = at >> 6
        low = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        self.width = max(1, int(size - 1).bit_length())
        for shift in range(self.width - 1, -1, -1):
            bits = (symbols >> shift) & 1 == 1
            self.levels.append(Bits(bits))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.first = self.place(np.arange(size), np.zeros(size, np.int64))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = level.ones(at)
            at = np.where((symbol >> (self.width - 1 - k)) & 1 == 1, level.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self.place(symbol, at) - self.first[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text ordered by the words from there on, up to depth of them (the next power of two)."""
    rank, n, step = text.astype(np.int64), len(text), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        nxt = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])
        key = rank * (int(max(rank.max(), nxt.max())) + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, 2 * step
    return order


class FMIndex:
    """Of numbers 0 (a border that no pattern crosses) to size-1."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        self.text = text
        self.order = suffix_order(text, depth)
        self.wavelet = WaveletMatrix(text[self.order - 1], size)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    def search(self, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For patterns text[start : start + length], the intervals of the suffix order that begin with them."""
        last = self.text[start + length - 1]
        low, high = self.less[last], self.less[last + 1]
        for k in range(length - 2, -1, -1):
            symbol = self.text[start + k]
            low = self.less[symbol] + self.wavelet.rank(symbol, low)
            high = self.less[symbol] + self.wavelet.rank(symbol, high)
        return low, high


def least_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for intervals that are equal or apart."""
    first, at = np.unique(low, return_inverse=True)
    last = np.zeros(len(first), np.int64)
    last[at] = high
    ends = np.column_stack([first, last]).ravel()
    return np.minimum.reduceat(np.append(values, values[-1:]), ends)[::2][at]
