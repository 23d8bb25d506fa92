"""A run-length compressed FM-index over integer sequences, with vectorised backward search.

The BWT is kept as runs: where each starts, a wavelet matrix of packed bits over the runs' symbols, and the lengths summed up
in the order of symbols. A rank is the full runs of the symbol before, from the wavelet matrix and the sums, and the part of
the run at hand. Shards hold passages that repeat in several contexts, so runs are fewer than symbols."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector packed in 64-bit words with a running count for each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.zeros(len(ones) + 1, np.int32)
        np.cumsum(ones, out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next `depth` symbols at least (prefix doubling); the end sorts first."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step, order = 1, None
    while True:
        key = (rank + 1) << 32
        key[: n - step] |= rank[step:] + 1 if step < n else 0
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64))))
        rank, step = new, 2 * step
        if step >= depth or rank.max(initial=-1) == n - 1:
            return order


class FmIndex:
    """Index of symbols 0 .. sigma - 1, exact for patterns of up to `depth` symbols."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.n = len(text)
        order = suffix_order(text, depth + 1)
        bwt = text[order - 1]  # the text is taken as a circle; patterns never hold its last symbol, a separator
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.first = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1]))) if self.n else np.empty(0, np.int64)
        self.symbol = bwt[self.first].astype(np.int32)
        length = np.diff(np.append(self.first, self.n))
        by = np.argsort(self.symbol, kind="stable")
        #: lengths of runs summed up symbol by symbol, and the number of runs of smaller symbols
        self.sums = np.concatenate(([0], np.cumsum(length[by])))
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(self.symbol, minlength=sigma))))
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        self.depth = max(1, int(sigma - 1).bit_length())
        runs = self.symbol
        for level in range(self.depth - 1, -1, -1):
            bits = (runs >> level) & 1
            self.levels.append(Bits(bits))
            self.zeros.append(len(runs) - self.levels[-1].ones)
            runs = np.concatenate((runs[bits == 0], runs[bits == 1]))
        symbols = np.arange(sigma)
        self.shift = -self._down(symbols, np.zeros(sigma, np.int64))

    @property
    def runs(self) -> int:
        return len(self.symbol)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` rows of the BWT have the symbol."""
        run = np.maximum(np.searchsorted(self.first, at, side="right") - 1, 0)
        before = self.smaller[symbol]
        full = before + self.shift[symbol] + self._down(symbol, run)
        return self.sums[full] - self.sums[before] + np.where(self.symbol[run] == symbol, at - self.first[run], 0)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of patterns with a symbol put before each."""
        start = self.starts[symbol]
        return start + self.rank(symbol, low), start + self.rank(symbol, high)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int, least: int = 2) -> np.ndarray:
        """For each end (exclusive) in a streamed text: how long the longest stretch that stops there and is in the
        index `least` times or more is, counted up to `most`. Backward search of all ends at a time; an end is done
        when its row range gets too small. Symbols must be ones that the index knows."""
        out = np.zeros(len(ends), np.int64)
        alive = np.flatnonzero(ends > 0)
        last = text[ends[alive] - 1]
        low, high = self.starts[last], self.starts[last + 1]
        for k in range(1, most + 1):
            more = high - low >= least
            alive, low, high = alive[more], low[more], high[more]
            out[alive] = k
            more = ends[alive] > k
            alive, low, high = alive[more], low[more], high[more]
            if k == most or not len(alive):
                break
            low, high = self.step(text[ends[alive] - 1 - k], low, high)
        return out
