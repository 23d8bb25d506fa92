"""Backward search over factor blocks: how patterns meet block borders, and the index of a shard of texts.

An occurrence of a pattern either crosses no block border, or its first border is at one of 1 .. block size characters.
From a border on, the others follow from the pattern alone: the next one is a block size further, or where a suffix of
type S follows one of type L. Only the run of equal characters that ends the pattern has a type that the text decides, so
both are taken, and border sets that come out alike are one. A set of borders cuts the pattern in a first piece, the end
of a block; whole blocks; and a last piece, the start of a block. Two sets can't match at one place, so counts add up.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

from .kernels import block_starts, bwt_of, code_points, suffix_array
from .wavelet import Wavelet


def pattern_types(cp: np.ndarray, last_s: bool) -> np.ndarray:
    """True where a pattern's suffix is of type S, if the run that ends it is (or is not)."""
    out = np.full(len(cp), last_s)
    for i in range(len(cp) - 2, -1, -1):
        out[i] = cp[i] < cp[i + 1] or cp[i] == cp[i + 1] and out[i + 1]
    return out


def factor_starts(cp: np.ndarray, last_s: bool) -> list[int]:
    """Where factors start inside a pattern (its own start, which the text decides, left out)."""
    s = pattern_types(cp, last_s)
    return (np.flatnonzero(s[1:] & ~s[:-1]) + 1).tolist()


def border_sets(pattern: str, lam: int) -> list[tuple[int, ...]]:
    """All sets of block borders inside an occurrence of the pattern, but the empty one."""
    cp, n = code_points(pattern), len(pattern)
    found = set()
    for last_s in (False, True):
        starts = factor_starts(cp, last_s)
        for first in range(1, min(lam, n - 1, starts[0] if starts else n) + 1):
            borders = [first]
            while True:
                k = bisect.bisect_right(starts, borders[-1])
                after = min(borders[-1] + lam, starts[k] if k < len(starts) else n)
                if after >= n:
                    break
                borders.append(after)
            found.add(tuple(borders))
    return sorted(found)


def pieces(pattern: str, borders: tuple[int, ...]) -> list[str]:
    return [pattern[a:b] for a, b in zip((0, *borders), (*borders, len(pattern)), strict=True)]


class Shard:
    """Texts as one sequence of block ids (their ranks from 1; 0 ends each text): dictionary, order of the reversed blocks,
    bucket offsets and the runs of the BWT."""

    def __init__(self, factors: list[str], symbols: np.ndarray, lengths: np.ndarray, colex: np.ndarray):
        self.factors, self.symbols, self.lengths, self.colex = factors, symbols, lengths, colex

    @classmethod
    def build(cls, texts: list[str], lam: int) -> Shard:
        blocks: list[str] = []
        for text in texts:
            starts = block_starts(code_points(text), lam).tolist()
            blocks += [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=False)]
            blocks.append("")
        factors = sorted(set(blocks) - {""})
        number = {f: i + 1 for i, f in enumerate(factors)} | {"": 0}
        ids = np.fromiter((number[b] for b in blocks), np.int64, len(blocks))
        bwt = np.maximum(bwt_of(ids, suffix_array(ids)), 0)
        head = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        colex = np.zeros(len(factors) + 1, np.int64)
        for rank, i in enumerate(sorted(range(len(factors)), key=lambda i: factors[i][::-1])):
            colex[i + 1] = rank + 1
        return cls(factors, bwt[head], np.diff(np.append(head, len(bwt))), colex)

    def texts(self) -> Iterator[str]:
        """The texts, read back from the BWT by LF steps: each from its end mark to the end mark before it (the row of the
        whole sequence has one too). The rows of suffixes that start with an end mark follow that of the empty suffix."""
        bwt = np.repeat(self.symbols, self.lengths)
        lf = np.empty(len(bwt), np.int64)
        lf[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
        ends, symbols, step = int((bwt == 0).sum()), bwt.tolist(), lf.tolist()
        for row in range(1, ends):
            own = []
            while symbol := symbols[row]:
                own.append(self.factors[symbol - 1])
                row = step[row]
            yield "".join(reversed(own))

    def opened(self) -> Shard:
        """Makes the tables that searches need."""
        bwt = np.repeat(self.symbols, self.lengths)
        count = np.bincount(bwt, minlength=len(self.factors) + 1)
        self.freq = count[1:]
        self.base = np.concatenate(([0], np.cumsum(count)))
        #: rows of the suffixes that start with each id: one row more than ids before, for the empty suffix
        self.starts = self.base.copy()
        self.n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        self.keys = bwt[order] * self.n + order
        self.wavelet = Wavelet(self.colex[bwt], len(self.factors) + 1)
        self.number = {f: i + 1 for i, f in enumerate(self.factors)}
        self.reversed = sorted(f[::-1] for f in self.factors)
        return self

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` rows of the BWT have the symbol."""
        return np.searchsorted(self.keys, symbol * self.n + at) - self.base[symbol]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges with a block put before each."""
        return self.starts[symbol] + self.rank(symbol, low), self.starts[symbol] + self.rank(symbol, high)

    @staticmethod
    def prefixed(words: list[str], piece: str) -> tuple[int, int]:
        """Ids of the words that start with the piece, from and below."""
        n = len(piece)
        return bisect.bisect_left(words, piece) + 1, bisect.bisect_right(words, piece, key=lambda w: w[:n]) + 1

    def count(self, entries: list[tuple[int, list[str]]], short: list[tuple[int, str]], patterns: int) -> np.ndarray:
        """Occurrences of each pattern: entries are (pattern, pieces) for border sets, short ones (pattern, string) may be
        inside a block."""
        out = np.zeros(patterns, np.int64)
        ends: dict[str, tuple[int, int]] = {}
        heads: dict[str, tuple[int, int]] = {}
        by_size: dict[int, list[tuple]] = defaultdict(list)
        for pattern, parts in entries:
            middle = [self.number.get(p, 0) for p in parts[-2:0:-1]]
            if not all(middle):
                continue
            first, last = parts[0], parts[-1]
            if first not in ends:
                ends[first] = self.prefixed(self.reversed, first[::-1])
            if last not in heads:
                heads[last] = self.prefixed(self.factors, last)
            if ends[first][0] < ends[first][1] and heads[last][0] < heads[last][1]:
                by_size[len(middle)].append((pattern, *ends[first], *heads[last], *middle))
        for size, rows in by_size.items():
            table = np.array(rows, np.int64)
            low, high = self.starts[table[:, 3]], self.starts[table[:, 4]]
            for k in range(size):
                low, high = self.step(table[:, 5 + k], low, high)
                some = low < high
                table, low, high = table[some], low[some], high[some]
            if len(table):
                np.add.at(out, table[:, 0], self.wavelet.between(low, high, table[:, 1], table[:, 2]))
        self._inside(short, out)
        return out

    def _inside(self, short: list[tuple[int, str]], out: np.ndarray) -> None:
        """Adds occurrences inside one block, ends included, by the windows of all distinct blocks."""
        from .count import matched, window_keys

        cp = code_points("\x00".join(self.factors))
        weight = np.repeat(self.freq, np.fromiter(map(len, self.factors), np.int64, len(self.factors)) + 1)[: len(cp)]
        for size in {len(p) for _, p in short}:
            own = [(i, p) for i, p in short if len(p) == size]
            want = np.stack([code_points(p) for _, p in own])
            key = np.array([window_keys(w, size)[0] for w in want], np.uint64)
            order = np.argsort(key)
            keys, want, numbers = key[order], want[order], np.array([i for i, _ in own])[order]
            have = window_keys(cp, size)
            at = np.searchsorted(keys, have)
            hit = np.flatnonzero(at < len(keys))
            hit = hit[keys[at[hit]] == have[hit]]
            total = np.zeros(len(own), np.int64)
            for w in np.unique(weight[hit]):
                some = hit[weight[hit] == w]
                part = np.zeros(len(own), np.int64)
                matched(cp, have, some, at[some], keys, want, part)
                total += w * part
            np.add.at(out, numbers, total)
