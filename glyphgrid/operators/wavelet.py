"""A wavelet matrix over integers in packed bits; every query takes arrays of arguments at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with running counts."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros(-(-(self.size + 1) // 64) * 64, np.uint8)
        padded[: self.size] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Values from 0 to below `top`, highest bit first; zeros of a level go before its ones in the next."""

    def __init__(self, values: np.ndarray, top: int):
        self.size, self.depth = len(values), max(1, int(max(top - 1, 1)).bit_length())
        self.levels: list[Bits] = []
        for shift in range(self.depth - 1, -1, -1):
            bit = (values >> shift) & 1
            self.levels.append(Bits(bit))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def inverse_select(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each place, and how many places before have it."""
        value, low = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        at = np.asarray(at, np.int64)
        for bits in self.levels:
            one, zeros = bits.get(at), bits.size - bits.ones
            value = 2 * value + one
            at = np.where(one, zeros + bits.rank(at), at - bits.rank(at))
            low = np.where(one, zeros + bits.rank(low), low - bits.rank(low))
        return value, at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        return self.inverse_select(at)[0]

    def below(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the first `at` values are less than `value`."""
        low, high, out = np.zeros(len(at), np.int64), np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        value = np.asarray(value, np.int64)
        for k, bits in enumerate(self.levels):
            one, zeros = (value >> (self.depth - 1 - k)) & 1 == 1, bits.size - bits.ones
            a, b = bits.rank(low), bits.rank(high)
            out += np.where(one, high - low - (b - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return np.where(value >> self.depth > 0, np.asarray(at, np.int64), out)

    def between(self, first: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many of the places first <= i < end hold a value low <= v < high."""
        return self.below(end, high) - self.below(end, low) - self.below(first, high) + self.below(first, low)
