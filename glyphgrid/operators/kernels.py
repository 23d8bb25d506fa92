"""Array kernels over one text at a time (code points as uint32), and the Arrow mapper that applies them.

These are the sequential or sort-based parts that row expressions can't do without a shuffle of every symbol: a text is one
row, so each kernel runs where the row is, and only its results move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ROWS_AT_ONCE = 1 << 18


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def s_types(cp: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S: smaller than the next; the end counts as smaller than any symbol."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    sign = np.full(n, -1, np.int8)
    sign[:-1] = np.sign(cp[1:].astype(np.int64) - cp[:-1].astype(np.int64))
    at = np.where(sign != 0, np.arange(n), n)
    decides = np.minimum.accumulate(at[::-1])[::-1]
    return sign[decides] > 0


def lms_positions(cp: np.ndarray) -> np.ndarray:
    s = s_types(cp)
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def sl_factor_starts(cp: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], lms_positions(cp))).astype(np.int64) if len(cp) else np.zeros(0, np.int64)


def block_starts(cp: np.ndarray, lam: int) -> np.ndarray:
    """Starts of the blocks: each factor is cut from its start into blocks of lam symbols, the last may be short."""
    starts = sl_factor_starts(cp)
    size = np.diff(np.concatenate((starts, [len(cp)])))
    blocks = -(-size // lam)
    inside = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(starts, blocks) + lam * inside


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix positions in order, the empty suffix first (prefix doubling)."""
    n = len(symbols)
    rank = np.zeros(n + 1, np.int64)
    if n:
        rank[:n] = np.unique(symbols, return_inverse=True)[1] + 1
    step = 1
    while True:
        key = rank << 32
        key[: n + 1 - step] |= rank[step:]
        order = np.argsort(key, kind="stable")
        new = np.empty(n + 1, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], (np.diff(key[order]) != 0).astype(np.int64))))
        rank, step = new, 2 * step
        if rank.max() == n or step > n:
            return order


def lcp_of(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in order (0 for the first), all rows at a time:
    ranks at doubling depths tell by halves how far two suffixes agree."""
    n = len(symbols)
    ranks, step = [np.zeros(n + 1, np.int64)], 1
    if n:
        ranks[0][:n] = np.unique(symbols, return_inverse=True)[1] + 1
    while step <= n and ranks[-1].max() < n:
        key = ranks[-1] << 32
        key[: n + 1 - step] |= ranks[-1][step:]
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        step *= 2
    out = np.zeros(n + 1, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for level in range(len(ranks) - 1, -1, -1):
        fits = (a + (1 << level) <= n) & (b + (1 << level) <= n)
        same = np.zeros(len(a), bool)
        same[fits] = ranks[level][a[fits]] == ranks[level][b[fits]]
        out[1:][same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return out


def lcp_intervals(lcp: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Inner nodes of the suffix tree as (string depth, first row, last row, parent's number), parents after their
    children, the root last with itself as parent; from the LCP array by a stack."""
    out: list[list[int]] = []
    stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]  # depth, first row, numbers of finished children

    def finish(depth: int, low: int, high: int, children: list[int]) -> int:
        out.append([depth, low, high, -1])
        for c in children:
            out[c][3] = len(out) - 1
        return len(out) - 1

    n = len(lcp)
    for row in range(1, n + 1):
        depth = int(lcp[row]) if row < n else 0
        low, held = row - 1, []
        while stack[-1][0] > depth:
            top, low, children = stack.pop()
            number = finish(top, low, row - 1, children)
            if stack[-1][0] >= depth:
                stack[-1][2].append(number)
            else:
                held.append(number)
        if stack[-1][0] < depth:
            stack.append((depth, low, held))
    root = finish(0, 0, n - 1, stack[0][2])
    out[root][3] = root
    return [tuple(x) for x in out]


def bwt_of(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbol before each suffix in order; -1 (the end mark) for the whole text."""
    return np.where(order == 0, -1, symbols[order - 1].astype(np.int64)) if len(symbols) else np.array([-1])


def run_count(values: np.ndarray) -> int:
    return int(len(values) > 0) + int((np.diff(values) != 0).sum())


def lz77(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy LZ77 phrases (start, source, length); a symbol that is new has source -1 and length 1. The source is
    found in the suffix array by nearest smaller positions on either side; sources may overlap their phrase."""
    n = len(cp)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    order = suffix_array(cp)
    before, after = np.full(n + 1, -1), np.full(n + 1, -1)
    stack: list[int] = []
    for p in order.tolist():
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        before[p] = stack[-1] if stack else -1
        stack.append(p)
    raw, out, i = cp.tolist(), [], 0

    def match(source: int, at: int) -> int:
        k = 0
        while at + k < n and raw[source + k] == raw[at + k]:
            k += 1
        return k

    while i < n:
        size, source = max(((match(int(s), i), int(s)) for s in (before[i], after[i]) if 0 <= s < i), default=(0, -1))
        out.append((i, source, size) if size else (i, -1, 1))
        i += max(size, 1)
    return tuple(np.array(c) for c in zip(*out, strict=True))


def chars(cp: np.ndarray) -> list[str]:
    """One string for each code point; an empty one for negative values."""
    return [chr(c) if c >= 0 else "" for c in cp.tolist()]


def per_text(texts: DataFrame, schema: str, kernel: Callable[[str], dict], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of kernel(text) (columns of equal length) with the key of their text; null texts count as empty."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kinds)
        names = [f.name for f in out if f.name != key]
        for batch in batches:
            held, owners, rows = {k: [] for k in names}, [], 0
            for own, value in zip(batch[key].to_pylist(), batch[text], strict=True):
                made = kernel(value.as_py() or "")
                size = len(made[names[0]])
                for k in names:
                    held[k].append(pa.array(made[k], type=out.field(k).type))
                owners.append(pa.array([own] * size, type=out.field(key).type))
                rows += size
                if rows >= ROWS_AT_ONCE:
                    yield _joined(out, key, owners, held)
                    held, owners, rows = {k: [] for k in names}, [], 0
            if owners:
                yield _joined(out, key, owners, held)

    return texts.select(key, text).mapInArrow(run, schema)


def _joined(out: pa.Schema, key: str, owners: list, held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(owners if f.name == key else held[f.name]) for f in out], schema=out)
