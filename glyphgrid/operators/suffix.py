"""Suffix order and what follows from it: arrays, BWT, runs, rank and select, LF and psi, LCP, intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import bwt_of, chars, code_points, lcp_intervals, lcp_of, per_text, run_count, suffix_array
from .wavelet import Wavelet


def suffix_table(texts: DataFrame) -> DataFrame:
    """doc_id, row, pos (both from 0; row 0 is the empty suffix), ch (the BWT; empty for the end mark)."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        order = suffix_array(cp)
        return {"row": range(len(order)), "pos": order, "ch": chars(bwt_of(cp, order))}

    return per_text(texts, "doc_id long, row long, pos long, ch string", kernel)


def middle_rows(texts: DataFrame) -> DataFrame:
    """doc_id, row, pos, ch, n: the suffix table's rows in the second and third quarter of each text's n rows. They are cut
    out where the text is: neither the others nor a table of n move."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        order = suffix_array(cp)
        n = len(order)
        part = slice(n // 4, 3 * n // 4)
        return {"row": np.arange(n)[part], "pos": order[part], "ch": chars(bwt_of(cp, order)[part]), "n": np.full(n, n)[part]}

    return per_text(texts, "doc_id long, row long, pos long, ch string, n long", kernel)


def lcp_array(texts: DataFrame) -> DataFrame:
    def kernel(text: str) -> dict:
        cp = code_points(text)
        order = suffix_array(cp)
        return {"row": range(len(order)), "lcp": lcp_of(cp, order)}

    return per_text(texts, "doc_id long, row long, lcp long", kernel)


def plcp_array(texts: DataFrame) -> DataFrame:
    """doc_id, pos, plcp: the LCP values in the order of positions."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        order = suffix_array(cp)
        out = np.empty(len(order), np.int64)
        out[order] = lcp_of(cp, order)
        return {"pos": range(len(order)), "plcp": out}

    return per_text(texts, "doc_id long, pos long, plcp long", kernel)


def sampled_suffix_array(table: DataFrame, every: int) -> DataFrame:
    """Every n-th row of the suffix array."""
    return table.where(F.pmod("row", F.lit(every)) == 0).select("doc_id", "row", "pos")


def suffix_tree(texts: DataFrame) -> DataFrame:
    """doc_id, node, depth (characters from the root), lo, hi (rows), parent: inner nodes of each text's suffix tree.
    Leaves are rows; children of a node are the nodes with it as parent, the lowest common ancestor of two rows is the
    deepest node that holds both."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        nodes = lcp_intervals(lcp_of(cp, suffix_array(cp)))
        depth, lo, hi, parent = zip(*nodes, strict=True)
        return {"node": range(len(nodes)), "depth": depth, "lo": lo, "hi": hi, "parent": parent}

    return per_text(texts, "doc_id long, node long, depth long, lo long, hi long, parent long", kernel)


def suffix_links(texts: DataFrame) -> DataFrame:
    """doc_id, lo, hi, link_lo, link_hi: rows of each inner node but the root, and of the node of its string without the
    first character. One leaf, moved on by a position, is in that node, whose depth is one less."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        order = suffix_array(cp)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        depth, lo, hi, _ = (np.array(x) for x in zip(*lcp_intervals(lcp_of(cp, order)), strict=True))
        by = np.lexsort((lo, depth))
        key = depth[by] * len(order) + lo[by]
        some = np.flatnonzero(depth > 0)
        row = rank[order[lo[some]] + 1]
        to = by[np.searchsorted(key, (depth[some] - 1) * len(order) + row, side="right") - 1]
        return {"lo": lo[some], "hi": hi[some], "link_lo": lo[to], "link_hi": hi[to]}

    return per_text(texts, "doc_id long, lo long, hi long, link_lo long, link_hi long", kernel)


def leaf_parents(texts: DataFrame) -> DataFrame:
    """doc_id, row, parent_depth, place: the deepest inner node around each leaf, and how many leaves of it come before."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        nodes = lcp_intervals(lcp_of(cp, suffix_array(cp)))
        parent = np.zeros(len(cp) + 1, np.int64)
        for i in sorted(range(len(nodes)), key=lambda i: nodes[i][0]):  # deeper ones later
            parent[nodes[i][1] : nodes[i][2] + 1] = i
        depth, lo, _, _ = (np.array(x) for x in zip(*nodes, strict=True))
        return {"row": range(len(parent)), "parent_depth": depth[parent], "place": np.arange(len(parent)) - lo[parent]}

    return per_text(texts, "doc_id long, row long, parent_depth long, place long", kernel)


def lowest_common_ancestors(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, a, b: rows) with depth: the length of the longest common prefix of the two suffixes."""
    holds = (F.col("lo") <= F.least("a", "b")) & (F.col("hi") >= F.greatest("a", "b"))
    return pairs.join(tree, "doc_id").where(holds).groupBy("doc_id", "a", "b").agg(F.max("depth").alias("depth"))


def longest_repeats(texts: DataFrame) -> DataFrame:
    """doc_id, len of the longest substring found twice."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        return {"len": [int(lcp_of(cp, suffix_array(cp)).max(initial=0))]}

    return per_text(texts, "doc_id long, len long", kernel)


def bwt_run_counts(texts: DataFrame) -> DataFrame:
    def kernel(text: str) -> dict:
        cp = code_points(text)
        return {"r": [run_count(bwt_of(cp, suffix_array(cp)))]}

    return per_text(texts, "doc_id long, r long", kernel)


def bwt_runs(texts: DataFrame) -> DataFrame:
    """doc_id, run_id, start, len, ch: found where the text is, so that no symbol moves."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        bwt = bwt_of(cp, suffix_array(cp))
        head = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        return {"run_id": range(len(head)), "start": head, "len": np.diff(np.append(head, len(bwt))), "ch": chars(bwt[head])}

    return per_text(texts, "doc_id long, run_id long, start long, len long, ch string", kernel)


def lf_of(bwt: np.ndarray) -> np.ndarray:
    """The row of each suffix made longer by the symbol before it: a stable sort of the BWT, turned round."""
    out = np.empty(len(bwt), np.int64)
    out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    return out


def lf_mapping(texts: DataFrame) -> DataFrame:
    """doc_id, row, lf."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        lf = lf_of(bwt_of(cp, suffix_array(cp)))
        return {"row": range(len(lf)), "lf": lf}

    return per_text(texts, "doc_id long, row long, lf long", kernel)


def psi_mapping(texts: DataFrame) -> DataFrame:
    """The inverse of lf_mapping: doc_id, row, psi."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        psi = np.argsort(bwt_of(cp, suffix_array(cp)), kind="stable")
        return {"row": range(len(psi)), "psi": psi}

    return per_text(texts, "doc_id long, row long, psi long", kernel)


def bwt_texts(texts: DataFrame) -> DataFrame:
    """doc_id, bwt as one string for each text, NUL for the end mark."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        return {"bwt": ["".join(chr(max(c, 0)) for c in bwt_of(cp, suffix_array(cp)).tolist())]}

    return per_text(texts, "doc_id long, bwt string", kernel)


def inverse_bwt(bwts: DataFrame) -> DataFrame:
    """doc_id, text read back from doc_id, bwt (see bwt_texts) alone: positions are ranks of jumps, found by doubling."""

    def kernel(bwt: str) -> dict:
        symbols = np.where(code_points(bwt) == 0, -1, code_points(bwt).astype(np.int64))
        n = len(symbols) - 1
        lf, at, filled = lf_of(symbols), np.zeros(n + 1, np.int64), 1
        while filled <= n:  # at[k]: the row after k steps from row 0
            more = min(filled, n + 1 - filled)
            at[filled : filled + more] = lf[at[:more]]
            lf, filled = lf[lf], 2 * filled
        back = symbols[at[:n]][::-1]
        return {"text": [back.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")]}

    return per_text(bwts, "doc_id long, text string", kernel, text="bwt")


def inverse_select(texts: DataFrame, every: int, first: int) -> DataFrame:
    """doc_id, row, ch, rank: of the rows first, first + every, ... of the BWT the symbol and how many rows before have it."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        bwt = bwt_of(cp, suffix_array(cp))
        alphabet, value = np.unique(bwt, return_inverse=True)
        rows = np.arange(first, len(bwt), every)
        found, rank = Wavelet(value, len(alphabet)).inverse_select(rows)
        return {"row": rows, "ch": chars(alphabet[found]), "rank": rank}

    return per_text(texts, "doc_id long, row long, ch string, rank long", kernel)


def backward_search(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """doc_id, pattern, lo, hi: the same rows as lex_intervals, found from the BWT alone, last character first; all
    patterns of a text step together."""

    def kernel(text: str) -> dict:
        cp = code_points(text)
        bwt = bwt_of(cp, suffix_array(cp))
        alphabet, first = np.unique(np.sort(bwt), return_index=True)
        order = np.argsort(bwt, kind="stable")
        keys = np.searchsorted(alphabet, bwt[order]) * len(bwt) + order
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(bwt))
        raw = [code_points(p).astype(np.int64) for p in patterns]
        for k in range(1, max(map(len, raw), default=0) + 1):
            some = np.flatnonzero((np.array(list(map(len, raw))) >= k) & (low < high))
            symbol = np.array([raw[i][-k] for i in some], np.int64)
            at = np.minimum(np.searchsorted(alphabet, symbol), len(alphabet) - 1)
            step = lambda rows: np.searchsorted(keys, at * len(bwt) + rows)  # noqa: B023, E731
            known = alphabet[at] == symbol
            low[some], high[some] = np.where(known, step(low[some]), 0), np.where(known, step(high[some]), 0)
        hit = np.flatnonzero(low < high)
        return {"pattern": [patterns[i] for i in hit], "lo": low[hit], "hi": high[hit] - 1}

    return per_text(texts, "doc_id long, pattern string, lo long, hi long", kernel)


def csa_counts(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """pattern, occ over all texts by backward search in each; patterns without one have 0."""
    found = backward_search(texts, patterns).groupBy("pattern").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("occ"))
    wanted = texts.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    return wanted.join(found, "pattern", "left").select("pattern", F.coalesce("occ", F.lit(0)).alias("occ"))


class RowsOf:
    """Rows of the BWT by symbol, in order: rank and select are look-ups."""

    def __init__(self, text: str):
        cp = code_points(text)
        bwt = bwt_of(cp, suffix_array(cp))
        self.n, self.order = len(bwt), np.argsort(bwt, kind="stable")
        self.keys = (bwt[self.order] + 1) * self.n + self.order

    def before(self, ch: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, (ch + 1) * self.n + at)

    def rank(self, ch: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows before `at` with ch."""
        return self.before(ch, np.clip(at, 0, self.n)) - self.before(ch, np.zeros_like(at))

    def select(self, ch: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th row (from 1) with ch; -1 without one."""
        first, end = self.before(ch, np.zeros_like(k)), self.before(ch, np.full_like(k, self.n))
        return np.where((k > 0) & (first + k <= end), self.order[np.clip(first + k - 1, 0, self.n - 1)], -1)


def asked_of(texts: DataFrame, queries: DataFrame, number: str, result: str, look: Callable[[RowsOf, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """queries (doc_id, number, ch) with result: a text meets its own queries in one row, and no symbol moves."""
    joined = texts.join(queries.groupBy("doc_id").agg(F.collect_list(F.struct(number, "ch")).alias("asked")), "doc_id").select("doc_id", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = batch["asked"][i].as_py()
                numbers = np.array([q[number] for q in own], np.int64)
                found = look(RowsOf(batch["text"][i].as_py() or ""), np.array([ord(q["ch"]) if q["ch"] else -1 for q in own], np.int64), numbers)
                cells = ([batch["doc_id"][i].as_py()] * len(own), numbers, [q["ch"] for q in own], found)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["doc_id", number, "ch", result])

    return joined.mapInArrow(run, f"doc_id long, {number} long, ch string, {result} long")


def rank(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (doc_id, at, ch) with rank: BWT rows before `at` with ch (an empty ch is the end mark)."""
    return asked_of(texts, queries, "at", "rank", RowsOf.rank)


def select(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (doc_id, k, ch) with row: the k-th BWT row (from 1) with ch; queries without one give no row."""
    return asked_of(texts, queries, "k", "row", RowsOf.select).where("row >= 0")


def lex_intervals(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """doc_id, pattern, lo, hi: rows of the suffixes that start with the pattern, by binary search in each text."""

    def kernel(text: str) -> dict:
        order = suffix_array(code_points(text)).tolist()

        def first(p: str, after: bool) -> int:
            low, high = 0, len(order)
            while low < high:
                mid = (low + high) // 2
                own = text[order[mid] : order[mid] + len(p)]
                if own < p or after and own == p:
                    low = mid + 1
                else:
                    high = mid
            return low

        found = [(p, first(p, False), first(p, True) - 1) for p in patterns if p in text]
        return {"pattern": [p for p, _, _ in found], "lo": [a for _, a, _ in found], "hi": [b for _, _, b in found]}

    return per_text(texts, "doc_id long, pattern string, lo long, hi long", kernel)
