"""Locally consistent factorisation: suffix types, factors, blocks, dictionaries and the texts over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grammar import factor_starts
from .count import CHARS_AT_ONCE, batch_texts, mixed
from .kernels import block_starts, bwt_of, code_points, lms_positions, per_text, run_count, s_types, sl_factor_starts, suffix_array


def checked(lam: int) -> int:
    if not 1 <= lam <= 8:
        raise ValueError("the block size must be from 1 to 8")
    return lam


def sl_types(texts: DataFrame) -> DataFrame:
    def kernel(text: str) -> dict:
        s = s_types(code_points(text))
        return {"pos": range(len(s)), "kind": np.where(s, "S", "L")}

    return per_text(texts, "doc_id long, pos long, kind string", kernel)


def lms(texts: DataFrame) -> DataFrame:
    return per_text(texts, "doc_id long, pos long", lambda t: {"pos": lms_positions(code_points(t))})


def sl_factors(texts: DataFrame) -> DataFrame:
    def kernel(text: str) -> dict:
        starts = sl_factor_starts(code_points(text))
        return {"sl": np.arange(len(starts)), "start": starts, "len": np.diff(np.concatenate((starts, [len(text)])))[: len(starts)]}

    return per_text(texts, "doc_id long, sl long, start long, len long", kernel)


def factors(texts: DataFrame, lam: int) -> DataFrame:
    """doc_id, ord, start, len, factor of every block."""
    checked(lam)

    def kernel(text: str) -> dict:
        starts = block_starts(code_points(text), lam).tolist()
        ends = [*starts[1:], len(text)]
        return {"ord": range(len(starts)), "start": starts, "len": [b - a for a, b in zip(starts, ends, strict=False)], "factor": [text[a:b] for a, b in zip(starts, ends, strict=False)]}

    return per_text(texts, "doc_id long, ord long, start long, len long, factor string", kernel)


def counted_in_place(texts: DataFrame, lam: int, before: int | None, after: int) -> DataFrame:
    """factor, next, n: the blocks (of longer ones the last `before` characters) with the `after` characters that follow in
    their text, counted for about CHARS_AT_ONCE characters where the texts are. Only counts move."""
    checked(lam)

    def counted(held: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
        text = "".join(t for t, _ in held)
        cp, size = code_points(text), np.array([len(t) for t, _ in held])
        shift = np.cumsum(size) - size
        start = np.concatenate([s + k for (_, s), k in zip(held, shift, strict=True)])
        own_end = np.concatenate([np.full(len(s), k + len(t)) for (t, s), k in zip(held, shift, strict=True)])
        cut = np.append(start[1:], len(text))
        first = start if before is None else np.maximum(start, cut - before)
        last = np.minimum(cut + after, own_end)
        key = mixed((cut - first).astype(np.uint64), (last - first).astype(np.uint64))
        at_most = max(int((last - first).max()), 1)
        for k in range(at_most):
            more = first + k < last
            key[more] = mixed(key[more], cp[first[more] + k].astype(np.uint64) + np.uint64(1))
        number = pa.array(key).dictionary_encode().indices.to_numpy()
        one = np.zeros(int(number.max()) + 1, np.int64)
        one[number[::-1]] = np.arange(len(key))[::-1]
        a, b, c = first[one][number], cut[one][number], last[one][number]
        same = (b - a == cut - first) & (c - a == last - first)
        for k in range(at_most):
            more = np.flatnonzero(same & (first + k < last))
            same[more] = cp[first[more] + k] == cp[a[more] + k]
        odd = np.flatnonzero(~same)  # of another string's hash
        n = np.concatenate((np.bincount(number[same], minlength=len(one)), np.ones(len(odd), np.int64)))
        rows = np.concatenate((one, odd))
        parts = list(zip(first[rows].tolist(), cut[rows].tolist(), last[rows].tolist(), strict=True))
        cells = ([text[a:b] for a, b, _ in parts], [text[b:c] for _, b, c in parts], n)
        return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(cells, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["factor", "next", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for text in batch_texts(batches):
            if text:
                held.append((text, block_starts(code_points(text), lam)))
                size += len(text)
            if size >= CHARS_AT_ONCE:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return texts.select("text").mapInArrow(run, "factor string, next string, n long")


def factor_counts(texts: DataFrame, lam: int) -> DataFrame:
    """factor, freq of the blocks of all texts."""
    return counted_in_place(texts, lam, None, 0).groupBy("factor").agg(F.sum("n").alias("freq"))


def borders(texts: DataFrame, lam: int, width: int) -> DataFrame:
    """factor (its last `width` characters), next (the `width` characters after it), n: what meets at the blocks' borders."""
    return counted_in_place(texts, lam, width, width).groupBy("factor", "next").agg(F.sum("n").alias("n"))


def dense_ids(rows: DataFrame, key: str, name: str, weight: Column | None = None, total: str = "bucket_start") -> DataFrame:
    """Ranks from 1 of the distinct strings of `key` (and the running sum of weights before each). Strings are ranked
    inside their two-character prefix, on top of what smaller prefixes hold, so that only the table of prefixes is
    ordered in one place."""
    rows = rows.withColumn("__prefix", F.substring(key, 1, 2))
    sums = [F.count("*").alias("__n")] + ([F.sum(weight).alias("__w")] if weight is not None else [])
    small = Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__prefix").agg(*sums)
    offsets = offsets.withColumn("__n", F.coalesce(F.sum("__n").over(small), F.lit(0)))
    inside = Window.partitionBy("__prefix").orderBy(key)
    if weight is not None:
        offsets = offsets.withColumn("__w", F.coalesce(F.sum("__w").over(small), F.lit(0)))
    out = rows.join(offsets, "__prefix").withColumn(name, (F.col("__n") + F.row_number().over(inside)).cast("long"))
    if weight is not None:
        out = out.withColumn(total, (F.col("__w") + F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long"))
    return out.drop("__prefix", "__n", "__w")


def lex_dictionary(blocks: DataFrame) -> DataFrame:
    """factor, lex_id, freq, bucket_start (blocks with a smaller factor)."""
    return ranked(blocks.groupBy("factor").agg(F.count("*").alias("freq")))


def ranked(counts: DataFrame) -> DataFrame:
    """The same from factor_counts."""
    return dense_ids(counts, "factor", "lex_id", F.col("freq")).select("factor", "lex_id", "freq", "bucket_start")


def colex_dictionary(dictionary: DataFrame) -> DataFrame:
    """rev, colex_id, lex_id: the factors of a dictionary in the order of their reversals."""
    lex = dictionary.withColumn("rev", F.reverse("factor"))
    return dense_ids(lex, "rev", "colex_id").select("rev", "colex_id", "lex_id")


def lex_text(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, lex_id."""
    return blocks.join(lex_dictionary(blocks), "factor").select("doc_id", "ord", "lex_id")


def sub_factors(dictionary: DataFrame) -> DataFrame:
    """sub, cnt: strings strictly inside blocks (touching neither end), from distinct factors weighted by freq."""
    inner = dictionary.where(F.length("factor") > 2).select("factor", "freq", F.explode(F.sequence(F.lit(2), F.length("factor") - 1)).alias("a"))
    inner = inner.select("freq", F.col("factor"), "a", F.explode(F.sequence(F.lit(1), F.length("factor") - F.col("a"))).alias("n"))
    return inner.groupBy(F.substring("factor", F.col("a"), F.col("n")).alias("sub")).agg(F.sum("freq").cast("long").alias("cnt"))


def index_params(texts: DataFrame, lam: int) -> DataFrame:
    """doc_id, n (blocks and the end mark), r (runs of the blocks' BWT), sigma (distinct blocks and the end mark)."""
    checked(lam)

    def kernel(text: str) -> dict:
        starts = block_starts(code_points(text), lam).tolist()
        blocks = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=False)]
        number = {f: i for i, f in enumerate(sorted(set(blocks)))}
        ids = np.array([number[f] for f in blocks], np.int64)
        return {"n": [len(ids) + 1], "r": [run_count(bwt_of(ids, suffix_array(ids)))], "sigma": [len(number) + 1]}

    return per_text(texts, "doc_id long, n long, r long, sigma long", kernel)


def pattern_factors(patterns: DataFrame) -> DataFrame:
    """pattern_id, last_s, start: where factors start inside each pattern, for both types of the run that ends it."""

    def kernel(pattern: str) -> dict:
        found = [(last_s, start) for last_s in (False, True) for start in factor_starts(code_points(pattern), last_s)]
        return {"last_s": [s for s, _ in found], "start": [k for _, k in found]}

    return per_text(patterns, "pattern_id long, last_s boolean, start long", kernel, key="pattern_id", text="pattern")
