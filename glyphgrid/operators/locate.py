"""Where patterns occur: positions, ranges of text, context, and the texts that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import per_text

#: passages (and their characters in all) that one scan of the texts looks for
BROADCAST_PASSAGES, BROADCAST_CHARS = 100_000, 50_000_000


def occurrences(text: str, pattern: str, most: int | None = None) -> list[int]:
    out, at = [], text.find(pattern)
    while at >= 0 and (most is None or len(out) < most):
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


def locate(texts: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """doc_id, pos (from 0) of every occurrence, or of the first `most` in each text. Only texts that hold the pattern
    leave the scan."""
    if not pattern:
        raise ValueError("an empty pattern has no positions")
    holds = texts.where(F.contains("text", F.lit(pattern)))
    return per_text(holds, "doc_id long, pos long", lambda t: {"pos": occurrences(t, pattern, most)})


def extract_range(texts: DataFrame, start: Column, size: Column) -> DataFrame:
    """doc_id, part: `size` characters from position `start` (from 0)."""
    return texts.select("doc_id", F.substr("text", (start + 1).cast("int"), size.cast("int")).alias("part"))


def display_context(texts: DataFrame, pattern: str, around: int) -> DataFrame:
    """doc_id, pos, context: each occurrence with up to `around` characters on either side."""

    def kernel(text: str) -> dict:
        at = occurrences(text, pattern)
        return {"pos": at, "context": [text[max(0, p - around) : p + len(pattern) + around] for p in at]}

    return per_text(texts.where(F.contains("text", F.lit(pattern))), "doc_id long, pos long, context string", kernel)


def doc_listing(texts: DataFrame, pattern: str) -> DataFrame:
    return texts.where(F.contains("text", F.lit(pattern))).select("doc_id")


def doc_counts(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """pattern, df: texts that hold each pattern, in one scan."""
    one = texts.agg(*[F.count_if(F.contains("text", F.lit(p))).alias(f"c{i}") for i, p in enumerate(patterns)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"c{i}").alias("df")) for i, p in enumerate(patterns)])))


def listing_runs(listing: DataFrame, range_size: int = 1 << 20) -> DataFrame:
    """lo, hi of maximal runs of consecutive doc_ids. Runs are found inside ranges of ids, and runs that meet at the
    border of ranges are joined over the border runs only."""
    ids = listing.select("doc_id").distinct().withColumn("g", F.floor(F.col("doc_id") / range_size))
    inside = Window.partitionBy("g").orderBy("doc_id")
    runs = ids.withColumn("island", F.col("doc_id") - F.row_number().over(inside))
    runs = runs.groupBy("g", "island").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    border = (F.pmod("lo", F.lit(range_size)) == 0) | (F.pmod(F.col("hi") + 1, F.lit(range_size)) == 0)
    order = Window.orderBy("lo")  # two border runs for each range of ids
    edge = runs.where(border).withColumn("start", F.coalesce((F.lag("hi").over(order) + 1 != F.col("lo")).cast("int"), F.lit(1)))
    edge = edge.withColumn("k", F.sum("start").over(order)).groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.where(~border).select("lo", "hi").unionByName(edge.select("lo", "hi"))


def containment(texts: DataFrame, passages: DataFrame, seed: int = 24) -> DataFrame:
    """item_id, doc_id, occ of passages (item_id, text) inside texts: long-pattern search by seeds. The first `seed`
    characters of each passage (all of a shorter one) are looked up by window hash in the texts; hits are compared in full. Empty
    passages have no place."""
    from .count import code_points, window_keys
    import numpy as np

    rows = passages.where(F.length("text") > 0).select("item_id", "text").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BROADCAST_PASSAGES), -(-size // BROADCAST_CHARS))
    if parts > 1:  # a scan of the texts for each part of the passages
        found = None
        for k in range(parts):
            one = containment(texts, rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts)).isin(2 * k, 2 * k + 1)), seed)
            found = one if found is None else found.unionByName(one)
        return found
    own = [(r["item_id"], r["text"]) for r in rows.collect()]
    tables = {}
    for size in sorted({min(len(t), seed) for _, t in own}):
        some = [x for x in own if min(len(x[1]), seed) == size]
        keys = np.array([window_keys(code_points(t[:seed]), size)[0] for _, t in some], np.uint64)
        order = np.argsort(keys, kind="stable")
        tables[size] = (keys[order], [some[i] for i in order])
    shared = texts.sparkSession.sparkContext.broadcast(tables)

    def kernel(text: str) -> dict:
        found: dict[int, int] = {}
        cp = code_points(text)
        for size, (known, items) in shared.value.items():
            key = window_keys(cp, size)
            at = np.searchsorted(known, key)
            for i in np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == key)).tolist():
                k = int(at[i])
                while k < len(known) and known[k] == key[i]:
                    if text.startswith(items[k][1], i):
                        found[items[k][0]] = found.get(items[k][0], 0) + 1
                    k += 1
        return {"item_id": list(found), "occ": list(found.values())}

    return per_text(texts, "doc_id long, item_id long, occ long", kernel)
