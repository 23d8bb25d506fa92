"""Repeated passages: routes all windows of a fixed width that may repeat to shards where they can be judged.

A text is a sequence of units (words or bytes). The anchor of a window of `width` units is the smallest hash of its
`gram`-unit strings, so equal windows have equal anchors. Consecutive windows with one anchor are a run; a run's text is a
segment. Only runs whose anchor occurs at least twice in the corpus can hold repeated windows:

  texts -> anchors (numpy) -> anchors that repeat (partial aggregation) -> segments of their runs, cut in a second
  scan -> distinct segments, with the first place and the number of places -> shards by anchor

In a periodic stretch an anchor comes back at once. There a run is compared with itself, moved by the distance: windows
equal to an earlier one of the run are settled on the spot, and leave the segment, so that a text that repeats one
letter or word costs one period.

The second scan screens anchors with static binary-fuse filters of the repeated ones, broadcast only up to
FILTER_BYTES; beyond, all segments are cut and joined with the repeated anchors by shuffle. Exact counts by segment follow
in either case. A segment that is the only kind of its anchor needs no judging: all its places are equal. The segments of an
anchor with more than HOT kinds are cut again at anchors of longer strings under another hash, and those in turn at whole
windows, so that no anchor fills a shard; every part is judged as the others are, by comparing units. Every window is in
exactly one segment and meets all its equals in one shard. A text is known by (doc_id, th), th being a hash of it; rows
that repeat both are one text here, and texts that copy another are left out: they change no verdict on others.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binary_fuse import BinaryFuse
from .common import by_batch, mixed, slices, stage, windows, words_of

HOT = 2000
SHARD_BYTES = 400_000
#: bytes of a text that are hashed at a time
PIECE = 1 << 20
#: bytes of filters, rows of ids and of anchors, and spans up to which they are broadcast; larger ones are joined by
#: shuffle
FILTER_BYTES, BROADCAST_IDS, BROADCAST_ANCHORS, BROADCAST_SPANS = 32 << 20, 500_000, 500_000, 2_000_000
FILTER_KEYS = 1 << 19
TEXT = ("doc_id", "th")


def place(*more: str) -> Column:
    """What orders texts: doc_id (null first), then the text's hash."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th", *more)


@dataclass(frozen=True)
class Runs:
    """Of one text: its units; of each segment the anchor, the first window and how many; spans of settled windows."""

    n: int
    h: np.ndarray
    at: np.ndarray
    count: np.ndarray
    settled: np.ndarray


@dataclass(frozen=True)
class Unit:
    """words: units are words, and a window repeats if it starts anywhere else; else bytes, and it repeats if it starts
    earlier. width: units of a window. gram: units of an anchor string. seed: of the anchors' hash."""

    words: bool
    width: int
    gram: int
    seed: int = 0

    def digest(self, data: bytes) -> str:
        return hashlib.sha256(b" ".join(data.split()) if self.words else data).hexdigest()

    def longer(self) -> Unit | None:
        """The unit that cuts the segments of a hot anchor again (none after whole windows)."""
        if self.gram == self.width:
            return None
        return Unit(self.words, self.width, min(self.width, 2 * self.gram) if not self.seed else self.width, self.seed + 1)

    def hashes(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """gram hashes of the texts laid one after another, numbers of the units, and the first unit of each text (one
        entry more)."""
        if self.words:
            _, _, h, first = words_of(parts)
        else:
            h, first = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        g = windows(h if self.words else h.astype(np.uint64) + np.uint64(0x51), self.gram)
        return (mixed(g ^ np.uint64(0x9E3779B97F4A7C15 * self.seed % 2**64)) if self.seed else g), h, first

    def runs(self, parts: list[bytes]) -> list[Runs]:
        if self.words or len(parts) > 1 or len(parts[0]) <= PIECE + self.width:
            return self._runs(parts)
        own = [(a, self._runs([parts[0][a : a + PIECE + self.width - 1]])[0]) for a in range(0, len(parts[0]) - self.width + 1, PIECE)]
        joined = lambda name, step: np.concatenate([getattr(r, name) + a * step for a, r in own])
        return [Runs(len(parts[0]), joined("h", 0), joined("at", 1), joined("count", 0), joined("settled", 1 << 32))]

    def _runs(self, parts: list[bytes]) -> list[Runs]:
        g, units, first = self.hashes(parts)
        span = self.width - self.gram + 1
        if len(g) >= span:
            low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
            done = 1
            while 2 * done <= span:
                low = np.minimum(low[:-done], low[done:])
                done *= 2
            if done < span:
                low = np.minimum(low[: len(low) - (span - done)], low[span - done :])
            anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out, none = [], np.empty(0, np.int64)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b - a < self.width:
                out.append(Runs(b - a, none, none, none, none))
                continue
            own = anchor[a : b - self.width + 1]
            moved = np.concatenate(([True], own[1:] != own[:-1]))
            places = np.flatnonzero(moved)
            h = g[own[places]]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            at, h = places[new], h[new].view(np.int64)
            count = np.diff(np.append(at, len(own)))
            settled = none
            if not new.all():
                size = np.diff(np.append(np.flatnonzero(new), len(new)))
                again = np.flatnonzero(size > 1)
                period = own[places[np.flatnonzero(new)[again] + 1]] - own[at[again]]
                words = parts[k].split() if self.words else None
                h, at, count, settled = self._folded(units[a:b], words, h, at, count, again, period)
            out.append(Runs(b - a, h, at, count, settled))
        return out

    def _folded(self, units: np.ndarray, words: list[bytes] | None, h: np.ndarray, at: np.ndarray, count: np.ndarray, again: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments without the windows that equal the one a period before them in their run, and spans of settled ones."""
        keep = np.ones(len(h), bool)
        more, settled = [], []
        for r, p in zip(again.tolist(), period.tolist(), strict=True):
            s, w = int(at[r]), int(count[r])
            if w <= p:
                continue
            end = s + w + self.width - 1
            if words is None:
                other = units[s + p : end] != units[s : end - p]
            else:  # bytes, not hashes, decide
                other = np.fromiter(map(bytes.__ne__, words[s + p : end], words[s : end - p]), bool, end - p - s)
            sums = np.concatenate(([0], np.cumsum(other)))
            same = np.zeros(w, bool)
            same[p:] = sums[self.width : self.width + w - p] == sums[: w - p]
            if same.any():
                keep[r] = False
                more.append((h[r], s, stretches(~same)))
                if self.words:
                    same[:-p] |= same[p:].copy()
                settled.append((s, stretches(same)))
        if not more:
            return h, at, count, np.empty(0, np.int64)
        spans = np.concatenate([x + (s << 32) for s, x in settled])
        added = np.concatenate([x + (s << 32) for _, s, x in more])
        h = np.concatenate([h[keep], np.concatenate([np.full(len(x), v) for v, _, x in more])])
        at, count = np.concatenate([at[keep], added >> 32]), np.concatenate([count[keep], added & 0xFFFFFFFF])
        order = np.argsort(at, kind="stable")
        return h[order], at[order], count[order], spans

    def cut(self, data: bytes) -> Callable[[int, int], bytes]:
        """A function from (unit, units) to their bytes; words are joined by one space."""
        if not self.words:
            return lambda at, n: data[at : at + n]
        own = data.split()
        return lambda at, n: b" ".join(own[at : at + n])


def stretches(good: np.ndarray) -> np.ndarray:
    """Spans of the stretches that are true: the first in the upper 32 bits, how many in the lower."""
    edge = np.diff(np.concatenate(([0], good.astype(np.int8), [0])))
    first = np.flatnonzero(edge == 1)
    return (first << 32) | (np.flatnonzero(edge == -1) - first)


def measured(docs: DataFrame, unit: Unit) -> DataFrame:
    """uid, doc_id, th, n (units), sha (digest of all units) of every row: staged."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    if not unit.words:
        return stage(rows.select("uid", *TEXT, F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha")), "texts", scan=True)

    def make():
        def work(batch: pa.RecordBatch):
            texts = [t.encode() for t in batch["text"].to_pylist()]
            yield {**{c: batch[c] for c in ("uid", *TEXT)}, "n": [len(t.split()) for t in texts], "sha": [unit.digest(t) for t in texts]}

        return work

    return stage(by_batch(rows, "uid long, doc_id long, th long, n long, sha string", make), "texts", scan=True)


def repeated_anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """h of the anchors found twice or more: staged."""

    def make():
        def work(batch: pa.RecordBatch):
            for _, parts in slices(batch["text"].to_pylist()):
                h, n = np.unique(np.concatenate([r.h for r in unit.runs(parts)]), return_counts=True)
                yield {"h": h, "n": n.astype(np.int32)}

        return work

    return stage(by_batch(docs.select("text"), "h long, n int", make).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "anchors")


def first_rows(rows: DataFrame) -> DataFrame:
    """sha, head (known, doc_id, th, uid of the first row) and copies: staged, so that Spark can split joins at a
    text that very many rows have."""
    return stage(rows.groupBy("sha").agg(F.min(place("uid")).alias("head"), F.count("*").alias("copies")), "heads")


def segments(docs: DataFrame, rows: DataFrame, heads: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, th, h, at, windows, seg, seg_id of every run with a repeated anchor, and rows with doc_id, th, at and spans of
    settled windows: staged. Texts that copy another are left out."""
    again = repeated_anchors(docs, unit)
    buckets = max(1, -(-again.count() // FILTER_KEYS))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "filter": [BinaryFuse.build(part["h"].to_numpy().view(np.uint64)).to_bytes()]})

    keyed = again.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    built = stage(keyed.groupBy("bucket").applyInPandas(build, "bucket int, filter binary"), "anchor-filters")
    size = built.agg(F.sum(F.length("filter"))).first()[0] or 0
    screen = size <= FILTER_BYTES
    shared = docs.sparkSession.sparkContext.broadcast({r["bucket"]: bytes(r["filter"]) for r in built.collect()} if screen else {})

    def make():
        filters = {k: BinaryFuse.from_bytes(v) for k, v in shared.value.items()}

        def wanted(h: np.ndarray) -> np.ndarray:
            if not screen:
                return np.ones(len(h), bool)
            bucket, out = h % buckets, np.zeros(len(h), bool)
            for k, f in filters.items():
                some = np.flatnonzero(bucket == k)
                out[some] = f.holds(h[some].view(np.uint64))
            return out

        def work(batch: pa.RecordBatch):
            names = (*TEXT, "h", "at", "windows", "seg", "spans")
            ids = list(zip(*[batch[c].to_pylist() for c in TEXT], strict=True))
            for start, parts in slices(batch["text"].to_pylist()):
                out, size = {k: [] for k in names}, 0
                found = unit.runs(parts)
                hit = wanted(np.concatenate([r.h for r in found]))
                done = 0
                for i, (data, r) in enumerate(zip(parts, found, strict=True), start):
                    good = np.flatnonzero(hit[done : done + len(r.h)])
                    done += len(r.h)
                    if len(r.settled):
                        for name, v in zip(names, (*ids[i], 0, 0, 0, None, r.settled.tolist()), strict=True):
                            out[name].append(v)
                    cut = unit.cut(data) if len(good) else None
                    for h, a, c in zip(r.h[good].tolist(), r.at[good].tolist(), r.count[good].tolist(), strict=True):
                        seg = cut(a, c + unit.width - 1)
                        for name, v in zip(names, (*ids[i], h, a, c, seg, None), strict=True):
                            out[name].append(v)
                        size += len(seg)
                        if size > PIECE:
                            yield out
                            out, size = {k: [] for k in names}, 0
                yield out

        return work

    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    copies = rows.select("sha", *TEXT).join(heads.where("copies > 1"), "sha").where(~F.col("doc_id").eqNullSafe(F.col("head.doc_id"))).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    texts = texts.join(copies, texts["doc_id"].eqNullSafe(copies["__id"]) & (texts["th"] == copies["__th"]), "left_anti")
    made = by_batch(texts, "doc_id long, th long, h long, at int, windows int, seg binary, spans array<long>", make)
    if not screen:
        made = made.join(again, "h", "left_semi").unionByName(made.where("spans is not null"))
    return stage(made.withColumn("seg_id", F.unhex(F.md5("seg"))), "segments", scan=True)


Judge = Callable[[pd.DataFrame], pd.DataFrame]


def repeated(docs: DataFrame, rows: DataFrame, heads: DataFrame, unit: Unit, judge: Judge) -> DataFrame:
    """doc_id, th, text, spans (stretches of first units of repeated windows) of the texts that have any."""
    found = segments(docs, rows, heads, unit)
    hits = resolved(found.where("seg is not null").withColumn("weight", F.lit(1)), unit, judge)
    return with_spans(docs, hits.select(*TEXT, "at", "spans").unionByName(found.where("spans is not null").select(*TEXT, "at", "spans")))


def resolved(found: DataFrame, unit: Unit, judge: Judge) -> DataFrame:
    """The rows of found (doc_id, th, h, at, windows, seg, seg_id, weight: how many places the row stands for, and others)
    whose segment has repeated windows, with spans of these relative to at; staged tables between the steps."""
    places = [c for c in found.columns if c not in ("h", "seg", "spans")]
    kinds = stage(found.groupBy("h", "seg_id", "seg").agg(F.min(place("at")).alias("first"), F.sum("weight").alias("n")), "kinds")
    again = judged(kinds, unit, judge)
    marks = kinds.select("seg_id", "n", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"), F.col("first.at").alias("first_at"))
    marks = marks.join(again, "seg_id", "left").where("n > 1 or spans is not null")
    marks = stage(marks, "marks")  # a table of its own: Spark can split the join at a very common segment
    hits = found.select(places).join(marks, "seg_id")
    if unit.words:
        settled = F.col("n") > 1
    else:
        settled = ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th")) & (F.col("at") == F.col("first_at")))
    hits = hits.withColumn("spans", F.when(settled, F.array(F.col("windows").cast("long"))).otherwise(F.col("spans")))
    return hits.where("spans is not null").select(*places, "spans")


def judged(kinds: DataFrame, unit: Unit, judge: Judge) -> DataFrame:
    """seg_id and spans of the windows at first places that are repeats. judge gets the segments of a shard that aren't
    the only kind of their anchor (h, seg_id, seg, n and the first place)."""
    cold, more, longer = kinds, None, unit.longer()
    if longer:
        hot = stage(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("h"), "hot-anchors")
        if not hot.isEmpty():
            hot = F.broadcast(hot) if hot.count() <= BROADCAST_ANCHORS else hot
            cold = kinds.join(hot, "h", "left_anti")
            parts = kinds.join(hot, "h", "left_semi").select("seg_id", "seg", "n", "first.*")
            parts = by_batch(parts, "doc_id long, th long, h long, at int, windows int, seg binary, weight long, whole binary, off int", functools.partial(cut_again, longer))
            parts = stage(parts.withColumn("seg_id", F.unhex(F.md5("seg"))), "cut-again", scan=True)
            settled = parts.where("weight = 0").select("whole", F.array(F.shiftleft(F.col("off").cast("long"), 32) + F.col("windows")).alias("spans"))
            found = resolved(parts.where("weight > 0"), longer, judge)
            found = found.select("whole", F.transform("spans", lambda x: x + F.shiftleft(F.col("off").cast("long"), 32)).alias("spans"))
            more = found.unionByName(settled).groupBy(F.col("whole").alias("seg_id")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    size = cold.agg(F.sum(F.length("seg"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        many = part.groupby("h")["h"].transform("size") > 1
        return judge(part[many].reset_index(drop=True)) if many.any() else pd.DataFrame({"seg_id": part["seg_id"][:0], "spans": pd.Series([], dtype=object)})

    flat = cold.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "seg_id", "seg", "n", "first.*")
    out = stage(flat.groupBy("shard").applyInPandas(one, "seg_id binary, spans array<long>"), "judged", scan=True)
    return out.unionByName(stage(more, "judged-again")) if more is not None else out


def cut_again(unit: Unit) -> Callable[[pa.RecordBatch], object]:
    """Cuts segments (whole: the id of each) into the segments of a longer unit, off being their first window there; weight 0
    marks stretches of settled windows."""

    def work(batch: pa.RecordBatch):
        names = ("doc_id", "th", "h", "at", "windows", "seg", "weight", "whole", "off")
        out = {k: [] for k in names}
        for whole, seg, n, doc_id, th, at in zip(*[batch[c].to_pylist() for c in ("seg_id", "seg", "n", "doc_id", "th", "at")], strict=True):
            runs, cut = unit.runs([seg])[0], unit.cut(seg)
            rows = [(h, a, c, cut(a, c + unit.width - 1), n) for h, a, c in zip(runs.h.tolist(), runs.at.tolist(), runs.count.tolist(), strict=True)]
            rows += [(0, s >> 32, s & 0xFFFFFFFF, b"", 0) for s in runs.settled.tolist()]
            for h, a, c, part, weight in rows:
                for name, v in zip(names, (doc_id, th, h, at + a, c, part, weight, whole, a), strict=True):
                    out[name].append(v)
        yield out

    return work


def with_spans(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, th, text, spans (stretches of first units of repeated windows: first unit in the upper 32 bits, how many
    in the lower) of the texts in hits (doc_id, th, at, spans relative to at)."""
    shifted = F.transform("spans", lambda x: x + F.shiftleft(F.col("at").cast("long"), 32))
    spans = hits.groupBy(*TEXT).agg(F.flatten(F.collect_list(shifted)).alias("spans"))

    def make():
        def work(batch: pa.RecordBatch):
            yield {**{c: batch[c] for c in TEXT}, "spans": [merged(np.array(x, np.int64)).tolist() for x in batch["spans"].to_pylist()]}

        return work

    spans = by_batch(spans, "doc_id long, th long, spans array<long>", make)
    spans = stage(spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "spans"), "spans")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    n, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    few = n <= BROADCAST_IDS and size <= BROADCAST_SPANS
    same = texts["doc_id"].eqNullSafe(spans["__id"]) & (texts["th"] == spans["__th"])
    return texts.join(F.broadcast(spans) if few else spans, same).drop("__id", "__th")


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans with those that meet joined, in order."""
    spans = np.sort(spans)
    first, end = spans >> 32, (spans >> 32) + (spans & 0xFFFFFFFF)
    end = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], first[1:] > end[:-1])))
    last = np.append(new[1:], len(spans)) - 1
    return (first[new] << 32) | (end[last] - first[new])
