"""Substring dedup of words: sharded FM-indexes, backward search of every window of the streamed documents.

A window is WIDTH consecutive words; each word covered by a window whose words also start anywhere else goes, in all
places. Windows reach shards as `passages` says; a shard lays its distinct segments one after another (a separator
between them), numbers their words, and builds one compressed FM-index (wavelet matrix over the BWT). The
segments found once are streamed through it: backward search in numpy batches gives the matching statistics of all
window ends, and a window is reported where its statistic reaches WIDTH with two rows or more. Segments found twice or more repeat as they are, and stay in the index for the others.

Cases: null, empty and short texts lose nothing. Texts with the same words lose all of them if they have WIDTH or more.
Null doc_id and repeated rows are rows like any other. Very long texts are taken whole. Other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, release, stage
from .fm_index import FmIndex
from .passages import TEXT, Unit, first_rows, measured, repeated

WIDTH, GRAM = 35, 12
EMPTY = hashlib.sha256(b"").hexdigest()


def covered(n: int, spans: np.ndarray, width: int) -> np.ndarray:
    """Which of n units are in a window whose start is in one of the spans (see by_segment)."""
    edge = np.zeros(n + 1, np.int32)
    first, count = spans >> 32, spans & 0xFFFFFFFF
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count + width - 1, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def shard_repeats(part: pd.DataFrame, width: int) -> pd.DataFrame:
    """seg_id and spans of the repeated windows of segments found once."""
    known: dict[bytes, int] = {}
    symbols, ends = [], []
    for seg in part["seg"]:
        symbols += [known.setdefault(w, len(known) + 1) for w in seg.split()]
        symbols.append(0)
        ends.append(len(symbols))
    text = np.array(symbols, np.int64)
    index = FmIndex(text, len(known) + 1, width)
    ends = np.array(ends)
    firsts = np.concatenate(([0], ends[:-1]))
    count = ends - 1 - firsts - width + 1
    alone = part["n"].to_numpy() == 1
    owner = np.repeat(np.flatnonzero(alone), count[alone])
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count[alone]) - count[alone], count[alone])
    hit = index.matching_statistics(text, firsts[owner] + offset + width, width) >= width
    del index
    release()
    return by_segment(part["seg_id"].to_numpy(), owner[hit], offset[hit])


def by_segment(names: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> pd.DataFrame:
    """(seg_id, spans) from window offsets and the numbers of their segments, in order. A span is a stretch of
    consecutive offsets: the first in the upper 32 bits, how many in the lower."""
    if not len(owner):
        return pd.DataFrame({"seg_id": names[:0], "spans": pd.Series([], dtype=object)})
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1))))
    span = (offset[first] << 32) | np.diff(np.append(first, len(owner)))
    own = owner[first]
    head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    lists = np.empty(len(head), object)
    lists[:] = [x.tolist() for x in np.split(span, head[1:])]
    return pd.DataFrame({"seg_id": names[own[head]], "spans": pd.Series(lists, dtype=object)})


def removed(texts: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, th, n_removed, n_spans, kept_sha from doc_id, th, text, spans: staged, one row for each text."""

    def make():
        def work(batch: pa.RecordBatch):
            out = {k: [] for k in ("n_removed", "n_spans", "kept_sha")}
            for i in range(len(batch)):
                data, spans = batch["text"][i].as_py().encode(), np.array(batch["spans"][i].as_py(), np.int64)
                units = data.split() if unit.words else data
                gone = covered(len(units), spans, unit.width)
                if unit.words:
                    kept = b" ".join([w for w, g in zip(units, gone.tolist(), strict=True) if not g])
                else:
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
                out["kept_sha"].append(hashlib.sha256(kept).hexdigest())
            yield {"doc_id": batch["doc_id"], "th": batch["th"], **out}

        return work

    made = by_batch(texts.select(*TEXT, "text", "spans"), "doc_id long, th long, n_removed long, n_spans long, kept_sha string", make)
    return stage(made.dropDuplicates(list(TEXT)), "removed")


def verdicts(rows: DataFrame, heads: DataFrame, cut: DataFrame) -> DataFrame:
    """rows with the first row and number of their copies, and n_removed, n_spans, kept_sha of their text (or null)."""
    groups = heads.select("sha", F.col("head.uid").alias("head_uid"), "copies")
    cut = cut.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "n_removed", "n_spans", "kept_sha")
    joined = rows.join(groups, "sha")
    return joined.join(cut, joined["doc_id"].eqNullSafe(cut["__id"]) & (joined["th"] == cut["__th"]), "left")


def repeats(docs: DataFrame, rows: DataFrame, heads: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, th, text, spans (stretches of first words of repeated windows) of the texts that have any."""
    return repeated(docs, rows, heads, unit, lambda part: shard_repeats(part, unit.width))


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """uid, doc_id, n_words, n_removed, kept_sha256 of every row."""
    unit = Unit(True, width, gram)
    rows = measured(docs, unit)
    heads = first_rows(rows)
    joined = verdicts(rows, heads, removed(repeats(docs, rows, heads, unit), unit))
    copied = (F.col("copies") > 1) & (F.col("n") >= width)
    gone = F.when(copied, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(copied, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha", "sha"))
    return joined.select("uid", "doc_id", F.col("n").alias("n_words"), gone.cast("long").alias("n_removed"), sha.alias("kept_sha256"))
