"""Exact deduplication of incoming rows against immutable snapshots, screened by static binary-fuse filters.

A snapshot is a table of distinct digests (sha256 of the text with each run of white space made one space) with the row
that stays, split in buckets by digest; each bucket has one filter, built once. An incoming batch is first grouped by
digest on its own (new-batch duplicates), then every distinct digest is probed in its bucket's filter: negatives are
new; positives join the snapshot's exact bucket. The bytes of all rows of a group of two or more are compared: the
smallest and the largest text of a digest must be the same, which Spark computes with partial aggregation, so a
digest that a third of all rows have doesn't meet in one task.

`Snapshot` holds entries and filters, can be saved and loaded, and tells which rows of a later batch it has seen. `dedup` takes
one table as two batches cut at the middle of its doc_id range: the lower is the snapshot, the upper is the incoming batch.

Cases: null text counts as empty; empty texts are equal to each other. A null doc_id sorts first. Rows that repeat both
doc_id and text: one of them stays. An empty table gives no rows. Columns other than doc_id and text are carried by
`kept_rows`, which names its own column as none of theirs, and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_fuse import BinaryFuse
from .common import SPACES, stage, text_or_empty, unused

#: keys that a bucket of a snapshot has on average at most, and the least number of buckets
BUCKET_KEYS, LEAST_BUCKETS = 1 << 15, 256
#: bytes of filters that may be broadcast to screen texts for the byte check; above it all texts are compared
BROADCAST_FILTER_BYTES = 32 << 20
#: rows that go up to which their keys are broadcast (about 100 bytes each)
BROADCAST_IDS = 500_000


def normalised() -> Column:
    return F.regexp_replace(text_or_empty(), SPACES, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, digest) of every row, staged: uid then numbers rows for good."""
    return stage(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.sha2(normalised(), 256).alias("digest")), "digests", scan=True)


def key64(digest: str = "digest") -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: the smallest (doc_id, uid) and the number of rows."""
    return rows.groupBy("digest").agg(F.min(F.struct("doc_id", "uid")).alias("first"), F.count("*").alias("n"))


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("key", key64()).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def filters(keys: DataFrame) -> DataFrame:
    """(bucket, filter) from rows with bucket and key."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "filter": [BinaryFuse.build(part["key"].to_numpy().view(np.uint64)).to_bytes()]})

    return keys.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screened(incoming: DataFrame, built: DataFrame) -> DataFrame:
    """incoming (digest, first, n, key, bucket) with `maybe`: its bucket's filter has the key."""

    def probe(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        keys = rows["key"].to_numpy().view(np.uint64)
        hit = BinaryFuse.from_bytes(own["filter"].iloc[0]).holds(keys) if len(own) else np.zeros(len(keys), bool)
        return pd.DataFrame({"digest": rows["digest"], "maybe": hit})

    flags = incoming.select("bucket", "digest", "key").groupBy("bucket").cogroup(built.groupBy("bucket")).applyInPandas(probe, "digest string, maybe boolean")
    return incoming.join(flags, "digest")


@dataclass(frozen=True)
class Snapshot:
    """Immutable: entries (digest, first, n, key, bucket) and one filter for each of its buckets, built once."""

    entries: DataFrame
    filters: DataFrame
    buckets: int

    @classmethod
    def of(cls, groups: DataFrame, buckets: int) -> Snapshot:
        entries = with_bucket(groups, buckets)
        return cls(entries, filters(entries), buckets)

    def save(self, path: str) -> None:
        """Writes a snapshot to a new folder."""
        self.entries.write.parquet(f"{path}/entries")
        self.filters.withColumn("buckets", F.lit(self.buckets)).write.parquet(f"{path}/filters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Snapshot:
        built = spark.read.schema("bucket int, filter binary, buckets int").parquet(f"{path}/filters")
        first = built.select("buckets").first()
        return cls(spark.read.parquet(f"{path}/entries"), built.drop("buckets"), first[0] if first else 1)

    def known(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest, keep_id (of the snapshot's row; null if there is none) and seen of incoming rows."""
        rows = digests(docs)
        probed = screened(with_bucket(grouped(rows), self.buckets), self.filters).where("maybe").select("digest")
        hits = self.entries.select("digest", F.col("first.doc_id").alias("keep_id")).join(probed, "digest").withColumn("seen", F.lit(True))
        return rows.join(hits, "digest", "left").select("doc_id", "digest", "keep_id", F.coalesce("seen", F.lit(False)).alias("seen"))


def merge(snapshot: Snapshot, incoming: DataFrame) -> DataFrame:
    """Groups (digest, first, n) of both: snapshot and incoming each have one row for a digest."""
    entries, incoming = snapshot.entries, with_bucket(incoming, snapshot.buckets)
    probed = stage(screened(incoming, snapshot.filters), "probed")
    hits = probed.where("maybe").select("digest", F.col("first").alias("new_first"), F.col("n").alias("new_n"))
    old = entries.select("digest", "first", "n").join(hits, "digest", "left").select("digest", F.least("first", F.coalesce("new_first", "first")).alias("first"), (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("n"))
    missed = probed.where("maybe").join(entries.select("digest"), "digest", "left_anti").select("digest", "first", "n")
    return old.unionByName(missed).unionByName(probed.where(~F.col("maybe")).select("digest", "first", "n"))


def byte_check(docs: DataFrame, repeated: DataFrame, buckets: int) -> DataFrame:
    """(digest, same) of the digests that several rows have; same: all their normalised texts are one byte string."""
    built = stage(filters(with_bucket(repeated.select("digest"), buckets)), "filters")
    size = built.agg(F.sum(F.length("filter"))).first()[0] or 0
    texts = docs.select(normalised().alias("norm")).withColumn("digest", F.sha2("norm", 256))
    if size <= BROADCAST_FILTER_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast({r["bucket"]: bytes(r["filter"]) for r in built.collect()})

        @F.pandas_udf("boolean")
        def may_repeat(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            own = {k: BinaryFuse.from_bytes(v) for k, v in shared.value.items()}
            for key, bucket in batches:
                key, bucket = key.to_numpy().view(np.uint64), bucket.to_numpy()
                hit = np.zeros(len(key), bool)
                for b in np.unique(bucket):
                    if b in own:
                        hit[bucket == b] = own[b].holds(key[bucket == b])
                yield pd.Series(hit)

        texts = with_bucket(texts, buckets).where(may_repeat("key", "bucket"))
    return texts.groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same"))


def dedup(docs: DataFrame) -> DataFrame:
    """uid, doc_id, digest, keep_id, group_size, kept, repeats of every row (repeats: the row that stays has copies
    with its own doc_id). Raises if two different texts have one digest."""
    rows = digests(docs)
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    middle = ((low or 0) + (high or 0)) // 2
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_KEYS))
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    groups = stage(merge(Snapshot.of(grouped(rows.where(old)), buckets), grouped(rows.where(~old))), "groups")
    checked = byte_check(docs, groups.where("n > 1"), buckets)
    wrong = F.raise_error(F.concat(F.lit("different texts have the digest "), F.col("digest")))
    sure = groups.where("n > 1").join(checked, "digest", "left").select("digest", "first", F.when(F.coalesce("same", F.lit(False)), F.col("n")).otherwise(wrong.cast("long")).alias("n"))
    groups = groups.where("n = 1").unionByName(sure)
    joined = rows.join(groups, "digest")
    return joined.select("uid", "doc_id", "digest", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("first.uid")).alias("kept"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: an anti-join on the rows that go, which are broadcast only
    up to BROADCAST_IDS; texts don't move then."""
    found = stage(dedup(docs), "membership")
    gone = found.where(~F.col("kept"))
    # a row that repeats both doc_id and text of the one that stays can't be told from it by key
    again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    mark = unused("digest", docs)
    rows = without(docs.withColumn(mark, F.sha2(normalised(), 256)), gone.where(~again), mark, "digest")
    twice = gone.where(again).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__key")).distinct()
    if not twice.isEmpty():
        same = (rows[mark] == twice["__key"]) & rows["doc_id"].eqNullSafe(twice["__id"])
        rows = rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", mark]))
    return rows.drop(mark)


def without(rows: DataFrame, gone: DataFrame, mark: str, key: str) -> DataFrame:
    """rows but for those whose doc_id and mark are the doc_id and key of a row of gone."""
    few = gone.count() <= BROADCAST_IDS
    marks = gone.select(F.col("doc_id").alias("__id"), F.col(key).alias("__key")).distinct()
    return rows.join(F.broadcast(marks) if few else marks, (rows[mark] == marks["__key"]) & rows["doc_id"].eqNullSafe(marks["__id"]), "left_anti")
