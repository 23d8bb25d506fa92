"""TextIndex: build once, save as Parquet tables, load, count by backward search.

The index is a table of shards, each of about SHARD_CHARS characters of whole texts: the dictionary of their factor
blocks in order, the order of the reversed blocks, and the runs of the Burrows-Wheeler transform of the block text. Building
is one scan, counting is one scan of the shards with the patterns broadcast, and only counts by pattern move. Counting
needs no text. The search of a shard takes time by pattern, so a batch over PATTERNS_AT_ONCE would take shards times
patterns: for such a batch each shard reads its texts back from its BWT, once, and counts their windows that pass a filter of
the patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factorize
from ..operators.count import PatternFilter
from ..operators.grammar import Shard, border_sets, pieces
from ..sources.texts import validated

FORMAT = 2
TABLES = {
    "shards": "shard long, factors array<string>, symbols binary, lengths binary, colex binary",
    "documents": "doc_id long, n long, r long, sigma long",
    "alphabet": "ch string, symbol long",
}
SHARD_CHARS = 1 << 20
#: patterns that a shard is searched for one by one
PATTERNS_AT_ONCE = 10_000


def sharded(texts: DataFrame, lam: int) -> DataFrame:
    """The shards of texts, made where the texts are; a long text is a shard of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def shard() -> pa.RecordBatch:
            own = Shard.build(held, lam)
            cells = (task + made, own.factors, *[x.astype("<i4").tobytes() for x in (own.symbols, own.lengths, own.colex)])
            kinds = (pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], type=k) for c, k in zip(cells, kinds, strict=True)], names=["shard", "factors", "symbols", "lengths", "colex"])

        for batch in batches:
            for value in batch["text"]:
                if text := value.as_py():
                    if held and size + len(text) > SHARD_CHARS:
                        yield shard()
                        held, size, made = [], 0, made + 1
                    held.append(text)
                    size += len(text)
        if held:
            yield shard()

    return texts.select("text").mapInArrow(run, TABLES["shards"])


def numbers(batch: pa.RecordBatch, i: int, column: str) -> np.ndarray:
    return np.frombuffer(batch[column][i].as_py(), "<i4").astype(np.int64)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """The texts of shards."""
    for batch in batches:
        for i in range(len(batch)):
            own = Shard(batch["factors"][i].as_py(), numbers(batch, i, "symbols"), numbers(batch, i, "lengths"), np.zeros(0, np.int64))
            yield from own.texts()


class TextIndex:
    """Tables: shards, documents (doc_id and the parameters of its block text), alphabet (ch, symbol)."""

    def __init__(self, lam: int, tables: dict[str, DataFrame]):
        self.lam, self.tables = lam, tables

    @classmethod
    def build(cls, texts: DataFrame, lam: int = 4) -> TextIndex:
        from ..operators.alphabet import symbol_table

        factorize.checked(lam)
        texts = validated(texts)
        return cls(lam, {"shards": sharded(texts, lam), "documents": factorize.index_params(texts, lam), "alphabet": symbol_table(texts)})

    def save(self, path: str) -> None:
        spark = self.tables["shards"].sparkSession
        for name in TABLES:
            self.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(FORMAT, self.lam)], "format int, lam int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta is None or meta["format"] != FORMAT:
            raise ValueError(f"no index of format {FORMAT} at {path}")
        return cls(meta["lam"], {name: spark.read.schema(kinds).parquet(f"{path}/{name}") for name, kinds in TABLES.items()})

    def merged(self, other: TextIndex) -> TextIndex:
        """The index of the texts of both (their ids are the caller's to keep apart): shards stand side by side."""
        if self.lam != other.lam:
            raise ValueError("indexes of one block size can be merged")
        from pyspark.sql.window import Window

        both = {name: self.tables[name].unionByName(other.tables[name]) for name in ("shards", "documents")}
        symbols = self.tables["alphabet"].unionByName(other.tables["alphabet"]).select("ch").distinct()
        return TextIndex(self.lam, {**both, "alphabet": symbols.withColumn("symbol", F.row_number().over(Window.orderBy("ch")).cast("long"))})

    def parameters(self) -> DataFrame:
        """doc_id, n (blocks and the end mark), r (runs of the blocks' BWT), sigma (distinct blocks and the end mark)."""
        return self.tables["documents"]

    def space(self) -> DataFrame:
        """component, bytes (of strings and numbers) of each table's columns, and the total (component null)."""
        parts = []
        for name, table in self.tables.items():
            for c, kind in table.dtypes:
                size = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)) if kind.startswith("array") else F.octet_length(c).cast("long") if kind in ("string", "binary") else F.lit(8).cast("long")
                parts.append(table.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).select(F.lit(f"{name}.{c}").alias("component"), "bytes"))
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return rows.rollup("component").agg(F.sum("bytes").alias("bytes"))

    def describe(self, rows: int = 20) -> None:
        """Prints the first rows of every table."""
        for name in TABLES:
            print(f"{name} (lambda {self.lam})")
            self.tables[name].show(rows, truncate=80)

    def count(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, occ of patterns (pattern_id, pattern); null or empty ones are refused."""
        bad = F.raise_error(F.lit("an empty pattern has no count")).cast("string")
        patterns = patterns.select("pattern_id", F.when(F.length("pattern") > 0, F.col("pattern")).otherwise(bad).alias("pattern"))
        few = patterns.agg(F.count("*"), F.collect_set(F.length("pattern"))).first()
        if few[0] > PATTERNS_AT_ONCE:
            total = PatternFilter(patterns, few[0]).counts(self.tables["shards"].drop("shard", "colex"), read_back, few[1])
        else:
            found = self._searched(sorted({r["pattern"] for r in patterns.select("pattern").collect()}))
            total = found.groupBy("gram").agg(F.sum("cnt").alias("cnt"))
        return patterns.join(total, patterns["pattern"] == total["gram"], "left").select("pattern_id", F.coalesce("cnt", F.lit(0)).cast("long").alias("occ"))

    def _searched(self, patterns: list[str]) -> DataFrame:
        """gram, cnt by shard."""
        entries = [(i, pieces(p, b)) for i, p in enumerate(patterns) for b in border_sets(p, self.lam)]
        short = [(i, p) for i, p in enumerate(patterns) if len(p) <= self.lam]
        shared = self.tables["shards"].sparkSession.sparkContext.broadcast((patterns, entries, short))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, cut, inside = shared.value
            total = np.zeros(len(own), np.int64)
            for batch in batches:
                for i in range(len(batch)):
                    own_numbers = [numbers(batch, i, c) for c in ("symbols", "lengths", "colex")]
                    total += Shard(batch["factors"][i].as_py(), *own_numbers).opened().count(cut, inside, len(own))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in some], pa.string()), pa.array(total[some], pa.int64())], names=["gram", "cnt"])

        return self.tables["shards"].select("factors", "symbols", "lengths", "colex").mapInArrow(run, "gram string, cnt long")
