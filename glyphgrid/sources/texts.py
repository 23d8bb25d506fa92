"""Texts and patterns: readers, checks and writers. A text is a row (doc_id, text); a pattern is (pattern_id, pattern)."""

from __future__ import annotations

import bz2
import gzip
import lzma
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a text of its own."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")


def text_files(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Whole files as texts, with nothing stripped (a final newline is part of a text or pattern): doc_id, path, text."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", F.decode("content", encoding).alias("text"))


def compressed_files(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Whole files packed by xz, gzip or bzip2 (by their names' ends; others are taken as they are) as texts: doc_id, path,
    text. Bytes that aren't valid in the encoding are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = {".xz": lzma.decompress, ".gz": gzip.decompress, ".bz2": bz2.decompress}
        for batch in batches:
            for i in range(len(batch)):  # one file at a time
                name, data = batch["path"][i].as_py(), batch["content"][i].as_py()
                text = next((f(data) for end, f in unpack.items() if name.endswith(end)), data).decode(encoding, "replace")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text])], names=["path", "text"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInArrow(run, "path string, text string").select(F.xxhash64("path").alias("doc_id"), "path", "text")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; a new one only on a single machine without it."""
    sc = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return at
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="glyphgrid-")


def validated(texts: DataFrame) -> DataFrame:
    """Fails on the first text with a NUL in it, when the rows are read."""
    bad = F.raise_error(F.concat(F.lit("text contains 0: doc_id "), F.col("doc_id").cast("string"))).cast("string")
    return texts.withColumn("text", F.when(F.instr("text", "\x00") > 0, bad).otherwise(F.col("text")))


def quarantined(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts without NUL, texts with one)."""
    bad = F.coalesce(F.instr("text", "\x00") > 0, F.lit(False))
    return texts.where(~bad), texts.where(bad)


def save_patterns(patterns: DataFrame, path: str) -> None:
    """A pattern collection with its provenance columns, as Parquet."""
    patterns.write.mode("overwrite").parquet(path)


def load_patterns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
