"""Patterns and synthetic texts: deterministic sampling, mutation, length sweeps, repetitive sequences, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a linear congruential step (fixed values), the same in any SQL engine with 64-bit integers
STEP, SHIFT = 1103515245, 12345


def drawn(i: Column, size: Column) -> Column:
    """A number from 0 to size - 1 that follows from i alone."""
    return F.pmod(i * F.lit(STEP).cast("long") + SHIFT, size)


def sample(texts: DataFrame, size: int) -> DataFrame:
    """One pattern of `size` characters from every text that is long enough: pattern_id, doc_id, begin, pattern."""
    rows = texts.where(F.length("text") >= size)
    rows = rows.withColumn("begin", drawn(F.col("doc_id"), (F.length("text") - size + 1).cast("long")))
    return rows.select(F.col("doc_id").alias("pattern_id"), "doc_id", "begin", F.substr("text", (F.col("begin") + 1).cast("int"), F.lit(size)).alias("pattern"))


def sweep(texts: DataFrame, low: int, high: int) -> DataFrame:
    """Patterns of lengths 2 ** low .. 2 ** high from every text: pattern_id, doc_id, size, begin, pattern."""
    sizes = F.explode(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda p: F.pow(F.lit(2), p).cast("int")))
    rows = texts.withColumn("size", sizes).where(F.length("text") >= F.col("size"))
    rows = rows.withColumn("begin", drawn(F.col("doc_id") + F.col("size"), (F.length("text") - F.col("size") + 1).cast("long")))
    return rows.select((F.col("doc_id") * 1024 + F.col("size")).alias("pattern_id"), "doc_id", F.col("size").cast("long").alias("size"), "begin", F.substr("text", (F.col("begin") + 1).cast("int"), F.col("size")).alias("pattern"))


def mutated(patterns: DataFrame) -> DataFrame:
    """patterns with two characters swapped: swap_l < swap_r follow from pattern_id (patterns of one character stay)."""
    n = F.length("pattern").cast("long")
    a, b = drawn(F.col("pattern_id"), n), drawn(F.col("pattern_id") + 7, n)
    rows = patterns.withColumn("swap_l", F.least(a, b)).withColumn("swap_r", F.greatest(a, b))
    p, left, right = F.col("pattern"), F.col("swap_l").cast("int"), F.col("swap_r").cast("int")
    part = lambda at, size: F.substr(p, at, size)
    one = F.lit(1)
    swapped = F.concat(part(one, left), part(right + 1, one), part(left + 2, right - left - 1), part(left + 1, one), F.substr(p, right + 2))
    return rows.withColumn("mutant", F.when(left == right, p).otherwise(swapped))


def repetitive_dna(spark: SparkSession, size: int, copies: int, rate: int, seed: int) -> DataFrame:
    """copy, text: a base (copy 0) and copies of it in which `rate` percent of the positions are mutated: substituted on
    an odd draw, deleted on an even one. Every copy derives from the base; rows are made and joined on executors."""
    letters = F.array(*[F.lit(c) for c in "ACGT"])
    rows = spark.range(size * (copies + 1)).select(F.pmod("id", F.lit(size)).alias("pos"), F.floor(F.col("id") / size).alias("copy"))
    base = letters[F.pmod(F.floor(drawn(F.col("pos") * 7919 + seed, F.lit(1 << 30)) / 1024), F.lit(4)).cast("int")]
    die = F.floor(drawn(F.col("pos") * 104729 + F.col("copy") * 1299709 + seed, F.lit(1 << 30)) / 1024).cast("long")
    hit = (F.col("copy") > 0) & (F.pmod(die, F.lit(100)) < rate)
    odd = F.pmod(F.floor(die / 100), F.lit(2)) == 1
    other = letters[F.pmod(F.floor(die / 200), F.lit(4)).cast("int")]
    rows = rows.select("copy", "pos", F.when(~hit, base).otherwise(F.when(odd, other).otherwise(F.lit(""))).alias("ch"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "")
    return rows.groupBy("copy").agg(joined.alias("text"))


def prefixes(texts: DataFrame, size: int) -> DataFrame:
    return texts.select("doc_id", F.left("text", F.lit(size)).alias("prefix"))
