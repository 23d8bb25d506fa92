"""Statistics and reports: entropy, space, text parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .count import gram_counts


def entropy(texts: DataFrame, order: int) -> DataFrame:
    """k, entropy: empirical k-th order entropy in bits of a character given the k before it, over all texts."""
    grams = gram_counts(texts, order + 1).withColumn("context", F.left("gram", F.lit(order)))
    context = grams.groupBy("context").agg(F.sum("cnt").alias("n"))
    bits = F.sum(F.col("cnt") * F.log2(F.col("n") / F.col("cnt"))) / F.sum("cnt")
    return grams.join(context, "context").agg(F.round(bits, 6).alias("entropy")).select(F.lit(order).cast("long").alias("k"), "entropy")


def space_report(tables: dict[str, DataFrame]) -> DataFrame:
    """component, bytes of the string columns of tables, with a total (component null)."""
    rows = None
    for name, df in tables.items():
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0))
        one = df.agg(F.sum(size.cast("long")).alias("bytes")).select(F.lit(name).alias("component"), "bytes")
        rows = one if rows is None else rows.unionByName(one)
    return rows.rollup("component").agg(F.sum("bytes").alias("bytes"))
