"""Column functions on texts, and their SQL registration."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def quoted(pattern: str) -> str:
    """A regular expression for the pattern itself."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def bordered(pattern: str) -> bool:
    """Whether occurrences of the pattern can overlap: some proper prefix is also a suffix."""
    return any(pattern.startswith(pattern[k:]) for k in range(1, len(pattern)))


def overlap_count(text: Column | str, pattern: str) -> Column:
    """Occurrences of a pattern in a text, overlapping ones included. Only a pattern that can overlap itself needs a
    look-ahead at every position; others are counted by what their removal shortens."""
    if not pattern:
        raise ValueError("an empty pattern has no count")
    column = F.col(text) if isinstance(text, str) else text
    if not bordered(pattern):
        return disjoint_count(column, pattern)
    found = F.regexp_count(column, F.lit(f"(?={quoted(pattern)})")).cast("long")
    return F.when(F.contains(column, F.lit(pattern)), found).otherwise(F.when(column.isNotNull(), F.lit(0).cast("long")))


def disjoint_count(text: Column | str, pattern: str) -> Column:
    """Occurrences that don't overlap, leftmost first."""
    column = F.col(text) if isinstance(text, str) else text
    gone = F.octet_length(column) - F.octet_length(F.replace(column, F.lit(pattern), F.lit("")))
    return F.floor(gone / len(pattern.encode())).cast("long")


def size_text(size: Column) -> Column:
    """Bytes as text with a binary unit and two decimals (halves to even)."""
    units = ((1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB"))
    out = F.concat(size.cast("string"), F.lit("B"))
    for base, name in reversed(units):
        out = F.when(size >= base, F.concat(F.format_string("%.2f", F.bround(size / base, 2)), F.lit(name))).otherwise(out)
    return out


def time_text(ns: Column) -> Column:
    """Nanoseconds as text with a unit and two decimals."""
    out = F.concat(F.format_string("%.2f", ns), F.lit("ns"))
    for base, name in ((1e3, "us"), (1e6, "ms"), (1e9, "s")):
        out = F.when(ns >= base, F.concat(F.format_string("%.2f", ns / base), F.lit(name))).otherwise(out)
    return out


def register(spark: SparkSession) -> None:
    """SQL functions overlap_count(text, pattern) and extract_range(text, start, size) as native expressions."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION overlap_count(t STRING, p STRING) RETURNS BIGINT
        RETURN CASE WHEN contains(t, p) THEN regexp_count(t, concat('(?=\\\\Q', replace(p, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E)')) ELSE 0 END""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION extract_range(t STRING, a INT, n INT) RETURNS STRING RETURN substr(t, a + 1, n)")
