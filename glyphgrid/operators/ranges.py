"""Range queries: orthogonal counts, quantiles, symbols of ranges, neighbours, minima, top-k and adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_count_2d(points: DataFrame, key: str, x: str, y: str, box: tuple[Column, Column, Column, Column]) -> DataFrame:
    """key, n: points with x and y inside a closed box (bounds may be columns of the points)."""
    x_low, x_high, y_low, y_high = box
    return points.groupBy(key).agg(F.count_if(F.col(x).between(x_low, x_high) & F.col(y).between(y_low, y_high)).alias("n"))


def quantile(rows: DataFrame, key: str, order: list[str], k: Column, value: str) -> DataFrame:
    """key, value of the k-th row (from 1) of each key in an order."""
    nth = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return nth.where(F.col("__n") == k).select(key, value)


def interval_symbols(rows: DataFrame, key: str, symbol: str) -> DataFrame:
    return rows.groupBy(key, symbol).agg(F.count("*").alias("freq"))


def lex_count(rows: DataFrame, key: str, symbol: str, than: Column) -> DataFrame:
    """key, smaller, greater: rows with a smaller and with a greater symbol."""
    return rows.groupBy(key).agg(F.count_if(F.col(symbol) < than).alias("smaller"), F.count_if(F.col(symbol) > than).alias("greater"))


def intersect(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct values that both sides have, with how often each side has them."""
    a = left.groupBy(*on).agg(F.count("*").alias("n_left"))
    return a.join(right.groupBy(*on).agg(F.count("*").alias("n_right")), on)


def pred_succ(values: DataFrame, key: str, value: str, at: list) -> DataFrame:
    """key, q, pred (largest value <= q), succ (smallest >= q) for a short list of q."""
    sums = [x for i, q in enumerate(at) for x in (F.max(F.when(F.col(value) <= q, F.col(value))).alias(f"p{i}"), F.min(F.when(F.col(value) >= q, F.col(value))).alias(f"s{i}"))]
    one = values.groupBy(key).agg(*sums)
    return one.select(key, F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"p{i}").alias("pred"), F.col(f"s{i}").alias("succ")) for i, q in enumerate(at)])))


def range_minimum(points: DataFrame, pos: str, value: str, ranges: DataFrame, block: int = 256) -> DataFrame:
    """ranges (range_id, l, r) with the position of the smallest value (the first on ties): whole blocks are answered from
    their own minima, only the two ends from points. Both joins are on block numbers."""
    least = F.min(F.struct(F.col(value).alias("v"), F.col(pos).alias("p")))
    cell = points.select(F.floor(F.col(pos) / block).alias("b"), F.col(pos).alias(pos), F.col(value).alias(value))
    minima = cell.groupBy("b").agg(least.alias("m"))
    lo, hi = F.floor(F.col("l") / block), F.floor(F.col("r") / block)
    inner = ranges.where(hi - lo > 1).select("range_id", F.explode(F.sequence(lo + 1, hi - 1)).alias("b")).join(minima, "b").select("range_id", "m")
    ends = ranges.select("range_id", "l", "r", F.explode(F.array_distinct(F.array(lo, hi))).alias("b")).join(cell, "b")
    ends = ends.where(F.col(pos).between(F.col("l"), F.col("r"))).groupBy("range_id").agg(least.alias("m"))
    return inner.unionByName(ends).groupBy("range_id").agg(F.min("m").alias("m")).select("range_id", F.col("m.p").alias("argmin"), F.col("m.v").alias("minimum"))


def top_k(points: DataFrame, inside: Column, weight: str, ties: list[str], k: int) -> DataFrame:
    """The k heaviest points inside a region; ties by the given columns."""
    return points.where(inside).orderBy(F.col(weight).desc(), *ties).limit(k)


def neighbours(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, degree, first and last neighbour along edges; swap source and target for the reverse."""
    return edges.groupBy(F.col(source).alias("node")).agg(F.count("*").alias("degree"), F.min(target).alias("first"), F.max(target).alias("last"))


def adjacent(edges: DataFrame, source: str, target: str, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with whether an edge a-b is there."""
    own = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct().withColumn("is_edge", F.lit(True))
    return pairs.join(own, ["a", "b"], "left").select("a", "b", F.coalesce("is_edge", F.lit(False)).alias("is_edge"))
