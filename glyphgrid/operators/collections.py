"""Collections of texts and ordered sets: offsets, owners of positions, predecessors and successors, permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE = 1 << 16


def collection_offsets(texts: DataFrame) -> DataFrame:
    """doc_id, start, size of each text in the collection that lays all texts one after another in the order of doc_id,
    each with an end mark. Sums run inside ranges of ids, on top of the totals of smaller ranges."""
    rows = texts.select("doc_id", (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size")).withColumn("g", F.floor(F.col("doc_id") / RANGE))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of ids
    totals = rows.groupBy("g").agg(F.sum("size").alias("t")).select("g", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("g").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return own.join(totals, "g").select("doc_id", (F.col("base") + F.col("own")).cast("long").alias("start"), "size")


def owners(offsets: DataFrame, positions: DataFrame, block: int = 1 << 12) -> DataFrame:
    """positions (pos) with doc_id and the place inside: an interval join on blocks of positions."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spread = offsets.withColumn("b", F.explode(F.sequence(first, last)))
    hits = positions.withColumn("b", F.floor(F.col("pos") / block)).join(spread, "b")
    return hits.where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("size"))).select("pos", "doc_id", (F.col("pos") - F.col("start")).alias("inside"))


def neighbours_in_order(values: DataFrame, queries: DataFrame, block: int = 1 << 10) -> DataFrame:
    """queries (q) with pred, the largest value v <= q, and succ, the smallest >= q: an as-of join by blocks. Each block
    knows the nearest values of smaller and larger blocks, and a query looks into its own block only."""
    cell = values.select("v").distinct().withColumn("b", F.floor(F.col("v") / block))
    asked = queries.select("q").distinct().withColumn("b", F.floor(F.col("q") / block))
    ends = cell.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    blocks = ends.join(asked.select("b").distinct(), "b", "full")
    up, down = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    near = blocks.select("b", F.max("hi").over(up).alias("below"), F.min("lo").over(down).alias("above"))  # one row for each block
    own = asked.join(cell, "b", "left").groupBy("b", "q").agg(F.max(F.when(F.col("v") <= F.col("q"), F.col("v"))).alias("p"), F.min(F.when(F.col("v") >= F.col("q"), F.col("v"))).alias("s"))
    return own.join(near, "b").select("q", F.coalesce("p", "below").alias("pred"), F.coalesce("s", "above").alias("succ"))


def inverse_permutation(rows: DataFrame, key: str, at: str, to: str) -> DataFrame:
    """key, at, to of the inverse: places and values change roles."""
    return rows.select(key, F.col(to).alias(at), F.col(at).alias(to))


def edges_in_box(edges: DataFrame, source: str, target: str, box: tuple[int, int, int, int]) -> DataFrame:
    """Edges from one range of nodes to another."""
    a, b, c, d = box
    return edges.where(F.col(source).between(a, b) & F.col(target).between(c, d)).select(source, target)
