"""Pattern counts over a stream of texts (Structured Streaming)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import overlap_count


def text_stream(spark: SparkSession, path: str, name: str, per_trigger: int = 64, schema: str = "doc_id long, text string") -> DataFrame:
    """Rows (texts, if no other schema is given) of Parquet files called `name` (files, or folders of them) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(f"{path}/{name}*")


def running_counts(stream: DataFrame, patterns: list[str]) -> DataFrame:
    """pattern, occ so far: one row for each pattern as state, summed from each text's counts (complete output mode)."""
    pairs = F.array(*[F.struct(F.lit(p).alias("pattern"), F.coalesce(overlap_count("text", p), F.lit(0)).alias("n")) for p in patterns])
    return stream.select(F.inline(pairs)).groupBy("pattern").agg(F.sum("n").alias("occ"))


def windowed_counts(events: DataFrame, time: str, text: str, patterns: list[str], window: str, late: str) -> DataFrame:
    """Counts in event-time windows; texts later than `late` are left out by the watermark."""
    pairs = F.array(*[F.struct(F.lit(p).alias("pattern"), overlap_count(text, p).alias("n")) for p in patterns])
    rows = events.withWatermark(time, late).select(time, F.inline(pairs))
    return rows.groupBy(F.window(time, window).alias("window"), "pattern").agg(F.sum("n").alias("occ"))


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregate over all that is there now, and returns the table it leaves in memory (small results)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if shared := stream.sparkSession.conf.get("spark.checkpoint.dir", None):  # state must be where executors see it
        writer = writer.option("checkpointLocation", f"{shared}/glyphgrid/stream-{uuid.uuid4().hex}")
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
