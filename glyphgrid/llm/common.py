"""Shared helpers: staged tables, Arrow mappers and vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The six ASCII white-space characters of every contract here: \x20 and \x09-\x0D (what bytes.split() cuts at).
SPACES = r"[\x20\x09-\x0D]+"

#: a staged table that comes out of a shuffle has this many files at least, and one for so many bytes of what is read for it
LEAST_FILES, FILE_BYTES = 48, 8 << 20

MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stage_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only on a single machine without the setting."""
    sc = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return at
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="glyphgrid-"))
    return sc.getCheckpointDir()


def staged_folder(spark: SparkSession) -> str:
    return f"{stage_dir(spark)}/glyphgrid/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Removes the staged tables of this application. Results that aren't written yet read from them: call it after."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(staged_folder(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str, scan: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors. Every file costs
    an executor a process or two, so a table that comes out of a shuffle of more partitions than its inputs have
    FILE_BYTES is written by fewer tasks (LEAST_FILES at least), whatever the cluster's size; scan: the table keeps its tasks."""
    spark = df.sparkSession
    path = f"{staged_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not scan:
        most = max(LEAST_FILES, bytes_read(df) // FILE_BYTES)
        if int(spark.conf.get("spark.sql.shuffle.partitions")) > most:
            df = df.coalesce(most)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_read(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, by the planner's statistics (file sizes)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(leaves.next().stats().sizeInBytes())
    return total


def by_batch(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]], rows: int = 256) -> DataFrame:
    """mapInArrow with a worker-side constructor: make() runs once a task and returns a function from a record
    batch (of `rows` rows at most, so that a worker's memory doesn't follow Spark's batch size) to dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, work = to_arrow_schema(kinds), make()
        for batch in batches:
            parts = (batch.slice(i, rows) for i in range(0, len(batch), rows))
            for columns in (c for part in parts for c in work(part)):
                yield pa.RecordBatch.from_arrays([column(columns[f.name], f.type) for f in out], schema=out)
        release()

    return df.mapInArrow(run, schema)


def column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def release() -> None:
    """Gives freed memory of a Python worker back to the system: workers outlive tasks, and what one stage used would
    otherwise stay beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def slices(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8, about `most` bytes at a time (one text at least): (index of the first, texts)."""
    start, size, held = 0, 0, []
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode()
        if held and size + len(data) > most:
            yield start, held
            start, size, held = i, 0, []
        held.append(data)
        size += len(data)
    if held:
        yield start, held


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wrapping arithmetic)."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_1
    h ^= h >> np.uint64(33)
    h *= MIX_2
    h ^= h >> np.uint64(33)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2 ** 64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


#: bytes of texts in which words are looked for at a time
WORDS_AT_ONCE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def words_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs without the six white-space characters) of texts laid one after another with a line feed
    between them: starts, ends (in the joined bytes), 64-bit hashes, and the index of the first word of each text
    (one entry more than texts)."""
    whole = b"\n".join(parts) + b"\n"
    made, at = [], 0
    while at < len(whole):
        cut = BLANK.search(whole, at + WORDS_AT_ONCE)
        end = cut.end() if cut else len(whole)
        made.append(_words(np.frombuffer(whole, np.uint8)[at:end], at))
        at = end
    starts, ends, h = made[0] if len(made) == 1 else (np.concatenate(x) for x in zip(*made, strict=True))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return starts, ends, h, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))


def _words(joined: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) > len(starts):
        ends = ends[-len(starts) :] if len(starts) else ends[:0]
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(0x51)) * powers(BASE, len(joined)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(joined))[starts]
    return starts + base, ends + base, mixed(h + (ends - starts).astype(np.uint64) * MIX_2)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive values (len(h) - n + 1 of them); order matters."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(BASE, len(h)), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * powers(BASE_INVERSE, len(h))[: len(h) - n + 1])


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = f"_{name}"
    return name


class Recent:
    """What a worker has learned, by word: two generations, so that words not used for a while are forgotten."""

    def __init__(self, most: int):
        self.most, self.known, self.older = most, {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """The words to learn; those of the older generation are known again."""
        if len(self.known) + len(words) > self.most:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        return new
