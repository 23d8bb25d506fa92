"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

A document is the set of its n-grams of SHINGLE consecutive words (as 64-bit hashes; a text of fewer words is one n-gram of
all its words). Documents with the same set are one node, so copies are never paired. BANDS bands of ROWS MinHash rows
each: a pair at similarity s shares a bucket with probability 1 - (1 - s ** ROWS) ** BANDS, 0.99995 at 0.8 (target
recall 0.9999), and 0.06 at 0.3.

Nodes of a bucket are compared by signature (one byte of each MinHash value): first with the bucket's smallest node, and,
where that fails, the ones left over with all others of their bucket, in blocks. What agrees in CLOSE or more
(5.6 standard deviations below 0.8) makes provisional clusters. Each cluster gets the texts of its nodes once, in blocks
of BLOCK nodes and GROUP_BYTES at most, and verifies every pair of its nodes on the full sets. A cluster of several blocks has a
pivot, its smallest node, which goes to every block: there each set S becomes its difference D to the pivot's set P, and
  |S & T| = |P| - |P - S| - |P - T| + |D & E|,
so that pairs of blocks need the differences alone, which are short for near copies; texts and sets aren't copied. What leaves
a block pair is one row for each node: its links and the smallest node it hangs together with. Pairs are counted, never
emitted.

Result: for each row, class_id (the smallest doc_id that verified links connect it to) and n_links (the number of
other rows at THRESHOLD or more, copies included).

Cases: a text without words (null, empty, white space) is alone, with no links. Null doc_id: class_id is the smallest
non-null doc_id of the class, null if there is none. Repeated rows are copies of each other. An empty table gives no
rows. Very long texts are taken whole. Other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, mixed, release, slices, stage, unused, windows, words_of
from .exact_dedup import without
from .graph import components

SHINGLE = 5
THRESHOLD = (4, 5)
ROWS, BANDS = 5, 25
HASHES = ROWS * BANDS
CLOSE = 0.6
BLOCK = 1024
#: rows of a task's group for buckets, bytes of text or differences of a block and of a group for verification
BUCKET_ROWS, GROUP_BYTES = 20_000, 4_000_000
#: candidate ids and bucket keys up to which their table is broadcast (16 bytes each); more are joined by shuffle
BROADCAST_IDS = 1_000_000

MULTIPLIERS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def ngram_sets(parts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    _, _, h, first = words_of(parts)
    grams = windows(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(windows(h[a:b], b - a) ^ np.uint64(b - a) if b > a else np.empty(0, np.uint64))
    return out


def set_id(own: np.ndarray) -> str | None:
    return hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=16).hexdigest() if len(own) else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, (sets, HASHES) uint32; the sets aren't empty."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((values * MULTIPLIERS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band, the band's number included."""
    wide = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.tile(mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(977)), (len(sig), 1))
    for r in range(ROWS):
        h = mixed(h ^ (wide[:, :, r] * MULTIPLIERS[r]))
    return h.view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """uid, doc_id, th (a hash of the text), size (bytes), set_id, bands, sig of every row, staged (set_id, bands, sig are null for texts without words)."""

    def make():
        def work(batch: pa.RecordBatch):
            texts = batch["text"].to_pylist()
            for start, parts in slices(texts):
                sets = ngram_sets(parts)
                some = [i for i, s in enumerate(sets) if len(s)]
                bands, sig = [None] * len(sets), [None] * len(sets)
                if some:
                    values = signatures([sets[i] for i in some])
                    for i, k, v in zip(some, band_keys(values), values.astype(np.uint8), strict=True):
                        bands[i], sig[i] = k, v.tobytes()
                end = start + len(parts)
                yield {**{c: batch[c][start:end] for c in ("uid", "doc_id", "th")}, "size": list(map(len, parts)), "set_id": [set_id(s) for s in sets], "bands": bands, "sig": sig}

        return work

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("th"), "text")
    return stage(by_batch(rows, "uid long, doc_id long, th long, size int, set_id string, bands array<long>, sig binary", make), "sketches", scan=True)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, HASHES)


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index each of 0..n-1 hangs together with, over links u-v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def close_to_first(pairs: DataFrame) -> DataFrame:
    """(node, lead, near) from (node, lead, sig, lead_sig)."""

    def make():
        def work(batch: pa.RecordBatch):
            near = agreement(sig_matrix(batch["sig"].to_pylist()), sig_matrix(batch["lead_sig"].to_pylist())) >= CLOSE if len(batch) else np.zeros(0, bool)
            yield {"node": batch["node"], "lead": batch["lead"], "near": near}

        return work

    return by_batch(pairs.select("node", "lead", "sig", "lead_sig"), "node long, lead long, near boolean", make, rows=10_000)


def bucket_links(part: pd.DataFrame) -> pd.DataFrame:
    """Edges (u, v) that span what agrees inside each bucket block of the group; left-over nodes meet all others."""
    part = part.sort_values(["key", "block", "node"]).reset_index(drop=True)
    key, block, node, rest = (part[c].to_numpy() for c in ("key", "block", "node", "rest"))
    sig = sig_matrix(part["sig"])
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
    us, vs = [], []
    for a, b in zip(first, [*first[1:], len(part)], strict=True):
        for i in np.flatnonzero(rest[a:b]) + a:
            near = np.flatnonzero(agreement(sig[a:b], sig[i]) >= CLOSE) + a
            near = near[near != i]
            us.append(np.full(len(near), i))
            vs.append(near)
    if not us or not sum(map(len, us)):
        return pd.DataFrame({"u": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="int64")})
    names, at = np.unique(node, return_inverse=True)
    label = roots(len(names), at[np.concatenate(us)], at[np.concatenate(vs)])
    moved = label != np.arange(len(names))
    return pd.DataFrame({"u": names[moved], "v": names[label[moved]]})


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, component) of all nodes in provisional clusters of two or more."""
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1")
    shared = stage(shared, "shared-keys")  # a table of its own: a key that very many nodes have can be split
    members = stage(members.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, "key"), "buckets", scan=True)
    sig = nodes.select("node", "sig")
    pairs = members.where("node <> lead").select("node", "lead").distinct().join(sig, "node").join(sig.select(F.col("node").alias("lead"), F.col("sig").alias("lead_sig")), "lead")
    judged = stage(close_to_first(pairs), "leads")
    far = judged.where(~F.col("near")).select("node", "lead", F.lit(True).alias("rest"))
    marked = members.where("n > 2").join(far, ["node", "lead"], "left").withColumn("rest", F.coalesce("rest", F.lit(False)))
    open_keys = marked.where("rest").select("key").distinct()
    inside = marked.where("node <> lead").join(open_keys, "key", "left_semi").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # a left-over node goes to every block of its bucket, any other node to its own block
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    inside = inside.withColumn("block", F.explode(F.when(F.col("rest"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))).join(sig, "node")
    inside = stage(inside.select("key", "block", "node", "rest", "sig"), "open-buckets")
    groups = max(1, inside.count() // BUCKET_ROWS)
    more = inside.withColumn("grp", F.pmod(F.xxhash64("key", "block"), F.lit(groups))).groupBy("grp").applyInPandas(bucket_links, "u long, v long")
    return components(judged.where("near").select(F.col("node").alias("u"), F.col("lead").alias("v")).unionByName(more), "clusters")


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] and sets[right], (left, right)."""
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    keep = count[col] > 1
    col, owner = (np.cumsum(count > 1) - 1)[col[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    width = int(col.max()) + 1 if len(col) else 0
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    step = max(64, (1 << 20) // max(1, len(sets)))
    for start in range(0, width, step):
        a, b = np.searchsorted(col, (start, start + step))
        x = np.zeros((len(sets), min(step, width - start)), np.float32)
        x[owner[a:b], col[a:b] - start] = 1
        out += x[left] @ x[right].T
    return out.astype(np.int64)


VERIFIED = "component long, node long, other long, links long, copies long, size int, gone int, pivot int, differs binary"


def linked(part: pd.DataFrame, both: np.ndarray, left: np.ndarray, right: np.ndarray, mirrored: bool) -> pd.DataFrame:
    """(component, node, other, links) of rows with node, copies and size, from the sizes of the intersections of left and
    right ones; mirrored: a pair counts for its right side too."""
    node, copies, size = part["node"].to_numpy(), part["copies"].to_numpy(), part["size"].to_numpy(np.int64)
    near = THRESHOLD[1] * both >= THRESHOLD[0] * (size[left][:, None] + size[right][None, :] - both)
    near &= left[:, None] != right[None, :]
    u, v = np.nonzero(near)
    links = np.zeros(len(node), np.int64)
    np.add.at(links, left[u], copies[right[v]])
    if mirrored:
        np.add.at(links, right[v], copies[left[u]])
    label = roots(len(node), left[u], right[v])
    smallest = pd.Series(node).groupby(label).transform("min").to_numpy()
    return part[["component", "node"]].assign(other=smallest, links=links)[links > 0]


def verified(part: pd.DataFrame) -> pd.DataFrame:
    """From the texts of cluster blocks: exact links of the nodes of a cluster that is one block, and the differences to
    the pivot of the others."""
    out = [pd.DataFrame({k.split()[0]: [] for k in VERIFIED.split(", ")})]
    for _, own in part.groupby(["component", "block"], sort=False):
        sets = []
        for _, parts in slices(own["text"].tolist()):
            sets += ngram_sets(parts)
        # a text of another set can share doc_id and hash: it goes before repeated nodes do
        good = np.flatnonzero([set_id(s) == k for s, k in zip(sets, own["set_id"], strict=True)])
        good = good[~own["node"].iloc[good].duplicated().to_numpy()]
        own, sets = own.iloc[good].reset_index(drop=True), [sets[g] for g in good]
        own["size"] = list(map(len, sets))
        every = np.arange(len(own))
        if own["blocks"].iloc[:1].eq(1).all():
            out.append(linked(own, common_counts(sets, every, every), every, every, False))
            continue
        pivot = sets[int(np.flatnonzero(own["node"] == own["pivot"])[0])]
        own["differs"] = [np.setxor1d(s, pivot, assume_unique=True).tobytes() for s in sets]
        own["gone"] = [len(pivot) - len(np.intersect1d(s, pivot, assume_unique=True)) for s in sets]
        own["pivot"] = len(pivot)
        out.append(own[~own["extra"]][["component", "node", "copies", "size", "gone", "pivot", "differs"]])
    del part
    release()
    return pd.concat(out)[[k.split()[0] for k in VERIFIED.split(", ")]].astype({k.split()[0]: "Int64" for k in VERIFIED.split(", ")[:-1]})


def verified_pairs(part: pd.DataFrame) -> pd.DataFrame:
    """(component, node, other, links) from the differences of pairs of blocks."""
    out = [pd.DataFrame({k: pd.Series([], dtype="int64") for k in ("component", "node", "other", "links")})]
    for (_, low, high), own in part.groupby(["component", "low", "high"], sort=False):
        block, gone = own["block"].to_numpy(), own["gone"].to_numpy(np.int64)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if len(left) and len(right):
            both = common_counts([np.frombuffer(d, np.uint64) for d in own["differs"]], left, right)
            both += int(own["pivot"].iloc[0]) - gone[left][:, None] - gone[right][None, :]
            out.append(linked(own.reset_index(drop=True), both, left, right, low != high))
    del part
    release()
    return pd.concat(out)


def sized_blocks(members: DataFrame, size: str) -> DataFrame:
    """members with blocks and block of their cluster: BLOCK nodes and about GROUP_BYTES of `size` each at most."""
    sizes = members.groupBy("component").agg(F.min("node").alias("least"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(size) / GROUP_BYTES)).cast("int").alias("blocks"))
    sizes = stage(sizes, "cluster-sizes")  # a table of its own: a very large cluster can be split
    few = sizes.count() <= BROADCAST_IDS
    return members.join(F.broadcast(sizes) if few else sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def in_groups(rows: DataFrame, size: str, *key: str) -> DataFrame:
    """rows grouped for tasks, about GROUP_BYTES of `size` each, the rows of one key together."""
    total = rows.agg(F.sum(F.col(size).cast("long"))).first()[0] or 0
    return rows.withColumn("grp", F.pmod(F.xxhash64(*key), F.lit(max(1, total // GROUP_BYTES)))).groupBy("grp")


def links_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(component, node, other, links) of the nodes of clusters: other hangs together with node."""
    members = stage(sized_blocks(members, "size"), "members")
    at = F.when((F.col("node") == F.col("least")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    placed = members.select("component", "node", "set_id", "first", "copies", "blocks", F.col("least").alias("pivot"), F.col("block").alias("own"), F.col("size").alias("bytes"), F.explode(at).alias("block"))
    placed = placed.withColumn("extra", F.col("own") != F.col("block")).drop("own")
    groups = max(1, (placed.agg(F.sum(F.col("bytes").cast("long"))).first()[0] or 0) // GROUP_BYTES)
    texts = fetched(docs, placed).withColumn("grp", F.pmod(F.xxhash64("component", "block"), F.lit(groups)))
    texts = texts.select("grp", "component", "block", "blocks", "node", "pivot", "extra", "set_id", "copies", "text")
    exact = stage(texts.groupBy("grp").applyInPandas(verified, VERIFIED), "verified", scan=True)
    links = exact.where("other is not null").select("component", "node", "other", "links")
    apart = exact.where("differs is not null").select("component", "node", "copies", "size", "gone", "pivot", "differs", (F.length("differs") + 64).alias("bytes"))
    if apart.isEmpty():
        return links
    apart = sized_blocks(apart, "bytes")
    apart = apart.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart = apart.select("component", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "copies", "size", "gone", "pivot", "differs", "bytes")
    more = in_groups(apart, "bytes", "component", "low", "high").applyInPandas(verified_pairs, "component long, node long, other long, links long")
    return links.unionByName(stage(more, "links", scan=True))


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (with first: doc_id, uid and th) with the texts of its rows: one for each, but for texts of one doc_id whose hashes clash."""
    small = wanted.count() <= BROADCAST_IDS
    ids = wanted.select(F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__key")).distinct()
    texts = docs.select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__th"), "text")
    same = texts["__doc"].eqNullSafe(ids["__id"]) & (texts["__th"] == ids["__key"])
    texts = texts.join(F.broadcast(ids) if small else ids, same, "left_semi").distinct()
    return wanted.join(texts, wanted["first.doc_id"].eqNullSafe(texts["__doc"]) & (wanted["first.th"] == texts["__th"])).drop("__doc", "__th")


def join(docs: DataFrame) -> DataFrame:
    """uid, doc_id, th, class_id, n_links, kept (one row of each class) of every row."""
    rows = sketched(docs)
    nodes = rows.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid", "th")).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.max("size").alias("size"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = clusters(nodes)
    exact = links_of(docs, found.join(nodes.select("node", "set_id", "first", "copies", "size"), "node"))
    classes = components(exact.select(F.col("node").alias("u"), F.col("other").alias("v")), "classes")
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = nodes.select("node", "set_id", "first", "copies").join(links, "node", "left").join(classes, "node", "left")
    nodes = stage(nodes.select("set_id", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("class")), "linked")
    firsts = nodes.groupBy("class").agg(F.min("first").alias("head"))
    nodes = nodes.join(firsts, "class").select("set_id", "head", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    named = rows.select("uid", "doc_id", "th", "set_id").where("set_id is not null").join(nodes, "set_id")
    named = named.select("uid", "doc_id", "th", F.col("head.doc_id").alias("class_id"), "n_links", (F.col("uid") == F.col("head.uid")).alias("kept"))
    alone = rows.where("set_id is null").select("uid", "doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return named.unionByName(alone)


def kept_rows(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns; rows that repeat both doc_id and text stay or go together."""
    found = stage(join(docs), "near")
    stays = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    gone = found.where(~F.col("kept"))
    gone = gone.join(stays, gone["doc_id"].eqNullSafe(stays["__id"]) & (gone["th"] == stays["__th"]), "left_anti")
    mark = unused("th", docs)
    return without(docs.withColumn(mark, F.xxhash64("text")), gone, mark, "th").drop(mark)
