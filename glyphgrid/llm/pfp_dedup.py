"""Substring dedup of bytes by prefix-free parsing.

Each byte covered by a WIDTH-byte string that also starts earlier goes. Windows reach shards as `passages` says; a shard
holds distinct segments, each with its first place. There, prefix-free parsing puts all windows in corpus order:

  - a rolling hash over TRIGGER bytes, 0 modulo MODULUS, is a trigger; a phrase runs from one trigger to the end of
    the next one's bytes, so phrases overlap by TRIGGER bytes and no phrase suffix longer than that is the prefix of
    another;
  - the distinct phrases are the dictionary, sorted with the suffix array of their suffixes;
  - the parse is the text as a sequence of phrase ranks, with a suffix array of its own;
  - the order of two text suffixes is that of their phrase suffixes, and where these are the same string, that of the
    parse suffixes that follow.

Neighbours in that order that share WIDTH bytes are one string; its windows but the one that starts first are removed. A
segment's places after its first are removed whole. A highly repetitive shard costs its dictionary and its parse.

Cases: null text is empty. Texts shorter than WIDTH lose nothing. A null doc_id comes before all others; of rows with
one doc_id, the first row counts as earlier. Repeated rows: one stays. Very long texts are taken whole. Matches never
cross texts. Other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, release, windows
from .fm_dedup import by_segment, removed, verdicts
from .passages import Unit, first_rows, measured, repeated

WIDTH, GRAM = 100, 32
TRIGGER, MODULUS = 8, 24
EMPTY = hashlib.sha256(b"").hexdigest()


def ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def refined(key: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
    """Ranks of suffixes (equal ones are equal, a suffix comes before what it is a prefix of) from a key that orders
    their first `step` symbols. Prefix doubling over the groups that aren't decided: of two members or more, one of
    which goes on. left: symbols from each position to the end of its string."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    active, keys = order, key[order]
    base = np.zeros(n, np.int64)  # of the group that an active entry was in, in order
    while len(active):
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        start = base[first] + (first - np.searchsorted(base, base[first]))
        rank[active] = start[group]
        size = np.diff(np.append(first, len(active)))
        open_group = (size > 1) & (np.maximum.reduceat(left[active], first) > step)
        some = open_group[group]
        active = active[some]
        if not len(active):
            break
        base = start[group][some]
        follows = np.zeros(len(active), np.int64)
        inside = np.flatnonzero(left[active] > step)
        follows[inside] = rank[active[inside] + step] + 1
        keys = (base << 32) | follows
        again = np.argsort(keys, kind="stable")
        active, keys, base = active[again], keys[again], base[again]
        step *= 2
    return rank


def suffix_ranks(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of integer strings laid one after another."""
    return refined(symbols, left, 1)


def packed(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as numbers in byte order (zeros after the end)."""
    out = np.zeros(len(data), np.uint64)
    for k in range(min(8, len(data))):
        out[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def packed_ranks(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """suffix_ranks of byte strings, from seven bytes at a time on (with how many of them there are)."""
    have = np.minimum(left, 7).astype(np.uint64)
    key = (packed(data) >> (np.uint64(64) - np.uint64(8) * have)) << (np.uint64(64) - np.uint64(8) * have)
    return refined(key | have, left, 7)


class Parse:
    """Prefix-free parse of texts (joined bytes, first byte of each and the end)."""

    def __init__(self, data: np.ndarray, firsts: np.ndarray):
        n = len(data)
        text_end = np.repeat(firsts[1:], np.diff(firsts))
        h = windows(data.astype(np.uint64) + np.uint64(0x51), TRIGGER)
        trigger = np.zeros(n, bool)
        trigger[: len(h)] = mixed(h) % np.uint64(MODULUS) == 0
        at = np.arange(n)
        trigger &= at + TRIGGER <= text_end
        trigger[firsts[:-1][np.diff(firsts) > 0]] = True
        self.start = np.flatnonzero(trigger)
        follows = np.concatenate((self.start[1:], [n]))
        own_end = text_end[self.start]
        self.last = follows >= own_end  # of its text
        self.end = np.where(self.last, own_end, np.minimum(follows + TRIGGER, own_end))
        raw = data.tobytes()
        known: dict[bytes, int] = {}
        phrase = np.fromiter((known.setdefault(raw[a:b] + (b"\1" if z else b"\0"), len(known)) for a, b, z in zip(self.start.tolist(), self.end.tolist(), self.last.tolist(), strict=True)), np.int64, len(self.start))
        size = np.fromiter((len(p) - 1 for p in known), np.int64, len(known))
        base = np.concatenate(([0], np.cumsum(size)))
        dictionary = np.frombuffer(b"".join([p[:-1] for p in known]), np.uint8)
        left = np.repeat(base[1:], size) - np.arange(len(dictionary))
        # suffixes that end a text come before equal ones that go on
        self.dictionary = packed_ranks(dictionary, left)
        self.base, self.phrase = base[:-1], phrase
        rank = ranked(self.dictionary[self.base] * 2 + np.fromiter((p[-1] == 0 for p in known), bool, len(known)))[phrase]
        group = np.cumsum(np.concatenate(([0], self.last[:-1].astype(np.int64))))
        last_of = np.searchsorted(group, np.arange(group[-1] + 1 if len(group) else 0), side="right")
        left = last_of[group] - np.arange(len(group)) if len(group) else np.empty(0, np.int64)
        self.parse = suffix_ranks(rank, left)

    def order(self, at: np.ndarray) -> np.ndarray:
        """Text positions in corpus order, as indexes of `at`."""
        j = np.searchsorted(self.start, at, side="right") - 1
        head = self.dictionary[self.base[self.phrase[j]] + at - self.start[j]]
        follow = np.where(self.last[j], 0, np.concatenate((self.parse, [0]))[j + 1] + 1)
        return np.argsort((head << 32) | follow, kind="stable")


def same_as_before(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Whether data[at[i] : at[i] + width] equals the one at at[i - 1] (false for the first)."""
    out = np.zeros(len(at), bool)
    wide = packed(data)
    some = np.arange(1, len(at))
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        some = some[wide[at[some] + k] == wide[at[some - 1] + k]]
    out[some] = True
    return out


def shard_repeats(part: pd.DataFrame, width: int) -> pd.DataFrame:
    """seg_id and spans of the windows at a segment's first place that also start earlier."""
    part = part.sort_values(["known", "doc_id", "th", "at"], kind="stable", na_position="first")
    segs = part["seg"].tolist()
    size = np.fromiter(map(len, segs), np.int64, len(segs))
    firsts = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer(b"".join(segs), np.uint8)
    count = size - width + 1
    owner = np.repeat(np.arange(len(segs)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = firsts[owner] + offset
    order = Parse(data, firsts).order(at)
    group = np.cumsum(~same_as_before(data, at[order], width))
    # segments are in the order of their texts; inside one text a window starts at the segment's place plus its offset
    text = ranked_in_order(part[["known", "doc_id", "th"]])[owner]
    when = (text << 32) | (part["at"].to_numpy(np.int64)[owner] + offset)
    own = when[order]
    least = np.full(int(group[-1]) + 1 if len(group) else 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, own)
    again = np.sort(order[own > least[group]])
    release()
    return by_segment(part["seg_id"].to_numpy(), owner[again], offset[again])


def ranked_in_order(sorted_rows: pd.DataFrame) -> np.ndarray:
    """Number of each row's key in sorted rows."""
    new = np.zeros(len(sorted_rows), bool)
    for c in sorted_rows:
        x = sorted_rows[c]
        differ = (x != x.shift()) & ~(x.isna() & x.shift().isna())
        new |= differ.to_numpy(bool)
    return np.cumsum(new).astype(np.int64)


def repeats(docs: DataFrame, rows: DataFrame, heads: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, th, text, spans (stretches of first bytes of windows that start earlier too) of the texts that have any."""
    return repeated(docs, rows, heads, unit, lambda part: shard_repeats(part, unit.width))


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """uid, doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    unit = Unit(False, width, gram)
    rows = measured(docs, unit)
    heads = first_rows(rows)
    joined = verdicts(rows, heads, removed(repeats(docs, rows, heads, unit), unit))
    copied = (F.col("uid") != F.col("head_uid")) & (F.col("n") >= width)
    gone = F.when(copied, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    spans = F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long")
    sha = F.when(copied, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha", "sha"))
    return joined.select("uid", "doc_id", F.col("n").alias("n_bytes"), gone.alias("n_removed"), spans.alias("n_spans"), sha.alias("kept_sha256"))
