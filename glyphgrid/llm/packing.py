"""Cost-balanced packing of tokenised documents into sequences.

The cost of a piece of n tokens is LINEAR * n + QUADRATIC * n * n (attention inside the piece). Whole multiples of the
sequence length become sequences of their own where the document is tokenised; what is left of each document goes to
one of many groups (by a hash of doc_id, text and row number, so that rows of one or no doc_id spread; about GROUP_BYTES of
text each), and each group packs on its own: pieces in
descending length, each to the lowest-cost sequence with room for it; a piece that fits nowhere is cut at the room of
the lowest-cost sequence that has any. A group opens ceil(tokens / length) sequences, so it pads less than one.

Token ids come from the tokenizers library. Words are encoded once for each worker and kept (bounded); texts outside
Latin-1, or with the string of an added token in them, are given to the library whole.

Cases: null and empty text are one id, the end id. Null doc_id is packed like any other. Repeated rows are packed each
on their own. Very long texts give many whole pieces. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, by_batch, release

LENGTH = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_BYTES = 3_000_000
KEPT_WORDS = 200_000
ROWS_AT_ONCE = 128

#: Letters and numbers of Latin-1 in lower-cased text, as the tokenizer's own split pattern has them.
_LETTERS, _NUMBERS, _BLANK = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ", "0-9²³¹¼½¾", "\\x09-\\x0d\\x20\\x85\\xa0"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANK}{_LETTERS}{_NUMBERS}]+")


class WordTokens:
    """Token ids of texts as little-endian bytes, two a token if the vocabulary allows it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.learned = Recent(KEPT_WORDS)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> None:
        new = self.learned.missing(words)
        known = self.learned.known
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):  # each word ends in a token of the end of a word
                data, step = ids.tobytes(), self.kind.itemsize
                at = [0, *(cuts * step).tolist()]
                known.update(zip(some, [data[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
            else:
                for w in some:
                    known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; new words of all of them are learned together."""
        words: list[list[str] | None] = []
        for text in texts:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                words.append(None)
            else:
                words.append(None if any(a in text for a in self.added) else WORDS.findall(text.lower()))
        self.learn(set().union(*filter(None, words)))
        known, whole = self.learned.known, lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind).tobytes()
        return [whole(t) if own is None else b"".join([known[w] for w in own]) for t, own in zip(texts, words, strict=True)]


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for each worker process, for all its tasks."""
    return WordTokens(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECES = "grp int, doc_id long, start long, length long, doc_tokens long, ids binary, crc long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, path: str, groups: int, length: int, end_id: int) -> DataFrame:
    def make():
        tokens = word_tokens(path)

        def work(batch: pa.RecordBatch):
            out = {k.split()[0]: [] for k in PIECES.split(", ")}
            for first in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                cells = zip(part["grp"].to_pylist(), part["doc_id"].to_pylist(), tokens.encode(part["text"].to_pylist()), strict=True)
                for grp, doc_id, data in cells:
                    own = np.append(np.frombuffer(data, tokens.kind), tokens.kind.type(end_id))
                    for start in range(0, len(own), length):
                        piece = own[start : start + length]
                        whole = len(piece) == length
                        row = (grp, doc_id, start, len(piece), len(own), None if whole else piece.tobytes(), crc(piece) if whole else None)
                        for name, v in zip(out, row, strict=True):
                            out[name].append(v)
                if len(out["grp"]) >= 2000:
                    yield out
                    out = {k: [] for k in out}
            yield out

        return work

    grp = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    return by_batch(docs.select(grp.alias("grp"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), PIECES, make)


def assign(lengths: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, tokens, sequence, offset) for pieces given in descending length."""
    total = int(lengths.sum())
    bins = -(-total // length)
    room, cost = np.full(bins, length, np.int64), np.zeros(bins)
    out = []
    for i, n in enumerate(lengths.tolist()):
        start = 0
        while start < n:
            left = n - start
            fits = room >= left
            if not fits.any():
                fits = room > 0
            k = int(np.where(fits, cost, np.inf).argmin())
            take = min(left, int(room[k]))
            out.append((i, start, take, k, length - int(room[k])))
            room[k] -= take
            cost[k] += LINEAR * take + QUADRATIC * take * take
            start += take
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pieces (PACKED) of all documents; sequence ids are unique, not dense."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        base = int(part["grp"].iloc[0]) << 32
        whole = part[part["ids"].isna()]
        rest = part[part["ids"].notna()].reset_index(drop=True)
        rows = [(d, s, n, c, t, base + i, 0) for i, (d, s, n, c, t) in enumerate(zip(whole["doc_id"], whole["start"], whole["length"], whole["crc"], whole["doc_tokens"], strict=True))]
        ids = [np.frombuffer(b, kind) for b in rest["ids"]]
        cells = list(zip(rest["doc_id"], rest["start"], rest["doc_tokens"], strict=True))
        for i, start, n, k, offset in assign(rest["length"].to_numpy(), length):
            doc, first, tokens = cells[i]
            rows.append((doc, first + start, n, crc(ids[i][start : start + n]), tokens, base + len(whole) + k, offset))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])
        release()
        return out.astype({c: "Int64" for c in out.columns})

    return tokenised(docs, path, groups, length, end_id).groupBy("grp").applyInPandas(one, PACKED)
