"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

Words (the pieces of the tokenizer's pre-split) are encoded once for each worker. A set of new words is put in byte
order, which is the depth-first order of their trie: the stack of the walk has, for each prefix on the path, the last
token of that prefix's encoding, and a word only works out the states below the prefix that it shares with the word
before it. The last token of a prefix is the longest vocabulary suffix whose join with the state before it is stable: no
merge across the border of the two tokens comes before the merges that build them. Following the last tokens back
gives the encoding. Decoding goes from the ids of a whole text: their bytes are gathered from a table of all tokens' bytes
in numpy and read as UTF-8 (what isn't is replaced, as the library does).

Merges are tried in the order of the vocabulary, lowest rank first and leftmost first, as the tokenizers library does.
Strings of added tokens are matched in the raw text first, as the library does by default.

Cases: null and empty text give no ids. Texts outside Latin-1 are split by the library's own pre-tokenizer (its Unicode
tables decide), Latin-1 texts by the same pattern. Texts are encoded whole; every row gives one row; other columns
aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Recent, by_batch

#: The split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 200_000
ROWS_AT_ONCE = 256
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        letters = byte_letters()
        vocab = own["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in own["added_tokens"]}
        raw = {bytes(letters[c] for c in k): v for k, v in vocab.items() if k not in self.added}
        self.bytes_of = {v: k for k, v in raw.items()} | {v: k.encode() for k, v in self.added.items()}
        self.longest = max(map(len, raw))
        #: the bytes of all tokens one after another, where each one's begin, and how many they are
        top = max(self.bytes_of) + 1
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.length = np.fromiter((len(self.bytes_of.get(i, b"")) for i in range(top)), np.int64, top)
        self.begin = np.cumsum(self.length) - self.length
        #: rank of a token: the number of the merge that makes it; single bytes come before all merges
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for n, m in enumerate(own["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault((left, right), n)
            if both not in self.parts:
                self.parts[both], self.rank[both] = (left, right), n
        self.tokens = {k: v for k, v in raw.items() if len(k) == 1 or v in self.parts}
        self.size = {v: len(k) for k, v in self.tokens.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.split = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        #: ids of words: decimal ones joined by commas, and as 32-bit numbers
        self.learned = Recent(KEPT_WORDS)

    def joins(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode as a, b. Walks back in time along a's right edge and b's left
        edge; x and y are the tokens next to the border, due_x and due_y the merges that use them up."""
        x, y, due_x, due_y = a, b, NEVER, NEVER
        rank, parts, pairs = self.rank, self.parts, self.pairs
        while True:
            m = pairs.get((x, y))
            if m is not None and m < due_x and m <= due_y:
                return False
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x, due_x = parts[x][1], rx
            else:
                y, due_y = parts[y][0], ry

    def alone(self, t: int) -> bool:
        """Whether a token's own bytes encode as that token."""
        if (known := self.whole.get(t)) is None:
            if t not in self.parts:
                known = True
            else:
                left, right = self.parts[t]
                known = self.alone(left) and self.alone(right) and self._made(left, right, self.rank[t])
            self.whole[t] = known
        return known

    def _made(self, left: int, right: int, due: int) -> bool:
        """Whether left and right stay whole beside each other until merge number `due` joins them."""
        x, y, due_x, due_y = left, right, due, due
        while True:
            m = self.pairs.get((x, y))
            if m is not None and m < due_x and m <= due_y and m != due:
                return False
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x, due_x = self.parts[x][1], rx
            else:
                y, due_y = self.parts[y][0], ry

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words in byte order."""
        tokens, stable, longest, size = self.tokens, self.stable, self.longest, self.size
        last: list[int] = [-1]
        out, before = [], b""
        for word in words:
            n = len(word)
            k, most = 0, min(n, len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :]
            for end in range(k + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    t = tokens.get(word[start:end])
                    if t is None:
                        continue
                    if start == 0:
                        if self.alone(t):
                            break
                        continue
                    pair = (last[start], t)
                    good = stable.get(pair)
                    if good is None:
                        good = stable[pair] = self.alone(t) and self.joins(*pair)
                    if good:
                        break
                else:
                    raise ValueError(f"no encoding of {word!r}")
                last.append(t)
            ids, at = [], n
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            out.append(ids[::-1])
            before = word
        if len(stable) > 4_000_000:
            stable.clear()
        return out

    def decode(self, ids: np.ndarray) -> str:
        size = self.length[ids]
        end = np.cumsum(size)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.begin[ids] - end + size, size)
        return self.blob[at].tobytes().decode("utf-8", "replace")

    def learn(self, words: set[str]) -> None:
        new = sorted([w.encode() for w in self.learned.missing(words)])
        for word, ids in zip(new, self.encode_words(new), strict=True):
            self.learned.known[word.decode()] = ",".join(map(str, ids)), np.array(ids, np.int32).tobytes()

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return self.split.findall(text)

    def encode_all(self, texts: list[str]) -> list[tuple[str, np.ndarray]]:
        """Of each text: decimal ids joined by commas, and the ids. The new words of all texts are learned in one walk of
        their trie."""
        parts: list[list[list[str] | str]] = []  # words of a stretch, or an added token
        for text in texts:
            if self.cut and any(a in text for a in self.added):
                parts.append([own if i % 2 else self.words(own) for i, own in enumerate(self.cut.split(text))])
            else:
                parts.append([self.words(text)])
        self.learn({w for own in parts for words in own if not isinstance(words, str) for w in words})
        known, out = self.learned.known, []
        for own in parts:
            cells = [c for x in own for c in ([known[w] for w in x] if not isinstance(x, str) else [(str(self.added[x]), np.int32(self.added[x]).tobytes())])]
            out.append((",".join([a for a, _ in cells]), np.frombuffer(b"".join([b for _, b in cells]), np.int32)))
        return out

    def encode(self, text: str) -> tuple[str, str]:
        """Ids joined by commas, and the text that they decode to."""
        written, ids = self.encode_all([text])[0]
        return written, self.decode(ids)


@functools.lru_cache(maxsize=1)
def trie_bpe(path: str) -> TrieBpe:
    """One for each worker process, for all its tasks."""
    return TrieBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas), decoded text of every row."""
    return _encoded(docs, path, digests=False)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Like encode, with sha256 digests in place of ids and text, so that these don't leave the worker."""
    return _encoded(docs, path, digests=True)


def _encoded(docs: DataFrame, path: str, digests: bool) -> DataFrame:
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def make():
        bpe = trie_bpe(path)

        def work(batch: pa.RecordBatch):
            for first in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                made = bpe.encode_all([t or "" for t in part["text"].to_pylist()])
                shown = (lambda x: hashlib.sha256(x.encode()).hexdigest()) if digests else str
                yield {"doc_id": part["doc_id"], "n_tokens": [len(ids) for _, ids in made], names[0]: [shown(w) for w, _ in made], names[1]: [shown(bpe.decode(ids)) for _, ids in made]}

        return work

    return by_batch(docs.select("doc_id", "text"), f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string", make)
