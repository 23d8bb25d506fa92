"""Secret scan with multipart credential linking.

Base patterns (fixed values of the contract): assign, access, hex. The method adds parts that are weak alone:
  key_id    an access identifier: a strong `access` match, or an assignment to access_key/client_id/username/...
  material  20 or more characters of base64/hex alphabet (+ and / also percent-encoded), mixed letters and digits, not
            part of a base span or of an endpoint before its query; it may follow '=' (env lines, query strings)
  endpoint  a URL or host of a service
A secret has a scope (SCOPE code points to either side, cut at blank lines). Scopes are joined with the identifiers and
endpoints that overlap them, by bisection in sorted bounds: every part in a scope is found, and a scope has room for few.
A weak `material` span is reported only where an identifier other than itself and an endpoint overlap its scope, or an
identifier half its scope; all identifiers and endpoints in its scope are then reported too. Base `assign` and `hex` spans
are sure secrets: all identifiers and endpoints in their scope are reported.

Cases: null text is empty; a text without matches gives zero counts, the digest of an empty string, and empty spans.
Texts are scanned whole whatever their length. Every input row gives one row; extra columns aren't read.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: kinds in the order they are listed in at equal starts
KINDS = ("assign", "access", "hex", "key_id", "material", "endpoint")

SCOPE = 400
KEY_ID = re.compile(r"""(?<!secret)(?<!secret[_-])(?:access_?key(?:_?id)?|client_?id|user(?:name)?|account(?:_?(?:id|name))?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", re.I | re.A)
KEY_ID_WORDS = (b"access", b"client", b"user", b"account", b"login")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20\"'<>]+|[a-z0-9.-]+\.(?:amazonaws\.com|core\.windows\.net|googleapis\.com)\b", re.A)
ENDPOINT_WORDS = (b"://", b"amazonaws.com", b"core.windows.net", b"googleapis.com")
MATERIAL = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]|%2[BbFf]){20,}+(?:=|%3[Dd]){0,2}(?![A-Za-z0-9+/_=-])")
QUERY = re.compile(r"[?#]")
PARAGRAPH = re.compile(r"\n[\x20\t]*\n")
_HEX_CLASS = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))
_LONG_CLASS = bytes(49 if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c in b"+/_-%") else 48 for c in range(256))


def base_spans(text: str, data: bytes | None = None) -> list[tuple[int, int, str]]:
    """Spans of the three base patterns. Cheap byte tests rule out texts that can't match."""
    data = text.encode() if data is None else data
    found = []
    low = data.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in data:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if b"1" * MIN_HEX in data.translate(_HEX_CLASS):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return found


class Parts:
    """Spans of one pattern, in order: as they don't overlap each other, their starts and their ends both ascend."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.spans = spans
        self.starts, self.ends = [x[0] for x in spans], [x[1] for x in spans]

    def over(self, low: int, high: int) -> list[tuple[int, int, str]]:
        """The spans that overlap [low, high)."""
        return self.spans[bisect.bisect_right(self.ends, low) : bisect.bisect_left(self.starts, high)]


def linked(text: str, base: list[tuple[int, int, str]], data: bytes) -> list[tuple[int, int, str]]:
    """Weak parts whose scopes overlap complementary ones, and what is in the scope of sure secrets."""
    low = data.lower()
    access = Parts([x for x in base if x[2] == "access"])
    named = Parts([(m.start(1), m.end(1), "key_id") for m in KEY_ID.finditer(text)] if any(k in low for k in KEY_ID_WORDS) else [])
    sure = [x for x in base if x[2] != "access"]
    long = bool(access.spans or named.spans) and b"1" * 20 in data.translate(_LONG_CLASS)
    if not sure and not long:
        return []
    ends = Parts([(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if any(k in low for k in ENDPOINT_WORDS) else [])
    weak = materials(text, base, ends.spans) if long else []
    if not weak and not (sure and (named.spans or ends.spans)):
        return []
    cuts = [m.start() for m in PARAGRAPH.finditer(text)]

    def scope(part: tuple[int, int, str], within: int) -> tuple[int, int]:
        k = bisect.bisect_right(cuts, part[0])
        low_cut, high_cut = cuts[k - 1] if k else 0, cuts[k] if k < len(cuts) else len(text)
        return max(low_cut, part[0] - within), min(high_cut, part[1] + within)

    def identifiers(part: tuple[int, int, str], within: int) -> list[tuple[int, int, str]]:
        """All in the scope but those in the part itself."""
        return [x for own in (access, named) for x in own.over(*scope(part, within)) if x[1] <= part[0] or x[0] >= part[1]]

    out = set()
    for part in (*weak, *sure):
        who, where = identifiers(part, SCOPE), ends.over(*scope(part, SCOPE))
        if part[2] == "material":
            if not who or not where and not identifiers(part, SCOPE // 2):
                continue
            out.add(part)
        out.update(x for x in who if x[2] == "key_id")
        out.update(where)
    return sorted(out)


def materials(text: str, base: list[tuple[int, int, str]], endpoints: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Long mixed words that aren't part of a base span or of an endpoint before its query."""
    taken = sorted([(a, b) for a, b, _ in base] + [(a, q.start() if (q := QUERY.search(text, a, b)) else b) for a, b, _ in endpoints])
    first, reach, top = [a for a, _ in taken], [], 0
    for _, b in taken:
        top = max(top, b)
        reach.append(top)
    out = []
    for m in MATERIAL.finditer(text):
        a, b = m.span()
        k = bisect.bisect_left(first, b) - 1
        if (k < 0 or reach[k] <= a) and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            out.append((a, b, "material"))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, spans that linking adds)."""
    text = text or ""
    data = text.encode()
    base = base_spans(text, data)
    return base, linked(text, base, data)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base (spans written), spans (base and linked, written)."""

    def make():
        def work(batch: pa.RecordBatch):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "spans")}
            for text in batch["text"].to_pylist():
                base, more = scan_text(text)
                for k in ("assign", "access", "hex"):
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base"].append(written(base))
                out["spans"].append(written(base + more))
            yield {"doc_id": batch["doc_id"], **out}

        return work

    return by_batch(docs.select("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string", make)


def masked(text: str | None) -> str | None:
    """The text with every reported secret span replaced by a tag of its kind (overlaps merged; endpoints stay)."""
    if text is None:
        return None
    base, more = scan_text(text)
    spans = sorted((a, b, k) for a, b, k in base + more if k != "endpoint")
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked_rows(docs: DataFrame) -> DataFrame:
    """docs with every reported secret masked in text, and n_chars (if there) made the new length."""
    names = docs.columns

    def work(batch: pa.RecordBatch):
        before = batch["text"].to_pylist()
        text = [masked(t) for t in before]
        columns = dict(zip(names, batch.columns, strict=True))
        columns["text"] = text
        if "n_chars" in names:
            columns["n_chars"] = [n if t == u else len(t) for n, t, u in zip(batch["n_chars"].to_pylist(), text, before, strict=True)]
        yield columns

    return by_batch(docs, docs.schema, lambda: work)
