"""Main-text extraction from HTML: parser events, text-to-tag ratio, Gaussian smoothing, threshold clustering.

The standard-library parser streams events. Every piece of text is kept with the element it stands in, and what stands in
a boilerplate element goes piece by piece, inline parts of a paragraph included. A block element starts and ends a line;
`br` is white space inside its line. For each line the text length outside links and the number of tags since the line
before (of blocks; inline ones format a text and speak neither for nor against it) give a text-to-tag ratio. The ratios are smoothed with a Gaussian kernel; stretches over a threshold (a share of the
standard deviation), cut back at both ends to lines that reach it by themselves, are the content clusters.

What is main text:
  - where article elements hold most of the clusters' text: these elements whole, but for articles inside or beside that
    are mostly outside clusters (comments), and an h1 before them if they have none;
  - else, inside the main element or on the whole page, the clusters decide line by line. With a line in a cluster go
    short lines of its kind (paragraphs, items, cells under one parent that are mostly in clusters), lists, tables and the
    like beside it that aren't mostly links, headings whose next line stays, up to BYLINES lines between an h1 and the
    text, and short headed sections in or beside an element around the text. Comments go from their heading to the end of its parent; a copyright line at the page's end goes.

Boilerplate elements: by tag (nav, footer, aside, form, script, style, ...; header outside an article), by role, or by a
word of class or id (menu, sidebar, advert, cookie, comment, ...); hidden elements too. A form, header, role or word doesn't
make boilerplate of an element around the page's article or main element, or around most of the page's text.

Cases: null or empty html gives an empty string, as does a page without a text line. If all lines are boilerplate the
text is empty. Unclosed or stray tags are allowed, in time linear in the page: an end tag closes the nearest open element
of its name, an inline one only inside its block, cells keep ends inside. Very long pages are parsed whole. Repeated rows
and null keys are kept as they are; other columns aren't read.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

SIGMA = 1.0
#: shares of the ratios' standard deviation: smoothed ratios over the first make a stretch, which is cut back at both ends
#: to lines with a ratio of their own over the second
THRESHOLD, OWN = 0.5, 1.0
#: an element marked by form, header, role or a word of layout isn't boilerplate if it holds over MOST of the page's text
#: outside links (one marked by a word of FOREIGN: at least HOLDS)
MOST, HOLDS = 0.5, 0.95
#: lines between a heading and the text
BYLINES = 3

#: Names of elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
SKIPPED = frozenset("head title nav footer aside script style noscript template iframe object embed svg canvas button select textarea input label menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist respond disqus reply replies discussion footer toolbar pagination pager skip tracking".split())
#: those of MARKS that name texts of others, which may be longer than the page's own and hold articles
FOREIGN = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe subscription signup login related recommended comment comments commentlist respond disqus reply replies discussion".split())
#: boilerplate only outside an article or main element, where they name its head
OUTER_MARKS = frozenset("header masthead branding".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
LISTS, CELLS, ROWS = frozenset("ul ol menu dir dl".split()), frozenset("td th caption".split()), frozenset("tr tbody thead tfoot".split())
#: what runs beside paragraphs as part of a text, and lines of which go with those of their kind
RUNNING = frozenset("p ul ol dl blockquote pre table figure".split())
ALIKE = frozenset("p li dd dt td th blockquote pre".split())
NONE, LAYOUT, OTHERS, HARD = range(4)
CLASS_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
COMMENT_END = re.compile(r"--!?>|--\s+>")
BLANK = re.compile(r"\s+")
COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader |user |recent |all )?(?:comments?|repl(?:y|ies)|responses?|leave a (?:comment|reply)|join the (?:conversation|discussion)|(?:leser)?kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?[\s:.!]*", re.I)
COPYRIGHT = re.compile(r"(?:©|\(c\)\s|copyright\b)", re.I)
#: a paragraph's end is implied by these starts
CLOSES_P = BLOCKS - {"body", "html", "head", "title"} - CELLS - ROWS
HIDING = re.compile(r"display:none|visibility:hidden")


class Lines(HTMLParser):
    """Collects lines and pieces of text: (line, element, text, in a link). Elements are numbered from 0 (the page) in
    the order of their starts; `blocks` has the block element that each line started in, `tags` the tags before it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents, self.kinds, self.marks = [0], [""], [NONE]
        self.stack = [0]
        #: places in the stack of the open elements of each name, of blocks, and of what keeps end tags inside
        self.open: dict[str, list[int]] = {}
        self.open_blocks, self.fences = [0], [0]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self.blocks: list[int] = []
        self.tags: list[int] = []
        self.line_open = self.in_link = False
        self.count = self.hard = self.articles = 0

    def last(self, *names: str) -> int:
        """The highest place in the stack of an open element of these names (0: none)."""
        return max((own[-1] for n in names if (own := self.open.get(n))), default=0)

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            e = self.stack.pop()
            name, at = self.kinds[e], len(self.stack)
            self.open[name].pop()
            self.hard -= self.marks[e] == HARD
            self.articles -= name in ("article", "main")
            if self.open_blocks[-1] == at:
                self.open_blocks.pop()
            if self.fences[-1] == at:
                self.fences.pop()
            if name == "a":
                self.in_link = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open.get("head") and tag not in IN_HEAD:
            self.pop_to(self.last("head"))
        block = tag in BLOCKS
        if block and not self.hard:
            self.line_open = False
        if tag == "br" and self.line_open and not self.hard:
            self.pieces.append((len(self.blocks) - 1, self.stack[-1], " ", self.in_link))
        self.implied(tag)
        self.count += block and not self.hard
        if tag in VOID or tag in ("html", "body") and self.open.get(tag):
            return
        mark = self.boilerplate(tag, attrs)
        e, at = len(self.parents), len(self.stack)
        self.parents.append(self.stack[-1])
        self.kinds.append(tag)
        self.marks.append(mark)
        self.stack.append(e)
        self.open.setdefault(tag, []).append(at)
        if block:
            self.open_blocks.append(at)
        if tag in CELLS or tag == "table":
            self.fences.append(at)
        self.hard += mark == HARD
        self.articles += tag in ("article", "main")
        self.in_link = self.in_link or tag == "a"

    def implied(self, tag: str) -> None:
        """Ends that a start tag implies."""
        if tag in CLOSES_P and (at := self.last("p")) > self.fences[-1]:
            self.pop_to(at)
        if tag in ("li", "dd", "dt"):
            at = self.last("li") if tag == "li" else self.last("dd", "dt")
            if at > max(self.last(*LISTS), self.fences[-1]):
                self.pop_to(at)
        elif tag in CELLS or tag in ROWS:
            table = self.last("table")
            at = [self.last(*CELLS), self.last("tr"), self.last("tbody", "thead", "tfoot")][: 1 if tag in CELLS else 2 if tag == "tr" else 3]
            inside = [x for x in at if x > table]
            if inside:
                self.pop_to(min(inside))
        elif tag in ("option", "optgroup") and self.kinds[self.stack[-1]] == "option" or tag in HEADINGS and self.kinds[self.stack[-1]] in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        elif tag == "a" and (at := self.last("a")) > self.open_blocks[-1]:
            self.pop_to(at)

    def boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in SKIPPED:
            return HARD
        if tag in ("body", "html", "article", "main"):
            return NONE if tag != "article" else self.by_words(attrs, NONE) // OTHERS * OTHERS
        return self.by_words(attrs, LAYOUT if tag == "form" or tag == "header" and not self.articles else NONE)

    def by_words(self, attrs: list[tuple[str, str | None]], mark: int) -> int:
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDING.search(value.lower().replace(" ", "")):
                return HARD
            if name == "role" and value.lower() in ROLES:
                mark = max(mark, LAYOUT)
            if name in ("class", "id"):
                words = {w.lower() for w in CLASS_WORDS.findall(value)}
                if not MARKS.isdisjoint(words) or not self.articles and not OUTER_MARKS.isdisjoint(words):
                    mark = max(mark, LAYOUT if FOREIGN.isdisjoint(words) else OTHERS)
        return mark

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and not self.hard:
            self.line_open = False
            self.count += 1
        if tag in VOID or tag in ("body", "html"):
            return
        at = self.last(tag)
        fence = self.open_blocks[-1] if tag not in BLOCKS else self.last("table") if tag in CELLS or tag in ROWS else 0 if tag == "table" else self.fences[-1]
        if at and at >= fence:
            self.pop_to(at)
        elif tag == "a":
            self.in_link = False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "g", "use"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.hard:
            return
        if not self.line_open:
            if not data.strip():
                return
            self.line_open = True
            self.blocks.append(self.stack[self.open_blocks[-1]])
            self.tags.append(self.count)
            self.count = 0
        self.pieces.append((len(self.blocks) - 1, self.stack[-1], data, self.in_link))

    def parse_comment(self, i: int, report: bool = True) -> int:
        """As browsers do: a comment without an end is the rest of the page."""
        end = COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    # markup that is open at the end of the page is dropped to the end, once: else each later start would search it again

    def parse_starttag(self, i: int) -> int:
        return self.or_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self.or_end(super().parse_endtag(i))

    def parse_pi(self, i: int) -> int:
        return self.or_end(super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i) and not self.rawdata.startswith("<![CDATA[", i):  # conditional comments and the like
            return self.rawdata.find(">", i) + 1 or len(self.rawdata)
        return self.or_end(super().parse_html_declaration(i))

    def or_end(self, k: int) -> int:
        return len(self.rawdata) if k < 0 else k

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.handle_data(unescape(data[6:]))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratios, reach, mode="reflect") if len(ratios) > reach else np.pad(ratios, reach), kernel, "valid")


def content_clusters(size: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Whether each line is in a content cluster, from text lengths outside links and numbers of tags."""
    ratio = size / np.maximum(1, tags)
    if not ratio.std():
        return size > 0
    high, own = smoothed(ratio) > THRESHOLD * ratio.std(), ratio > OWN * ratio.std()
    out = np.zeros(len(ratio), bool)
    edge = np.diff(np.concatenate(([0], high.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        reached = np.flatnonzero(own[a:b])
        if len(reached):
            out[a + reached[0] : a + reached[-1] + 1] = True
    return out


def spread(own: list[bool], parents: list[int]) -> list[bool]:
    """Whether each element or one around it has the property (an element's number is larger than its parent's)."""
    out = list(own)
    for e in range(1, len(out)):
        out[e] = out[e] or out[parents[e]]
    return out


def added_up(own: list[float], parents: list[int]) -> list[float]:
    """The sums over each element and all inside it."""
    out = list(own)
    for e in range(len(out) - 1, 0, -1):
        out[parents[e]] += out[e]
    return out


def boilerplate(page: Lines) -> list[bool]:
    """Whether each element is boilerplate. Marks go from elements that hold most of the page's text or its article."""
    parents, kinds, marks = page.parents, page.kinds, list(page.marks)
    if not any(m in (LAYOUT, OTHERS) for m in marks):
        return [m == HARD for m in marks]  # no piece is in them
    own = [0.0] * len(parents)
    for _, e, text, link in page.pieces:
        own[e] += 0 if link else len(text)
    prose = added_up(own, parents)
    for e, m in enumerate(marks):
        if prose[e] and (m == LAYOUT and prose[e] > MOST * prose[0] or m == OTHERS and prose[e] >= HOLDS * prose[0]):
            marks[e] = NONE
    others, skip = spread([m == OTHERS for m in marks], parents), spread([m != NONE for m in marks], parents)
    found = [e for e, k in enumerate(kinds) if k == "main" and prose[e]] or [e for e, k in enumerate(kinds) if k == "article" and prose[e] and not others[e]]
    at = max(found, key=prose.__getitem__, default=0)
    usable = sum(x for x, s in zip(own, skip, strict=True) if not s)
    if kinds[at] == "main" or 2 * prose[at] >= usable:
        while at := parents[at]:
            marks[at] = NONE
    return spread([m != NONE for m in marks], parents)


class Page:
    """The usable lines of a parsed page, and which of them are in clusters."""

    def __init__(self, page: Lines):
        self.parents, self.kinds = page.parents, page.kinds
        skip = boilerplate(page)
        held: dict[int, list[str]] = {}
        linked: dict[int, int] = {}
        for line, e, text, link in page.pieces:
            if not skip[e]:
                held.setdefault(line, []).append(text)
                if link:
                    linked[line] = linked.get(line, 0) + len(text)
        self.text, self.block, tags, links = [], [], [], []
        before = 0
        for line, n in enumerate(page.tags):
            before += n
            if text := BLANK.sub(" ", "".join(held.get(line, ()))).strip():
                self.text.append(text)
                self.block.append(page.blocks[line])
                tags.append(before)
                links.append(min(len(text), linked.get(line, 0)))
                before = 0
        self.size, self.links = np.array(list(map(len, self.text)), np.int64), np.array(links, np.int64)
        self.cluster = content_clusters((self.size - self.links).astype(float), np.array(tags, np.int64)) if self.text else np.zeros(0, bool)

    def inside(self, elements: set[int]) -> np.ndarray:
        """Which lines are in one of the elements."""
        own = spread([e in elements for e in range(len(self.parents))], self.parents)
        return np.array([own[b] for b in self.block], bool)

    def sums(self, values: np.ndarray) -> list[float]:
        own = [0.0] * len(self.parents)
        for b, v in zip(self.block, values.tolist(), strict=True):
            own[b] += v
        return added_up(own, self.parents)

    def main(self) -> np.ndarray:
        """Which lines are main text."""
        if not len(self.text):
            return np.zeros(0, bool)
        if not self.cluster.any():
            plain = 2 * self.links < self.size
            return plain if plain.any() else np.ones(len(plain), bool)
        good, whole = self.sums(self.size * self.cluster), self.sums(self.size)
        articles = [e for e, k in enumerate(self.kinds) if k == "article" and whole[e]]
        if articles:
            main = max(articles, key=good.__getitem__)
            first = {e for e in articles if 2 * good[e] >= whole[e]} | {main}
            if 2 * self.cluster[self.inside(first)] @ self.size[self.inside(first)] >= good[0]:
                out = self.inside(first)
                for e in sorted(set(articles) - first):
                    out &= ~self.inside({e}) | self.inside({a for a in first if a > e})
                return out | self.title(out)
        mains = [e for e, k in enumerate(self.kinds) if k == "main" and 2 * good[e] >= good[0]]
        return self.by_clusters(self.inside({max(mains, key=good.__getitem__)}) if mains else np.ones(len(self.text), bool))

    def title(self, chosen: np.ndarray) -> np.ndarray:
        """The last h1 before the chosen lines, if there is none among them."""
        out = np.zeros(len(chosen), bool)
        heads = np.array([self.kinds[b] == "h1" for b in self.block], bool)
        before = np.flatnonzero(heads[: int(chosen.argmax())])
        if chosen.any() and not heads[chosen].any() and len(before):
            out[before[-1]] = True
        return out

    def by_clusters(self, scope: np.ndarray) -> np.ndarray:
        parents, kinds = self.parents, self.kinds
        scope = scope & ~self.after_comments()
        chosen = self.cluster & scope & (2 * self.links < self.size)
        # lines of one kind under one parent go together
        groups: dict[tuple[int, str], list[int]] = {}
        for i in np.flatnonzero(scope):
            b = self.block[i]
            if kinds[b] in ALIKE:
                groups.setdefault((parents[b], kinds[b]), []).append(int(i))
        for own in groups.values():
            size = int(self.size[own].sum())
            if 2 * int(self.size[own] @ chosen[own]) >= size > 2 * int(self.links[own].sum()):
                chosen[own] = True
        # lists, tables and the like beside chosen lines
        holders = {parents[self.block[i]] for i in np.flatnonzero(chosen) if kinds[self.block[i]] not in HEADINGS}
        outer = [0] * len(parents)  # the outermost element around each with only what runs in a text between
        for e in range(1, len(parents)):
            outer[e] = 0 if kinds[e] in ("div", "section") else outer[parents[e]] or (e if kinds[e] in RUNNING else 0)
        links, size = self.sums(self.links), self.sums(self.size)
        for i in np.flatnonzero(scope & ~chosen):
            t = outer[self.block[i]]
            if t and (parents[t] in holders or t in holders) and 2 * links[t] < size[t]:
                chosen[i] = True
        chosen |= self.headed(scope, chosen, outer)
        # headings whose next line stays, and what is between
        for i in np.flatnonzero(scope & ~chosen)[::-1]:
            if kinds[self.block[i]] in HEADINGS:
                follows = chosen[i + 1 : i + 2 + (BYLINES if kinds[self.block[i]] == "h1" else 0)]
                if follows.any():
                    more = np.arange(i, i + 1 + int(follows.argmax()))
                    chosen[more[(2 * self.links[more] < self.size[more]) & scope[more]]] = chosen[i] = True
        end = len(chosen) - 1
        while end >= 0 and (not chosen[end] or COPYRIGHT.match(self.text[end])):
            chosen[end] = False
            end -= 1
        return chosen

    def headed(self, scope: np.ndarray, chosen: np.ndarray, outer: list[int]) -> np.ndarray:
        """Short headed sections in or beside an element around chosen lines: a heading and the paragraphs, lists and the
        like that follow it under the same parent, if a paragraph comes first and they aren't mostly links."""
        around = {0}
        for i in np.flatnonzero(chosen):
            e = self.block[i]
            while e not in around:
                around.add(e)
                e = self.parents[e]
        out = np.zeros(len(chosen), bool)
        for i in np.flatnonzero(scope & ~chosen):
            b = self.block[i]
            under = self.parents[b]
            if self.kinds[b] not in HEADINGS or under not in around and self.parents[under] not in around:
                continue
            j = int(i) + 1
            while j < len(out) and (t := outer[self.block[j]]) and self.parents[t] == under:
                j += 1
            rest = np.arange(i + 1, j)
            if len(rest) and self.kinds[self.block[rest[0]]] == "p" and 2 * self.links[rest].sum() < self.size[rest].sum():
                out[i:j] = scope[i:j]
        return out

    def after_comments(self) -> np.ndarray:
        """Lines from a heading of comments to the end of the heading's parent."""
        out = np.zeros(len(self.text), bool)
        for i, b in enumerate(self.block):
            if self.kinds[b] in HEADINGS and not out[i] and COMMENTS.fullmatch(self.text[i]):
                out |= self.inside({self.parents[b]}) & (np.arange(len(out)) >= i)
        return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    page = Page(parser)
    return "\n".join([page.text[i] for i in np.flatnonzero(page.main())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def make():
        def work(batch: pa.RecordBatch):
            ids, urls, html = (batch[c] for c in ("page_id", "url", "html"))
            text = [main_text(h) for h in html.to_pylist()]
            yield {"page_id": ids, "url": urls, "text": text, "n_chars": list(map(len, text))}

        return work

    return by_batch(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", make)
