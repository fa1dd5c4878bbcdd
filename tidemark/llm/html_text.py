"""Main text of web pages by tree scoring.

A page is read once into blocks of text hanging on a tree of containers.  Elements
that by tag, role or name are never article text (menus, headers, footers, sidebars,
notices, adverts, scripts, styles, comments) are left out while reading.  Forms, and elements with
such a word in a longer name (``page-with-sidebar``, ``ad-free``), may be the wrapper of
a whole page: they are left out unless they hold nine tenths of the points there are.
Every paragraph gives points for its length and commas to its ancestors, all to
its parent, half to the grandparent, less further up; a container's points are
discounted by the share of its text that is links.  The best container is kept with
those of its siblings that hold prose, lists, tables or quotes, and all between them, and
so are its ancestors' siblings up to the lowest container that holds nine tenths of the page's points, as
an article's parts need not be siblings.

Rows are independent: one narrow pass, linear in the page's length, no shuffle.
"""

from __future__ import annotations

import heapq
import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title".split())
DROP_TAGS = RAW | frozenset("head nav header footer aside button select dialog menu search canvas video audio".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
DROP_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
KEEP_TAGS = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("ul ol dl table blockquote pre figure".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body figcaption".split())
#: An open element of the first kind ends where one of the second kind begins.
ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


#: Share of the points that makes a wrapper of a doubtful element, and the article's container.
MOST = 0.9
SURE, DOUBTFUL = 2, 1


def is_boilerplate(tag: str, attributes: str) -> int:
    """Whether an element is, by tag, role or name, no part of an article: SURE, DOUBTFUL or 0."""
    if tag in DROP_TAGS:
        return SURE
    found = DOUBTFUL if tag == "form" else 0
    if tag in KEEP_TAGS or not attributes:
        return found
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            return SURE
        if kind == "role" and value.lower() in DROP_ROLES:
            if value.lower() != "form":
                return SURE
            found = DOUBTFUL
        if kind in ("class", "id"):
            for name in value.split():
                words = [w.lower() for w in NAME.findall(name)]
                if words and words[0] not in ("with", "has", "no", "without") and (words[0] in DROP_NAMES or words[-1] in DROP_NAMES):
                    if len(words) == 1 or not COMMENTS.isdisjoint(words) or tag not in BLOCK:
                        return SURE
                    found = DOUBTFUL
    return found


class _Page:
    """Blocks of text (text, link characters, container) and their containers."""

    def __init__(self, source: str):
        self.tag, self.parent, self.first, self.end, self.doubtful = ["#"], [-1], [0], [0], [False]
        self.blocks: list[tuple[str, int, int]] = []
        self._parts: list[str] = []
        self._links, self._in_link = 0, False
        self._stack, self._dropped = [0], 0  # _dropped: depth of the open boilerplate element
        self._depths: dict[str, list[int]] = {}  # of the open elements, by tag
        self._read(source)
        while len(self._stack) > 1:
            self._close()
        self._flush()
        self.end[0] = len(self.blocks)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((text, self._links, self._stack[-1]))
            self._parts = []
        self._links = 0

    def _open(self, tag: str, how: int) -> None:
        drop = how == SURE
        if not drop or tag in BLOCK:
            self._flush()
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.doubtful.append(how == DOUBTFUL)
        self.first.append(len(self.blocks))
        self.end.append(len(self.blocks))
        self._depths.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        if drop and not self._dropped:
            self._dropped = len(self._stack)

    def _close(self) -> None:
        inside = self._dropped
        if inside == len(self._stack):
            self._dropped = 0
        if not inside:
            self._flush()
        node = self._stack.pop()
        self._depths[self.tag[node]].pop()
        self.end[node] = len(self.blocks)

    def _close_to(self, tags, until=()) -> None:
        """Close open elements down to the nearest of tags, unless one of until is nearer."""
        nearest = lambda some: max((self._depths[t][-1] for t in some if self._depths.get(t)), default=0)
        depth = nearest(tags)
        while depth > nearest(until) and len(self._stack) > depth:
            self._close()

    def _text(self, piece: str) -> None:
        if piece and not self._dropped:
            text = html.unescape(piece) if "&" in piece else piece
            self._parts.append(text)
            if self._in_link:
                self._links += len(text)

    def _read(self, source: str) -> None:
        at = 0
        while m := TOKEN.search(source, at):
            self._text(source[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "a":
                    self._in_link = False
                elif tag in BLOCK or tag in DROP_TAGS or self._dropped and tag == self.tag[self._stack[self._dropped - 1]]:
                    self._close_to((tag,))
                    self._in_link = self._in_link and tag not in BLOCK
                continue
            if tag in RAW:
                over = RAW_END[tag].search(source, at)
                at = over.end() if over else len(source)
            elif tag in ("br", "hr"):
                self._text(" ")
            elif tag == "a":
                self._in_link = True
            elif tag in BLOCK or tag in DROP_TAGS:
                if tag in BLOCK:
                    if self.tag[self._stack[-1]] == "p":
                        self._close()
                    if tag in ENDS:
                        self._close_to(ENDS[tag][0].split(), ENDS[tag][1])
                    self._in_link = False
                self._open(tag, is_boilerplate(tag, m[3]))
            elif tag not in VOID and m[3] and not self._dropped and is_boilerplate(tag, m[3]) == SURE:
                self._open(tag, SURE)  # a span or the like with a telling name
            elif self._dropped and tag not in VOID and tag == self.tag[self._stack[self._dropped - 1]]:
                self._open(tag, SURE)
        self._text(source[at:])


def left_out(page: _Page, points: list[float]) -> list[bool]:
    """Of the containers, those in a doubtful element that is no wrapper.  points: each container's own.

    The outermost ones are tried by their points, the most first: one that holds MOST of what it and the
    text outside of all of them have is a wrapper, and what it holds is tried in turn."""
    n = len(page.tag)
    inside, outer = list(points), [-1] * n  # points of the subtree; the nearest doubtful element around a container
    for i in range(n - 1, 0, -1):
        inside[page.parent[i]] += inside[i]
    below: dict[int, list[int]] = {}
    for i in range(1, n):
        up = page.parent[i]
        outer[i] = up if page.doubtful[up] else outer[up]
        if page.doubtful[i]:
            below.setdefault(outer[i], []).append(i)
    own = lambda i: inside[max(i, 0)] - sum(inside[k] for k in below.get(i, ()))
    free, wrapper = own(-1), [False] * n
    tried = [(-inside[i], i) for i in below.get(-1, ())]
    heapq.heapify(tried)
    while tried:
        held, i = heapq.heappop(tried)
        if held >= 0 or -held < MOST * (free - held):
            break
        wrapper[i], free = True, free + own(i)
        for k in below.get(i, ()):
            heapq.heappush(tried, (-inside[k], k))
    out = [False] * n
    for i in range(1, n):
        out[i] = out[page.parent[i]] or page.doubtful[i] and not wrapper[i]
    return out


def gained(page: _Page, text: str, node: int) -> float:
    """Points of a block: none unless it is a paragraph of some length."""
    if len(text) < 25 or page.tag[node] not in PARAGRAPHS:
        return 0.0
    return 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)


class Scores(NamedTuple):
    """By container: whether it is left out, characters, points of paragraphs passed to it, points of its
    whole text less those of links, share of its text that is no link, score."""

    out: list
    chars: list
    points: list
    plainly: list
    plain: list
    score: list


def tree_scores(page: _Page) -> Scores:
    n = len(page.tag)
    plainly = [0.0] * n  # points of a container's own blocks, without those of links
    if any(page.doubtful):
        for text, linked, node in page.blocks:
            plainly[node] += gained(page, text, node) * (1 - min(linked, len(text)) / len(text))
        out = left_out(page, plainly)
        plainly = [0.0] * n
    else:
        out = [False] * n
    chars, links, points = [0] * n, [0] * n, [0.0] * n
    for text, linked, node in page.blocks:
        if out[node]:
            continue
        chars[node] += len(text)
        links[node] += min(linked, len(text))
        if (gain := gained(page, text, node)) > 0:
            plainly[node] += gain * (1 - min(linked, len(text)) / len(text))
            up, level = page.parent[node] if page.tag[node] not in ("body", "article", "main", "#", "div", "section") else node, 0
            while up >= 0 and level < 5:
                points[up] += gain / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = page.parent[up], level + 1
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        links[page.parent[i]] += links[i]
        plainly[page.parent[i]] += plainly[i]
    plain = [1 - links[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    score = [(points[i] + (25 if points[i] and page.tag[i] in ("article", "main") else 0)) * plain[i] for i in range(n)]
    return Scores(out, chars, points, plainly, plain, score)


def main_text(source: str | None) -> str:
    """The article's text: white space inside a block is one space, blocks are joined by
    one; empty where a page has none."""
    if not source:
        return ""
    page = _Page(source)
    n = len(page.tag)
    out, chars, points, plainly, plain, score = tree_scores(page)
    best = max(range(n), key=lambda i: score[i])
    if not score[best]:  # only short blocks: the fullest article, else all there is
        named = [i for i in range(n) if page.tag[i] in ("article", "main")]
        best = max(named, key=lambda i: chars[i] * plain[i], default=0)
    up = best
    while up > 0 and page.tag[best] not in ("article", "main"):  # an article is kept whole
        up = page.parent[up]
        if up > 0 and page.tag[up] in ("article", "main"):
            best = up
    keep = [best] if best else [0]
    if best and page.tag[best] not in ("article", "main", "body", "html"):
        top = max((i for i in range(n) if plainly[i] >= MOST * plainly[0]), default=0)  # the lowest: children come later
        children: dict[int, list[int]] = {}
        for i in range(1, n):
            children.setdefault(page.parent[i], []).append(i)
        at = best
        while True:  # up to the container that holds most of the page's points
            for i in children[page.parent[at]]:
                good = page.tag[i] in HEADINGS and i < at or points[i] and plain[i] > 0.5
                good = good or page.tag[i] in PARTS and plain[i] >= 0.2
                good = good or page.tag[i] == "p" and (chars[i] > 80 and plain[i] > 0.75 or 0 < chars[i] and plain[i] == 1)
                if good and i != at and page.end[i] > page.first[i] and not out[i]:
                    keep.append(i)
            at = page.parent[at]
            if at <= top or page.tag[at] in ("body", "html", "#"):
                break
    wanted = bytearray(len(page.blocks))
    first, end = min(page.first[i] for i in keep), max(page.end[i] for i in keep)
    wanted[first:end] = b"\1" * (end - first)  # what lies between is of the article too
    whole = page.tag[best] not in ("#", "html", "body")
    for i in range(1, n):
        inside = whole and page.first[best] <= page.first[i] and page.end[i] <= page.end[best]
        if page.tag[i] in ("ul", "ol") and chars[i] and plain[i] < 0.2 and not inside:  # a list of links is a menu
            wanted[page.first[i] : page.end[i]] = bytes(page.end[i] - page.first[i])
    return " ".join(b[0] for b, w in zip(page.blocks, wanted, strict=True) if w and not out[b[2]])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (empty if none), n_chars for every row of pages.

    Null or empty html gives an empty text; broken markup is read as far as it goes;
    repeated rows come out as often as they go in; other columns are not looked at."""

    def run(batches):
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
