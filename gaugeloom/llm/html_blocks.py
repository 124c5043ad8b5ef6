"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one for each block-level piece of text), and each line is weighed: by its length,
ELEMENT times in article and main elements, nothing in menus, forms, notices and the like (known by their element,
role, class or id) nor where most of it is links. Weights are summed over sliding windows of lines; a
block begins where that sum surges and ends at the dive, where a whole window weighs nothing or an article or main
element begins or ends. The heaviest block is the main text. With it belongs all other text of its container,
however short, and blocks of other containers that weigh at least a part of it; what is lighter is taken for
the page's furniture that nothing names as such.

Defined cases: a null or empty page has the empty text; unclosed elements end with their parent;
a comment, script or style that is never closed runs to the end of the page; after a quote in a tag that is never closed,
tags end at the next ">"; a slash at the end of a script, style or other raw element doesn't close it, and formulas are text; where
elements set apart by a word that may name an article's subject (copyright, cookie, search ...) hold more text than all
that isn't apart, such words set nothing apart on that page; where all text is in elements that their class or id sets apart, the outermost of these
are taken for wrappers; repeated rows stay. Time is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_batches

# Fixed values of HTML.
RAW = frozenset("script style title textarea noscript template svg annotation annotation-xml iframe object canvas select datalist audio video".split())
#: Of these, those that a slash can close: elsewhere it is part of the tag and closes nothing.
FOREIGN = frozenset("svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements, roles and class or id words that mark what is no article.
APART = frozenset("nav aside footer form button dialog menu search fieldset label input".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments disqus respond replies reply widget toolbar pagination pager copyright legal disclaimer skip search".split()
)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_QUOTED_END = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Of these, words that also name what an article is about: the weights of the lines decide about their elements.
DOUBTFUL_WORDS = frozenset("promotion banner navigation cookie cookies consent notice notification popup overlay newsletter share sharing social widget copyright legal disclaimer search sponsor".split())


#: Elements that end an open one of their kind, unless one of the second kind was opened in between.
REPLACE = frozenset("p li td tr dd dt option".split())
HOLD = frozenset("ul ol table dl div section article main select".split())
#: Times the weight of a line in an article or main element.
ELEMENT = 4


@dataclass(frozen=True)
class Params:
    """window: lines in a block; surge: characters in a window where text begins (a quarter of the heaviest, if that is less); share: part of the heaviest block's weight that a block in another container needs; links: part of a line in links from which it is a menu line."""

    window: int = 3
    surge: int = 86
    share: float = 0.1
    links: float = 0.5


class Line(NamedTuple):
    """text; characters in links; whether it is apart; number of the article or main element it is in, or 0; number of its element, and of that which holds it (0: the page); whether only a doubtful word sets it apart."""

    text: str
    linked: int
    apart: bool
    article: int
    element: int
    parent: int
    doubtful: bool


def _apart(tag: str, attributes: str, inside: bool, words: frozenset = APART_WORDS) -> bool:
    """Whether an element holds no article text; ``inside``: it is within an article or main element; ``words``: those of its class or id that count."""
    if tag in APART or (tag == "header" and not inside):
        return True
    if not attributes or attributes.isspace():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if words and tag not in ("body", "html", "article", "main") and any(w.lower() in words for w in _WORD.findall(value)):
                return True
        elif name == "role":
            if value.strip().lower() in APART_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


@lru_cache(maxsize=None)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, tag, whether it closes, attributes) for each tag, with the text before it; the last has no tag. What stands in RAW elements and comments is left out."""
    at, end, quotes, text = 0, len(page), True, []
    last = page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0 or start > last:  # no tag can end any more
            comment = page.find("<!--", at)
            yield "".join(text) + page[at : comment if comment >= 0 else end], "", False, ""
            return
        text.append(page[at:start])
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = close + 3 if close >= 0 else end
            continue
        if page.startswith("<![CDATA[", start):
            at = start + 9
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.index(">", start) + 1
            continue
        m = _TAG.match(page, start)
        if m is None:
            text.append("<")
            at = start + 1
            continue
        close = _QUOTED_END.match(page, m.end()) if quotes else None
        if close is None:
            quotes = False
            at = page.index(">", start) + 1
        else:
            at = close.end()
        tag, closes, attributes = m[2].lower(), bool(m[1]), page[m.end() : at - 1]
        if tag in RAW:
            if not closes and not (tag in FOREIGN and attributes.endswith("/")):
                found = _closing(tag).search(page, at)
                at = found.end() if found else end
            continue
        yield "".join(text), tag, closes, attributes
        text.clear()


class _Open:
    """The open elements that hold blocks or are apart, numbered as they open."""

    def __init__(self):
        self.elements: list[tuple[str, int, bool]] = []  # tag, number, apart
        self.at: dict[str, list[int]] = {}  # depths of each tag
        self.holds: list[int] = []  # depths of HOLD, of BLOCK, of what is apart, and of what is apart by its tag
        self.blocks: list[int] = []
        self.apart: list[int] = []
        self.named: list[int] = []
        self.articles: list[int] = []  # numbers
        self.last = [0]  # of each number, the highest number within it
        self.sure: list[int] = []  # depths of what is apart by more than a doubtful word
        self.wrapper: int | None = None  # depth of an element that is not taken as apart

    def push(self, tag: str, apart: bool, sure: bool = False) -> None:
        depth, number = len(self.elements), len(self.last)
        self.last.append(number)
        self.elements.append((tag, number, apart))
        self.at.setdefault(tag, []).append(depth)
        for depths, is_such in ((self.holds, tag in HOLD), (self.blocks, tag in BLOCK), (self.apart, apart), (self.named, apart and tag in APART), (self.sure, apart and sure)):
            if is_such:
                depths.append(depth)
        if tag in ("article", "main"):
            self.articles.append(number)

    def close_to(self, depth: int) -> None:
        while len(self.elements) > depth:
            tag, number, _ = self.elements.pop()
            top = len(self.elements)
            for depths in (self.at[tag], self.holds, self.blocks, self.apart, self.named, self.sure):
                if depths and depths[-1] == top:
                    depths.pop()
            if self.articles and self.articles[-1] == number:
                self.articles.pop()
            self.last[number] = len(self.last) - 1
        if self.wrapper is not None and depth <= self.wrapper:
            self.wrapper = None

    def close(self, tag: str, within: list[int] | None = None) -> bool:
        """Close the innermost open element of that tag, if there is one (``within``: above the last of these depths)."""
        depths = self.at.get(tag)
        if not depths or (within and within[-1] > depths[-1]):
            return False
        self.close_to(depths[-1])
        return True

    def place(self) -> tuple[int, int]:
        """The innermost element and the one that holds it."""
        return tuple(0 if tag in ("html", "body") else number for tag, number, _ in [("html", 0, False)] * 2 + self.elements[-2:])[:-3:-1]


def lines_of(page: str, unwrap: bool = False, words: frozenset = APART_WORDS) -> tuple[list[Line], list[int]]:
    """The lines of a page, empty ones left out, and of each element the highest number within it. ``unwrap``: the outermost elements that class or id sets apart are not apart; ``words``: of class and id, those that set an element apart."""
    out: list[Line] = []
    parts: list[str] = []
    linked, links, opened = 0, False, _Open()

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Line(text, linked, bool(opened.apart), opened.articles[-1] if opened.articles else 0, *opened.place(), bool(opened.apart) and not opened.sure))
        parts.clear()
        linked = 0

    for text, tag, closes, attributes in _pieces(page):
        if text:
            parts.append(text)
            linked += len(text) * links
        if tag == "a":
            links = not closes
            continue
        if tag in BLOCK:
            flush()
            links = False
        if tag in VOID or not tag:
            continue
        if closes:
            if tag in BLOCK:
                opened.close(tag)
            elif tag in opened.at and opened.at[tag] and (not opened.blocks or opened.at[tag][-1] > opened.blocks[-1]):  # an inline element that is apart
                flush()
                opened.close(tag)
            continue
        apart = _apart(tag, attributes, bool(opened.articles), words)
        unwraps = unwrap and apart and opened.wrapper is None and not opened.apart and not _apart(tag, attributes, bool(opened.articles), frozenset())
        sure = apart and _apart(tag, attributes, bool(opened.articles), words - DOUBTFUL_WORDS)
        apart = apart and not unwraps
        if tag in BLOCK:
            if tag in ("article", "main") and opened.apart and not opened.named:
                opened.close_to(opened.apart[0])  # a notice that was never closed
            if tag in REPLACE:
                opened.close(tag, opened.holds)
            if unwraps:
                opened.wrapper = len(opened.elements)
            opened.push(tag, apart, sure)
        elif apart:
            flush()
            opened.push(tag, True, sure)
    flush()
    opened.close_to(0)
    return out, opened.last


def blocks_of(weights: list[int], cuts: list[int], params: Params = Params()) -> list[tuple[int, int, int]]:
    """(first line, line after the last, weight) of the blocks between the surge and dive points of weighed lines; ``cuts``: a block ends where these differ."""
    n, k = len(weights), params.window
    total = [0] * (n + 1)
    for i, w in enumerate(weights):
        total[i + 1] = total[i] + w
    window = [total[min(n, i + k)] - total[i] for i in range(n)]
    surge = max(1, min(params.surge, max(window, default=0) // 4))
    out, i = [], 0
    while i < n:
        if window[i] < surge:
            i += 1
            continue
        first, cut = i, None
        while i < n and window[i] > 0 and (not weights[i] or cut in (None, cuts[i])):
            cut = cuts[i] if weights[i] else cut
            i += 1
        out.append((first, i, total[i] - total[first]))
    return out


def main_text(page: str | None, params: Params = Params()) -> str:
    """The article text of one page, its blocks joined by single spaces."""
    if not page:
        return ""
    lines, last = lines_of(page)
    if sum(len(x.text) - x.linked for x in lines if x.doubtful) > sum(len(x.text) - x.linked for x in lines if not x.apart):
        lines, last = lines_of(page, words=APART_WORDS - DOUBTFUL_WORDS)
    if all(x.apart for x in lines):
        lines, last = lines_of(page, unwrap=True)
    weights = [0 if x.apart or (not x.article and x.linked > params.links * len(x.text)) else len(x.text) * (ELEMENT if x.article else 1) for x in lines]
    blocks = blocks_of(weights, [x.article for x in lines], params)
    if not blocks:
        return ""
    first, end, heaviest = max(blocks, key=lambda b: b[2])
    held: dict[int, int] = {}
    for j in range(first, end):
        held[_container(lines[j])] = held.get(_container(lines[j]), 0) + weights[j]
    home = max(held, key=held.get)
    if home:
        kept = {j for j, x in enumerate(lines) if weights[j] and home <= x.element <= last[home]}
    else:  # text that stands in the page itself
        kept = {j for j, x in enumerate(lines) if weights[j] and not _container(x)}
    for a, b, weight in blocks:
        if weight >= params.share * heaviest:
            kept.update(j for j in range(a, b) if weights[j] or (not lines[j].apart and a < j < b - 1 and weights[j - 1] and weights[j + 1]))
    return " ".join(lines[j].text for j in sorted(kept))


def _container(line: Line) -> int:
    """The element whose text a line belongs with: that which holds its own, but none around its article."""
    return max(line.parent, line.article)


def extract(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """page_id, url, text, n_chars for every page; repeated rows stay, other columns are not read."""

    def batch(rows: pa.RecordBatch) -> dict:
        texts = [main_text(x, params) for x in rows.column("html").to_pylist()]
        return {"page_id": rows.column("page_id"), "url": rows.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_batches(pages.select("page_id", "url", "html"), batch, "page_id long, url string, text string, n_chars long")
