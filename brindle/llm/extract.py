"""Main text of web pages by text-to-tag ratios of lines.

The standard library's parser streams a page's events; every block-level tag ends a line. A line's ratio is its
characters of text by its tags, links' text left out. Ratios are smoothed along the page by a Gaussian, and a threshold
between two clusters of them, found by two means, marks the lines of content. These mark where the content lies, not what
is kept of it: a short line of an article has a low ratio. The content region is the innermost element that holds
nearly all of the marked text, or the outermost article or main element round it, and every line of it is kept, but for
what stands in elements that are no text of the article: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and readers' comments, known by their tag, role, or a word of their class or id, and lists of links.
A heading in an article's own header is kept.

Pages are independent rows: no shuffle. A page is fed to the parser in pieces of PIECE characters; its lines are held.

Defined cases: a null or empty page has an empty text; a page of plain text is one line; unclosed tags end where an
element round them does, those of paragraphs and list items also where the next one begins; an article or main element
that begins inside an element that was left open by mistake is content; a line break is white space; long pages are read
whole; repeated rows give repeated rows; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16
#: Deviation of the Gaussian, in lines.
SIGMA = 1.5
#: Share of the marked text that the content region holds.
REGION = 0.9
#: A list of at least so many links, whose text is links' to at least this share, is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.8

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A paragraph ends where one of these begins.
_AFTER_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an open paragraph or item can't be closed through.
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"div", "section", "article", "main", "body", "td", "li", "blockquote"}}
_NEVER = frozenset("head title script style noscript template iframe object embed svg math canvas audio video map select option button textarea input datalist dialog".split())
_CHROME = frozenset("nav header footer aside form menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
_COMMENTS = frozenset("comment comments commentlist comment-list comment-section commentsection disqus respond replies reply discussion discussions reviews".split())
_WORDS = frozenset(
    "nav navbar navigation menu menus topbar breadcrumb breadcrumbs pagination pager header masthead banner footer foot colophon copyright sidebar sidebars side aside widget widgets related recommended "
    "notice notices cookie cookies consent gdpr alert popup modal overlay subscribe subscription newsletter signup login paywall ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted "
    "share sharing social toolbar search form skip tags".split()
)
_CONTENT = frozenset(("article", "main"))
_SKIP, _REMARKS = 1, 2


def _names(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Classes and ids, whole and by their parts."""
    found: set[str] = set()
    for name, value in attrs:
        if name in ("class", "id") and value:
            for word in value.split():
                found.add(word.lower())
                found.update(part.lower() for part in re.split(r"[-_:.\s]+|(?<=[a-z])(?=[A-Z])", word) if part)
    return found


class _Element:
    __slots__ = ("tag", "parent", "skip", "links", "link_chars", "chars", "listed")

    def __init__(self, tag: str, parent: _Element | None, skip: int):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.links = self.link_chars = self.chars = 0
        self.listed = tag in ("ul", "ol", "menu", "dl", "table", "div", "p", "section")


class _Line:
    __slots__ = ("text", "tags", "linked", "element")

    def __init__(self, text: str, tags: int, linked: int, element: _Element):
        self.text, self.tags, self.linked, self.element = text, tags, linked, element


class Lines(HTMLParser):
    """The lines of a page, each with its tags, its linked characters and the element that holds it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = _Element("", None, 0)
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.anchors = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(_Line(text, self.tags, min(self.linked, len(text)), self.holder()))
        self.parts, self.tags, self.linked = [], 0, 0

    def holder(self) -> _Element:
        """The innermost open block."""
        at = self.top
        while at.tag in _INLINE:
            at = at.parent
        return at

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _INLINE:
            self.end_line()
            self.make_room(tag)
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        self.top = _Element(tag, self.top, self.skipped(tag, attrs))
        if tag == "a":
            self.anchors += 1
            at = self.top
            while at:
                at.links += 1
                at = at.parent

    def skipped(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """Whether a new element is no text of the article: _SKIP, or _REMARKS in readers' comments."""
        outer = self.top.skip
        if tag in _NEVER:
            return max(outer, _SKIP)
        names = _names(attrs) if attrs else set()
        if outer == _REMARKS or names & _COMMENTS:
            return _REMARKS
        if tag in _CONTENT and not names & _WORDS:
            return 0 if not outer or self.left_open() else outer
        if outer:
            own_heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and self.in_own_header()
            return 0 if own_heading else outer
        given = dict(attrs)
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style") or "")
        if hidden or tag in _CHROME or (given.get("role") or "").lower() in _ROLES or (tag not in ("html", "body", "a") and tag not in _CONTENT and names & _WORDS):
            return _SKIP
        return 0

    def in_own_header(self) -> bool:
        """Whether the element that is left out here is the header of an article."""
        at = self.top
        while at and at.skip and at.tag != "header":
            if at.tag in _CHROME or at.tag in _NEVER:
                return False
            at = at.parent
        while at and at.tag == "header":
            at = at.parent
        return bool(at and not at.skip and any(x.tag in _CONTENT for x in self.path(at)))

    def left_open(self) -> bool:
        """Whether the skipped element round an article is one that can't hold one: a menu, a form, a script or an advert's paragraph."""
        at = self.top
        while at and at.skip:
            if at.tag in ("aside", "footer", "header"):
                return False
            at = at.parent
        return True

    @staticmethod
    def path(at: _Element | None) -> Iterator[_Element]:
        while at:
            yield at
            at = at.parent

    def make_room(self, tag: str) -> None:
        """Close what can't stay open round a block: a paragraph, or the item before."""
        ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _AFTER_P else set())
        if not ends:
            return
        for at in self.path(self.top):
            if at.tag in ends:
                self.top = at.parent
                return
            if any(at.tag in _SCOPE.get(e, ()) for e in ends):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.end_line()
        self.tags += 1
        if tag in _VOID:
            return
        for at in self.path(self.top):
            if at.tag == tag:
                self.top = at.parent
                return
            if at.tag not in _INLINE and tag in _INLINE:  # an inline tag doesn't end a block
                return

    def handle_data(self, data: str) -> None:
        top = self.top
        if top.skip or not data:
            return
        self.parts.append(data)
        chars = len(data) - data.count(" ") - data.count("\n")
        linked = any(x.tag == "a" for x in self.inline())
        self.linked += len(data) if linked else 0
        at = top
        while at:
            at.chars += chars
            at.link_chars += chars if linked else 0
            at = at.parent

    def inline(self) -> Iterator[_Element]:
        at = self.top
        while at.tag in _INLINE:
            yield at
            at = at.parent


def _menu(line: _Line) -> bool:
    """Whether a line stands in a list of links."""
    at = line.element
    while at.parent and at.tag not in ("body", "article", "main"):
        if at.listed and at.links >= MENU_LINKS and at.link_chars >= MENU_SHARE * max(at.chars, 1):
            return True
        at = at.parent
    return False


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian mean along the lines; beyond the ends the weights are shared by the lines there are."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, weights)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), weights)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The middle between two means of the values; all are at it where they are alike."""
    low, high = float(values.min()), float(values.max())
    while low < high:
        middle = (low + high) / 2
        below, above = values[values < middle], values[values >= middle]
        now = (float(below.mean()) if len(below) else low, float(above.mean()) if len(above) else high)
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def _region(lines: list[_Line], marked: np.ndarray) -> _Element:
    """The innermost element that holds nearly all marked text, or the outermost article or main round it."""
    held: dict[_Element, int] = {}
    total = 0
    for line, mark in zip(lines, marked, strict=True):
        if mark:
            total += len(line.text)
            for at in Lines.path(line.element):
                held[at] = held.get(at, 0) + len(line.text)
    wide = [e for e, n in held.items() if n >= REGION * total]
    inner = max(wide, key=lambda e: sum(1 for _ in Lines.path(e)))
    outer = [e for e in Lines.path(inner) if e.tag in _CONTENT]
    return outer[-1] if outer else _whole(inner)


def _whole(at: _Element) -> _Element:
    """The block round a paragraph, an item or a cell, which its neighbours share."""
    while at.parent and at.tag in ("p", "li", "ul", "ol", "dl", "dt", "dd", "td", "th", "tr", "tbody", "thead", "table", "blockquote", "pre", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"):
        at = at.parent
    return at


def main_text(html: str) -> str:
    parser = Lines()
    for start in range(0, len(html), PIECE):
        parser.feed(html[start : start + PIECE])
    parser.close()
    parser.end_line()
    lines = [line for line in parser.lines if not _menu(line)]
    if not lines:
        return ""
    ratios = np.array([(len(x.text) - x.linked) / max(x.tags, 1) for x in lines], float)
    even = smoothed(ratios)
    region = _region(lines, even >= threshold(even))
    return "\n".join(line.text for line in lines if any(at is region for at in Lines.path(line.element)))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    plain = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column("html").to_pylist()]
            columns = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "url", "text", "n_chars"])

    shape = f"id {plain.schema['id'].dataType.simpleString()}, url string, text string, n_chars long"
    return plain.withColumn("url", F.col("url").cast("string")).mapInArrow(extract, shape)
