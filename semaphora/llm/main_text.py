"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered.

The standard library's parser streams a page as events; block boundaries cut it into lines. A line's ratio is its text
outside links by its number of tags; ratios are smoothed by a Gaussian over neighbouring lines, and lines above the
standard deviation of the smoothed ratios are clusters of content. They select regions: of a page's articles those that
hold some (all, if none does), and on pages without articles the smallest element that holds nearly all of the
clusters' text. Of a region all lines are kept, short ones too, but for
what elements, names or roles mark as menus, adverts, notices, forms, comments and the like.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, kept_as

#: Lines on each side that smooth a line's ratio.
RADIUS = 2
#: Part of the clusters' text that a region holds where no element is marked as an article.
SHARE = 0.9

# Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("head script style noscript template svg math iframe object canvas audio video select datalist button textarea dialog applet noembed noframes".split())
BOILERPLATE = frozenset("nav header footer aside form menu".split())
LANDMARKS = frozenset(["article", "main"])
#: Elements that a paragraph, a list item, a cell and so on ends where one of its kind begins; and what holds them.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table article section div main body td th blockquote".split())
#: Words of class, id and role that mark boilerplate, and those among them under which an article is none of the page's.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs menu nav navbar navigation footer header masthead toolbar widget pagination pager copyright complementary contentinfo search "
    "dialog alert alertdialog".split()
)
FOREIGN = frozenset("ad ads advert advertisement comment comments disqus reply replies respond related recommended recommendations sponsored sidebar complementary".split())
#: Words before a mark that only describe a layout: with-sidebar, no-comments.
LAYOUT = frozenset("with has no without not is hide".split())
_WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def marks(attributes: Iterable[tuple[str, str | None]]) -> set[str]:
    """The words of MARKS in class, id and role, without those that a word of LAYOUT comes before."""
    found = set()
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                found |= {w for k, w in enumerate(words) if w in MARKS and not (k and words[k - 1] in LAYOUT)}
    return found


@dataclass
class Element:
    """An open element: where it lies, whether its text is dropped, and why an article inside would be dropped too."""

    tag: str
    parent: int
    number: int
    never: bool = False
    dropped: bool = False
    foreign: bool = False
    landmark: int = -1
    in_main: bool = False
    link: bool = False


@dataclass
class Line:
    text: str
    chars: int
    tags: int
    element: int
    dropped: bool
    landmark: int


@dataclass
class Page:
    """Lines of a page in order; parents: of each element the one around it."""

    lines: list[Line] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)


class Lines(HTMLParser):
    """Cuts a page into lines. forms: whether the text of forms is dropped."""

    def __init__(self, forms: bool = True):
        super().__init__(convert_charrefs=True)
        self.page, self._forms = Page(), forms
        self._stack: list[Element] = []
        self._open: dict[str, int] = {}
        self._text: list[str] = []
        self._linked = self._tags = 0
        self._push("", [])

    def read(self, html: str) -> Page:
        cut = _OPENS.search(html, html.rfind(">") + 1)  # a tag that the page's end cuts off
        self.feed(html[: cut.start()] if cut else html)
        self.close()
        self._line()
        return self.page

    def _past(self, end: str, i: int) -> int:
        """Where end, looked for from i, is over; the page's end if it isn't there."""
        at = self.rawdata.find(end, i)
        return len(self.rawdata) if at < 0 else at + len(end)

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self._past(">", i) if self.rawdata.startswith(("<!-->", "<!--->"), i) else self._past("-->", i + 4)

    def parse_html_declaration(self, i: int) -> int:
        """Doctypes, and whatever else begins with <! and is no comment."""
        return self._past(">", i)

    def parse_pi(self, i: int) -> int:
        return self._past(">", i)

    def _line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            e = self._stack[-1]
            self.page.lines.append(Line(text, max(0, len(text) - self._linked), self._tags, e.number, e.dropped, e.landmark))
        self._text, self._linked, self._tags = [], 0, 0

    def _push(self, tag: str, attributes: list) -> None:
        up = self._stack[-1] if self._stack else Element("", -1, -1)
        e = Element(tag, up.number, len(self.page.parents), up.never, up.dropped, up.foreign, up.landmark, up.in_main, up.link or tag == "a")
        named = marks(attributes) if tag not in ("html", "body") else set()
        given = dict(attributes)
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style") or ""))
        if tag in LANDMARKS and not named and not hidden and not e.foreign:
            e.dropped = False
        elif named or hidden or tag in BOILERPLATE and not (tag == "header" and up.landmark >= 0) and (self._forms or tag != "form"):
            e.dropped = True
            e.foreign |= bool(named & FOREIGN) or hidden or tag == "aside"
        e.never |= tag in NEVER
        if tag in LANDMARKS and not e.dropped and (up.landmark < 0 or tag == "article" and up.in_main):
            e.landmark, e.in_main = e.number, tag == "main"
        self.page.parents.append(up.number)
        self._stack.append(e)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop_to(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        """Closes the innermost open element of tags, and all inside, unless an element of stop is nearer."""
        if not any(self._open.get(t) for t in tags):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].tag in tags:
                for e in self._stack[k:]:
                    self._open[e.tag] -= 1
                del self._stack[k:]
                return
            if self._stack[k].tag in stop:
                return

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag in BLOCKS:
            self._line()
            if tag not in ("head", "title", "html"):
                self._pop_to(("head",), frozenset())
            self._pop_to(("p",), HOLDERS)
            if tag in SIBLINGS:
                self._pop_to(SIBLINGS[tag], HOLDERS - {"td", "th", "div", "section"} if tag != "tr" else frozenset(["table"]))
        elif tag == "br":
            self._text.append(" ")
        self._tags += 1
        if tag not in VOID:
            self._push(tag, attributes)

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._line()
        elif tag == "br":
            self._text.append(" ")
        self._tags += 1
        self._pop_to((tag,), frozenset())

    def handle_data(self, data: str) -> None:
        e = self._stack[-1]
        if not e.never:
            self._text.append(data)
            if e.link:
                self._linked += len(data.strip())


def smoothed(ratios: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Ratios under a Gaussian kernel of a radius; beyond both ends nothing is counted."""
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-(at**2) / (2.0 * radius**2))
    full = np.convolve(ratios, kernel / kernel.sum())
    return full[radius : radius + len(ratios)]


def clusters(lines: list[Line]) -> np.ndarray:
    """Which lines are content: smoothed text-to-tag ratios above their standard deviation. Dropped lines count as 0."""
    ratios = np.array([0.0 if x.dropped else x.chars / max(1, x.tags) for x in lines])
    smooth = smoothed(ratios)
    return (smooth > 0) & (smooth >= smooth.std()) & np.array([not x.dropped for x in lines], dtype=bool)


def _inside(parents: list[int], root: int) -> np.ndarray:
    """Which elements lie in root, itself included: parents have lower numbers."""
    found = np.zeros(len(parents), dtype=bool)
    found[root] = True
    for k in range(root + 1, len(parents)):
        found[k] = found[parents[k]]
    return found


def region(page: Page, content: np.ndarray) -> np.ndarray:
    """The lines of the selected regions."""
    lines = page.lines
    keep = np.array([not x.dropped for x in lines], dtype=bool)
    marked = {x.landmark for x, k in zip(lines, keep, strict=True) if k and x.landmark >= 0}
    if marked:
        marked = {x.landmark for x, c in zip(lines, content, strict=True) if c and x.landmark >= 0} or marked
        return keep & np.array([x.landmark in marked for x in lines], dtype=bool)
    if not content.any():
        return keep
    held = np.zeros(len(page.parents))
    for x, c in zip(lines, content, strict=True):
        held[x.element] += x.chars * c
    total = held.sum()
    for k in range(len(held) - 1, 0, -1):
        held[page.parents[k]] += held[k]
    root = int(np.flatnonzero(held >= SHARE * total)[-1]) if total else 0
    inside = _inside(page.parents, root)
    links = np.array([x.chars == 0 for x in lines], dtype=bool)
    return keep & np.array([inside[x.element] for x in lines], dtype=bool) & (content | ~links)


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks joined by newlines. Null, empty and all-markup pages give an empty text."""
    page = Lines().read(html or "")
    if page.lines and all(x.dropped for x in page.lines):  # some sites put the whole page in one form
        page = Lines(forms=False).read(html)
    if not page.lines:
        return ""
    chosen = region(page, clusters(page.lines))
    return "\n".join(x.text for x, c in zip(page.lines, chosen, strict=True) if c)


@dataclass
class _Extracted:
    schema: pa.Schema

    def __call__(self, arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, 256):
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            new = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], schema=self.schema)


def extracted(pages: DataFrame, keep: Iterable[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The columns keep, text and n_chars (its code points) of every page, from its whole html.

    Null and empty pages, and those without text, have an empty text; a page in which every line is marked as
    boilerplate is empty too. Pages are read one by one, so repeated rows come out as often as they went in, and an
    empty table gives an empty one. A kept column of the name text or n_chars comes out with _in behind its name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = kept_as(keep, ["text", "n_chars", "_html"])
    rows = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(html).cast("string").alias("_html"))
    out = rows.drop("_html").schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), "text string", "n_chars long"])
    schema = pa.schema([*to_arrow_schema(out), pa.field("text", pa.string()), pa.field("n_chars", pa.int64())])
    return rows.mapInArrow(_Extracted(schema), ddl)
