"""Main-text extraction from HTML pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: the visible text between two block-level tags. Each line has a
text-to-tag ratio, the ratios are smoothed by a Gaussian along the page, and two-means clustering over all lines of the page, menus and
footers included, gives the threshold: lines over it are content unless they are links alone or stand in an element that
never holds main text (menus, headers, footers, sidebars, forms, notices, adverts, reader comments).

Content lines choose the regions. An article or main element with a content line is taken whole; where one holds others (a main element with
articles), its articles are chosen one by one, and of its own lines the content, what stands between chosen lines, and headings right
before them. Where no such element has a line, the region runs from the first content line to the last, with the headings right before and what else stands
in the blocks of its content lines. Where such elements have lines but no content (very short articles), the one with most of the smoothed ratio is taken. Elements
that never hold main text are left out of every region, and so are runs of lines that are links alone whose smoothed ratios lie under the threshold: menus that no name marks.

Class and id names mark such elements only as whole names: each part must be a mark (``ad``, ``sidebar``) or a word of layout
(``site``, ``wrapper``), so ``site-header`` is one and ``share-price-analysis`` is not.

Defined results: null or empty html gives an empty text; text outside tags is a line; very long pages are read whole;
repeated rows give repeated results; an empty table gives none; columns other than id, url and html are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without visible text, and visible ones that never hold main text.
UNSEEN = frozenset("head title script style noscript template svg canvas iframe object audio video".split())
NEVER = frozenset("nav footer aside form button select textarea menu dialog".split())
REGION = frozenset({"article", "main"})
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Blocks of a page; lists, tables and paragraphs are lines of the block around them.
BOXES = frozenset("html body div section article main center fieldset details td th".split())
#: Elements that a new one of the same kind ends, and the elements that such an end doesn't reach beyond.
ENDED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words of class and id attributes that mark what is not main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager"
    " header masthead topbar footer colophon cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " related recommended comment comments commentlist disqus reply replies respond reaction reactions toolbar widget copyright skip hidden outbrain taboola".split()
)
#: Words that change nothing about a mark beside them.
LAYOUT = frozenset(
    "site global top bottom left right primary secondary wrapper wrap container box area list section block inner outer bar link links item items row col column form message messages policy"
    " button buttons icons icon group panel slot unit widgets holder module js the is has fixed sticky main mobile desktop small large tag to posts stories more bootstrap accept media reader user".split()
)
#: Words of main text: beside them only these marks count.
HELD = frozenset("article content post entry story body text page".split())
STRONG = frozenset("comment comments ad ads sidebar footer nav navigation menu related share sharing".split())
#: A smoothed ratio of so many characters a tag is content, wherever the clusters meet.
SPARSE = 12.0
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SHOWN, LEFT_OUT, INVISIBLE = range(3)


def is_mark(name: str, in_region: bool) -> bool:
    """True if a class or id name as a whole says that the element holds no main text."""
    parts = WORDS.findall(CAMEL.sub(" ", name).lower())
    marks = MARKS & set(parts)
    if not marks or any(x not in MARKS and x not in LAYOUT and x not in HELD for x in parts):
        return False
    if in_region and parts in (["header"], ["entry", "header"]):
        return False
    return not HELD & set(parts) or bool(STRONG & marks)


def is_marked(tag: str, attrs: list[tuple[str, str | None]], in_region: bool) -> bool:
    """True if the element holds no main text. A header inside an article is the article's own."""
    if tag in NEVER or (tag == "header" and not in_region):
        return True
    if tag in ("html", "body"):
        return False
    for key, value in attrs:
        value = value or ""
        if key in ("class", "id") and any(is_mark(name, in_region) for name in value.split()):
            return True
        value = value.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if key == "role" and value.strip() in ROLES:
            return True
    return False


@dataclass
class Line:
    text: str
    tags: int
    shown: bool
    #: The region elements that hold the line, the outermost first.
    regions: tuple[int, ...]
    links: bool
    heading: bool
    #: The block that holds the line.
    box: int


class Lines(HTMLParser):
    """Lines of a page with their tag counts and the region elements that hold each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, tuple[int, ...], int]] = []  # tag, state, regions, block
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.others: list[str] = []
        self.tags = self.count = self.links = self.boxes = 0
        self.linked = True

    def end_line(self) -> None:
        text, other = (SPACE.sub(" ", "".join(x)).strip() for x in (self.parts, self.others))
        if text or other:
            tag, _, regions, box = self.open[-1] if self.open else ("", SHOWN, (), 0)
            self.lines.append(Line(text or other, self.tags, bool(text), regions, self.linked, tag in HEADINGS, box))
            self.tags = 0
        self.parts, self.others, self.linked = [], [], True

    def imply_ends(self, tag: str) -> None:
        """The ends that a new element implies: of a paragraph before any block, of an item before the next one."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == "p":
                del self.open[i:]
                break
            if self.open[i][0] not in INLINE:
                break
        ended, stops = ENDED.get(tag, ((), ()))
        for i in range(len(self.open) - 1, -1, -1) if ended else ():
            if self.open[i][0] in ended:
                del self.open[i:]
                break
            if self.open[i][0] in stops:
                break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append("\n")
        elif tag not in INLINE:
            self.end_line()
            if tag not in VOID:
                self.imply_ends(tag)
        if tag in VOID:
            return
        self.links += tag == "a"
        _, state, regions, box = self.open[-1] if self.open else ("", SHOWN, (), 0)
        if tag in BOXES:
            self.boxes += 1
            box = self.boxes
        if tag in UNSEEN:
            state = INVISIBLE
        elif state == SHOWN and is_marked(tag, attrs, bool(regions)):
            state = LEFT_OUT
        if tag in REGION and state == SHOWN:
            self.count += 1
            regions = (*regions, self.count)
        self.open.append((tag, state, regions, box))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append("\n")
        elif tag not in INLINE:
            self.end_line()

    def shut(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        if tag == "a":
            self.links = max(0, self.links - 1)
        self.shut(tag)

    def handle_data(self, data: str) -> None:
        state = self.open[-1][1] if self.open else SHOWN
        if state == SHOWN:
            self.parts.append(data)
            self.linked = self.linked and (self.links > 0 or not data.strip())
        elif state == LEFT_OUT:
            self.others.append(data)


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = math.ceil(3 * sigma)
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    padded = np.convolve(ratios, kernel / kernel.sum(), mode="full")
    return padded[r : r + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Midpoint of the two cluster means of the logarithms (two-means from the extremes)."""
    x = np.log1p(values)
    low, high = float(x.min()), float(x.max())
    for _ in range(30):
        mid = (low + high) / 2
        a, b = x[x <= mid], x[x > mid]
        if not len(a) or not len(b) or (a.mean(), b.mean()) == (low, high):
            break
        low, high = float(a.mean()), float(b.mean())
    return math.expm1((low + high) / 2)


def menus(lines: list[Line], ratio: np.ndarray, limit: float) -> np.ndarray:
    """Runs of two lines or more of one block that are links alone, with a median of smoothed ratios under ``limit``."""
    out = np.zeros(len(lines), bool)
    first = 0
    for i in range(len(lines) + 1):
        if i < len(lines) and lines[i].shown and lines[i].links and (i == first or lines[i].box == lines[first].box):
            continue
        if i - first > 1 and np.median(ratio[first:i]) < limit:
            out[first:i] = True
        first = i if i < len(lines) and lines[i].shown and lines[i].links else i + 1
    return out


def chosen_lines(lines: list[Line], content: np.ndarray, ratio: np.ndarray, limit: float) -> np.ndarray:
    """Which lines are main text, given the content lines, the smoothed ratios and the ratio from which a line is content."""
    shown = np.array([x.shown for x in lines])
    outer = np.array([x.regions[0] if x.regions else 0 for x in lines]) * shown
    inner = np.array([x.regions[1] if len(x.regions) > 1 else 0 for x in lines]) * shown
    keep = np.zeros(len(lines), bool)
    order = np.argsort(outer, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(outer[order])) + 1):  # the lines of one region, in page order
        if not outer[at[0]] or not content[at].any():
            continue
        if not inner[at].any():
            keep[at] = True
            continue
        nested = inner[at]
        mine = content[at] | np.isin(nested, np.setdiff1d(nested[content[at]], [0]))
        keep[at] = spanned([lines[i] for i in at.tolist()], mine, (nested == 0) | mine)
    if not keep.any():
        if outer.any():
            weight = np.bincount(outer, weights=ratio * np.array([len(x.text) for x in lines]))
            weight[0] = -1
            keep = outer == int(weight.argmax())
        else:
            keep = spanned(lines, content, shown, widen=True)
    return keep & ~menus(lines, ratio, limit)


def spanned(lines: list[Line], content: np.ndarray, allowed: np.ndarray, widen: bool = False) -> np.ndarray:
    """From the first content line to the last, and the headings right before, of the lines that are allowed.

    With ``widen`` the span grows on either side over the lines that stand in a block of a content line, up to the last that isn't links alone.
    """
    at = np.flatnonzero(content)
    keep = np.zeros(len(lines), bool)
    if len(at):
        first, last = int(at.min()), int(at.max())
        if widen:
            boxes = {lines[i].box for i in at.tolist()}
            for step, end in ((-1, -1), (1, len(lines))):
                i = first if step < 0 else last
                for j in range(i + step, end, step):
                    if allowed[j]:
                        if lines[j].box not in boxes:
                            break
                        if not lines[j].links:
                            i = j
                first, last = (i, last) if step < 0 else (first, i)
        while first and allowed[first - 1] and lines[first - 1].heading:
            first -= 1
        keep[first : last + 1] = True
    return keep & allowed


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.end_line()
    lines = p.lines
    if not lines:
        return ""
    ratio = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines], float))
    limit = min(threshold(ratio), SPARSE)
    content = (ratio >= limit) & np.array([x.shown and not x.links for x in lines])
    keep = chosen_lines(lines, content, ratio, limit)
    return " ".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
