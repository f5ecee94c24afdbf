"""Main text of web pages (operator 5).

The standard library's parser gives a stream of events; no tree is built beyond
each element's parent. Every block of a page becomes a line with its text, the
tags seen since the line before, and the element it stands in. Lines get the
ratio of text to tags, the ratios are smoothed with a Gaussian over neighbouring
lines, and a threshold (two-means over the smoothed ratios) parts content lines
from the rest. These decide what is the article:

- The top-level article elements with content lines, if these hold at least half
  of the page's content; else likewise main elements. All their lines count.
- Else the lowest element that holds all content lines. Of its other lines those
  stay that are text (not links for the most part) between content lines, and
  paragraphs and headings beside them; parts without a content line that consist
  of links, or that lie before or after all content, go.

Navigation, headers, footers, sidebars, forms, scripts and styles go by their
element's name, notices, adverts and reader comments by a word of class or id. A
word never drops an element that holds a main element or the page's heading, nor
one that holds most of the content in three lines or more (comments excepted), nor
all there is. ``no-x``, ``has-x`` and the like aren't taken for ``x``.

Defined results: null or empty html, and pages without text, give the empty
text; unclosed and stray tags are mended as browsers do in the common cases;
``br`` and table cells part words, other block elements part blocks, inline
elements (``wbr`` and images too) part nothing; time and memory go with the
length of a page however deep its elements are nested; repeated rows and rows
with equal or null ids are treated each for itself; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded_batches, text_of

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
SPACES = frozenset("br td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article.
DROPPED = frozenset("nav footer aside script style noscript template iframe object svg math head title button select textarea input label dialog menu audio video canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words of a class or id that mark what surrounds an article, and those of reader comments.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted related share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Before a mark, a word of these says that the element is about it, not that it is one.
ABOUT = frozenset("no not non has have with without hide hidden show open enable enabled disable disabled".split())
MAIN = ("article", "main")
#: Blocks that are text themselves; all others hold blocks.
TEXTUAL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 hgroup figcaption caption summary address".split())
#: Blocks of short texts, and what holds a whole page.
LISTS, WHOLE = frozenset("ul ol dl li dt dd table thead tbody tfoot tr td th".split()), ("", "html", "body")
#: A start tag that ends an open element of one of these names, up to a bounding element.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "caption", "legend"}
_WORD = re.compile(r"[a-z0-9]+")
SIGMA = 1.0
#: Lines of content that an element needs to be kept against a word of its class.
KEPT_LINES = 3
_HARD, _MARKED, _COMMENTS = 1, 2, 3


def _mark(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> int:
    """What an element's name and attributes say: 0 for nothing."""
    if tag in DROPPED or tag == "header" and not in_main:
        return _HARD
    found = _MARKED if tag == "form" else 0
    for name, value in attrs:
        if name in ("class", "id"):
            if value and tag not in ("html", "body", "main"):
                for part in value.lower().split():
                    words = _WORD.findall(part)
                    for before, word in zip(["", *words], words, strict=False):
                        if before in ABOUT or word == "header" and in_main:
                            continue
                        if word in COMMENTS:
                            return _COMMENTS
                        if word in MARKS:
                            found = _MARKED
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return _HARD
        elif name == "role" and value and value.lower() in ROLES:
            found = _MARKED
        elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return _HARD
    return found


class Lines(HTMLParser):
    """Turns parser events to lines: (text, tags, length of its links, innermost element).

    Of each element it keeps the parent, the name and the mark. Where an element of
    some name is open is kept by name, so no tag searches the stack of open ones.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.name, self.mark = [-1], [""], [0]
        self.open: list[int] = [0]
        self.at: dict[str, list[int]] = defaultdict(list)  # name -> places in ``open``
        self.blocks: list[int] = [0]  # places of blocks in ``open``
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.lines.append((text, self.tags, self.linked, self.open[-1]))
                self.tags = 0
        self.linked = 0

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            name = self.name[self.open.pop()]
            self.at[name].pop()
            if self.blocks[-1] == len(self.open):
                self.blocks.pop()

    def _last(self, names: tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at[n]), default=0)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        elif tag in SPACES:
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P and self.name[self.open[self.blocks[-1]]] == "p":
            self._pop_to(self.blocks[-1])
        if tag in ENDS:
            names, bounds = ENDS[tag]
            place = self._last(names)
            if place > self._last(bounds):
                self._pop_to(place)
        above = self.mark[self.open[-1]]
        # what is in a dropped element is dropped with it, whatever it is
        mark = _HARD if above == _HARD else _mark(tag, attrs, bool(self.at["article"] or self.at["main"]))
        self.at[tag].append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.parent.append(self.open[-1])
        self.open.append(len(self.name))
        self.name.append(tag)
        self.mark.append(mark)

    def handle_startendtag(self, tag, attrs):
        if tag in ("svg", "math") or self.at["svg"] or self.at["math"]:  # only foreign elements close themselves
            self.tags += 1
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        elif tag in SPACES:
            self.parts.append(" ")
        place = self._last((tag,))
        # an inline end tag doesn't reach out of the block it stands in
        if place and (tag in BLOCKS or tag in DROPPED or place > self.blocks[-1]):
            self._pop_to(place)

    def handle_data(self, data):
        if self.name[self.open[-1]] not in ("script", "style"):
            self.parts.append(data)
            if self.at["a"]:
                self.linked += len(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[reach : reach + len(values)] / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """The value midway between the two means that part ``values`` best."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        cut = (low + high) / 2
        above = values > cut
        if not above.any() or above.all():
            return cut
        now = float(values[~above].mean()), float(values[above].mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


class Page:
    """Lines and elements of a page, and which lines are content."""

    def __init__(self, parser: Lines):
        self.lines, self.parent, self.name, self.mark = parser.lines, parser.parent, parser.name, parser.mark
        ratio = np.array([len(x[0]) / max(1, x[1]) for x in self.lines])
        level = smooth(ratio)
        self.above = (level >= threshold(level)).tolist()
        self.own = [i for i, x in enumerate(self.lines) if self.mark[x[3]] != _HARD]

    def sums(self, weighed: Iterator[tuple[int, int]]) -> list[int]:
        """For each element the weights of the lines in it, at any depth."""
        out = [0] * len(self.parent)
        for i, weight in weighed:
            out[self.lines[i][3]] += weight
        for e in range(len(out) - 1, 0, -1):  # an element comes after its parent
            out[self.parent[e]] += out[e]
        return out

    def votes(self, rows: list[int]) -> list[int]:
        """Characters of content by element; where nothing stands out all lines vote."""
        content = [i for i in rows if self.above[i]] or rows
        return self.sums((i, len(self.lines[i][0])) for i in content)

    def inside(self, flags: list[bool]) -> list[bool]:
        """Which elements are flagged themselves or stand in a flagged one."""
        out = list(flags)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def unmarked(self) -> list[int]:
        """The lines that no word of a class drops."""
        if not any(m > _HARD for m in self.mark):
            return self.own
        heads = [False] * len(self.parent)
        bodies = list(heads)
        for e in range(len(heads) - 1, 0, -1):
            if self.mark[e] != _HARD:
                heads[e] = heads[e] or self.name[e] in ("main", "h1")
                bodies[e] = bodies[e] or heads[e] or self.name[e] == "article" and self.mark[e] != _COMMENTS
                above = self.parent[e]
                heads[above] = heads[above] or heads[e]
                bodies[above] = bodies[above] or bodies[e] and self.mark[e] != _COMMENTS
        votes = self.votes(self.own)
        lines = self.sums((i, 1) for i in self.own if self.above[i])
        gone = [False] * len(self.parent)
        for e, mark in enumerate(self.mark):
            if mark == _MARKED:
                gone[e] = not bodies[e] and not (2 * votes[e] > votes[0] and lines[e] >= KEPT_LINES)
            elif mark == _COMMENTS:
                gone[e] = not heads[e]
        gone = self.inside(gone)
        return [i for i in self.own if not gone[self.lines[i][3]]] or self.own

    def content(self) -> list[int]:
        """The lines of the article."""
        rows = self.unmarked()
        if not rows:
            return []
        votes = self.votes(rows)
        for name in MAIN:
            named = [n == name for n in self.name]
            within = self.inside(named)
            tops = [e for e, is_so in enumerate(named) if is_so and votes[e] and not within[self.parent[e]]]
            if tops and 2 * sum(votes[e] for e in tops) >= votes[0]:
                chosen = [False] * len(named)
                for e in tops:
                    chosen[e] = True
                chosen = self.inside(chosen)
                return [i for i in rows if chosen[self.lines[i][3]]]
        return self.region(rows, votes)

    def region(self, rows: list[int], votes: list[int]) -> list[int]:
        """Content lines and what belongs to them, without help of an article element."""
        # going down as long as one element holds all votes
        lowest = [e for e, v in enumerate(votes) if v == votes[0]][-1]
        while self.name[lowest] in TEXTUAL or self.name[lowest] not in BLOCKS and lowest:
            lowest = self.parent[lowest]
        held = self.inside([e == lowest for e in range(len(votes))])
        rows = [i for i in rows if held[self.lines[i][3]]]
        content = [i for i in rows if self.above[i]] or rows
        first, last = content[0], content[-1]
        text = self.sums((i, len(self.lines[i][0])) for i in rows)
        links = self.sums((i, min(self.lines[i][2], len(self.lines[i][0]))) for i in rows)
        begin, end = self.span(rows)
        whole = self.name[lowest] in WHOLE
        gone = [False] * len(votes)
        for e in range(1, len(votes)):
            if held[e] and e != lowest and text[e] and not votes[e] and self.name[e] in BLOCKS:
                outside = end[e] < first or begin[e] > last
                # in an element of its own an article may begin or end with a list or a short block
                part = not whole and (self.name[e] in LISTS or begin[e] == end[e])
                gone[e] = 2 * links[e] > text[e] or outside and self.name[e] not in TEXTUAL and not part
        gone = self.inside(gone)
        return [i for i in rows if not gone[self.lines[i][3]]]

    def span(self, rows: list[int]) -> tuple[list[int], list[int]]:
        """The first and the last line of each element."""
        n = len(self.lines)
        begin, end = [n] * len(self.parent), [-1] * len(self.parent)
        for i in rows:
            e = self.lines[i][3]
            begin[e], end[e] = min(begin[e], i), max(end[e], i)
        for e in range(len(begin) - 1, 0, -1):
            above = self.parent[e]
            begin[above], end[above] = min(begin[above], begin[e]), max(end[above], end[e])
        return begin, end


def main_text(html: str | None) -> str:
    """The article of a page, its blocks parted by an empty line."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    if not parser.lines:
        return ""
    return "\n\n".join(parser.lines[i][0] for i in Page(parser).content())


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in text_of(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its number of code points for (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
