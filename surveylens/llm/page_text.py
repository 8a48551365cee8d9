"""Main text of web pages.

``html.parser`` of the standard library streams start, end and data events; block-level
events cut the page into lines.  Each line has a text-to-tag ratio (its characters per
tag); the ratios are smoothed with a Gaussian kernel, and lines whose smoothed ratio
reaches one standard deviation form the content clusters.  The clusters choose a
content region: the ``article`` / ``main`` elements that hold them, or else the
deepest element that holds nearly all of their text.  Every line of the region counts,
short ones too; menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments inside it do not.

A page is one row and is parsed whole in the task that reads it; nothing is shuffled.

Edge cases: null or empty html and pages without text give an empty text; truncated
pages are parsed to their end; elements may be nested to any depth (each event's work does not
grow with it); repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from surveylens.llm.common import load, text_slices

# Elements of HTML by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q "
                   "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title nav header footer aside form button "
                    "select option textarea input iframe object embed svg canvas math audio video "
                    "menu dialog datalist".split())
REGIONS = frozenset(["article", "main"])
CLOSED_BY = {"p": frozenset("p div ul ol table article section h1 h2 h3 h4 h5 h6 blockquote pre "
                            "aside nav header footer form main dl hr address figure".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
BARRIERS = ("table", "article", "main", "body")  # an end tag outside them closes nothing inside
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|"
    r"overlay|newsletter|subscribe|signup|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-?bar|widget|"
    r"header|masthead|footer|copyright|comments?|replies|disqus|respond|share|sharing|social|related|"
    r"recommended|pagination|pager|login|search)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar "
                  "form".split())


class _Lines(HTMLParser):
    """Turns parser events into lines: (text, tags, element path, skipped)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parents: list[int] = [-1]   # of each element; element 0 is the page
        self.names: list[str] = [""]
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self.open: dict[str, list[int]] = {}  # places of each name's open elements in the stack
        self.blocks: list[int] = []           # places of the open block elements
        self.lines: list[tuple[str, int, int]] = []  # text, tags, element
        self._text: list[str] = []
        self._tags = 0

    def updatepos(self, i, j):
        """Line and column numbers are not needed."""
        return j

    def cut(self) -> None:
        if self._text:
            self.lines.append((" ".join("".join(self._text).split()), self._tags, self.stack[-1][1]))
            self._text, self._tags = [], 0
        elif self._tags:
            self.lines.append(("", self._tags, self.stack[-1][1]))
            self._tags = 0

    def push(self, tag: str, element: int, skipped: bool) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, element, skipped))

    def close_from(self, depth: int) -> None:
        """Close the element at ``depth`` and all inside it."""
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.cut()
            # the innermost block element, if its end tag may be left out here
            if self.blocks and tag in CLOSED_BY.get(self.stack[self.blocks[-1]][0], ()):
                self.close_from(self.blocks[-1])
        self._tags += 1
        if tag in VOID:
            return
        if tag in INLINE:
            skipped = self.stack[-1][2]
            if not skipped and tag == "span" and attrs and self._boilerplate(attrs):
                skipped = True
            if skipped == self.stack[-1][2]:
                self.push(tag, self.stack[-1][1], skipped)
                return
        else:
            skipped = self.stack[-1][2] or tag in SKIPPED or (
                tag not in ("body", "html") and bool(attrs) and self._boilerplate(attrs))
        self.parents.append(self.stack[-1][1])
        self.names.append(tag)
        self.push(tag, len(self.parents) - 1, skipped)

    @staticmethod
    def _boilerplate(attrs) -> bool:
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if value and (name in ("class", "id") and BOILERPLATE.search(value)
                          or name == "role" and value.lower() in ROLES
                          or name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return True
        return False

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.cut()
        self._tags += 1

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.cut()
        self._tags += 1
        if not self.open.get(tag):
            return
        depth = self.open[tag][-1]
        barrier = max((self.open[name][-1] for name in BARRIERS if self.open.get(name)), default=0)
        if tag in INLINE or tag in ("html", "body") or barrier <= depth:
            self.close_from(depth)

    def handle_data(self, data):
        if not self.stack[-1][2]:
            self._text.append(data)


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the kernel reaches three sigma and is cut at the page's ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return (np.convolve(ratios, kernel, "full")[reach:reach + len(ratios)]
            / np.convolve(np.ones_like(ratios), kernel, "full")[reach:reach + len(ratios)])


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.9) -> str:
    """The main text of one page; "" if there is none."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    lines = parser.lines
    length = np.array([len(t) for t, _, _ in lines], np.float64)
    if not len(lines) or not length.sum():
        return ""
    ratios = smooth(length / np.maximum(1, [n for _, n, _ in lines]), sigma)
    content = (ratios >= ratios.std()) & (length > 0)
    if not content.any():
        content = length > 0
    # text of the content clusters inside every element (a parent's number is the smaller one)
    weight = np.zeros(len(parser.parents))
    for (_, _, element), n, chosen in zip(lines, length, content, strict=True):
        if chosen:
            weight[element] += n
    for e in range(len(weight) - 1, 0, -1):
        weight[parser.parents[e]] += weight[e]
    inside = np.zeros(len(weight), bool)
    regions = [e for e, name in enumerate(parser.names) if name in REGIONS and weight[e] > 0]
    if regions:
        inside[regions] = True
    else:
        best = max((e for e in range(len(weight)) if weight[e] >= share * weight[0]))
        while best and parser.names[best] not in ("div", "section", "td", "body", "html", "center"):
            best = parser.parents[best]
        inside[best] = True
    for e in range(1, len(inside)):
        inside[e] |= inside[parser.parents[e]]
    return " ".join(t for t, _, e in lines if t and inside[e])


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
                  sigma: float = 1.0) -> DataFrame:
    """``keep`` columns, text, n_chars (code points) per page."""
    fields = {f.name: f for f in pages.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c].dataType.simpleString()}" for c in keep]
                       + ["text string", "n_chars long"])

    def parse(batches):
        for b in text_slices(batches, html_col):
            texts = [main_text(h, sigma) for h in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(texts, pa.string()),
                                               pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(parse, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages"))
