"""Main text of HTML pages by text-to-tag ratios (Weninger et al. 2010, CETR) over streaming parser events.

The standard library's parser reports events; a page becomes lines, one per block element's text, each with its tags, the
share of its text that is links, and its element. Parts that are no article by their element, role or class (menus,
headers, footers, notices, adverts, forms, comments, ...) are left out. The name of a wrapper, or a form, does not count
for an article or main element inside it; one inside a part named for comments, teasers or the like, or inside an element
that is no article, counts if the page has no other.

The ratio of text to tags of the remaining lines is smoothed by a Gaussian and split into two clusters by a threshold.
The content region is the deepest article or main element that holds most of the text of the upper cluster, or else the
deepest element that holds all of it. Within the region lines of the upper cluster are content. Lines of the lower one
are too if they are text between such lines, or, where an article or main element marks the region, anywhere in it; where
nothing marks it, at its ends only headings and paragraphs that are siblings of content. Lines of the lower cluster that
are nothing but links (lists of links without a name) are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.common import table

# Element names of HTML and words of common class names.
RAW = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "select", "option", "datalist"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "input", "label"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: An element that holds one of these names in its class or id is no article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|paywall|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|toolbar|topbar|masthead|site-header|page-header|header|footer|site-footer|copyright|sidebar|side-bar|aside|widget|widgets|related|recommended|recommendations|more-stories|"
    r"share|sharing|social|comment|comments|commentlist|reply|replies|respond|disqus|discussion|login|signup|search|pagination|pager|tags|tag-list|skip-link|toc)(?:$|[\s_-])",
    re.I,
)
KEPT = {"html", "body", "main", "article"}
HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"}
#: Names of parts whose articles are no article of the page: comments, teasers, adverts.
ASIDE = re.compile(r"comment|repl|respond|disqus|discussion|sidebar|(?:^|[\s_-])ads?(?:$|[\s_-])|advert|promo|sponsor|related|recommend|more-stories|widget|popup|modal|overlay|newsletter|cookie|consent", re.I)
#: Names that say what a layout has, not what it is.
LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|have|with|without|no)[-_](?:(?:left|right|both)[-_])?[a-z]+", re.I)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that a block ends even if their end tag is missing.
UNENDED = ("title", "textarea", "select", "option", "datalist")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose text stands beside that of their siblings.
TEXT = HEADINGS | {"p", "li", "dt", "dd", "blockquote", "pre", "figcaption", "caption", "address", "summary"}
NO_ARTICLE = re.compile(r"comment|repl|sidebar|(?:^|[\s_-])ads?(?:$|[\s_-])|promo|sponsor|related", re.I)
SPACES = re.compile(r"\s+")
#: Heads and bodies of the article itself, whatever their names hold.
OWN = re.compile(r"(?:article|entry|post|story|content|main|page)[-_]?(?:header|head|title|heading|body|content|text|inner|wrap|wrapper|main)", re.I)


class Line(NamedTuple):
    """``outside`` is 0 for parts of an article, 1 for wrappers that give way to an article or main inside them, 2 for parts
    that do so only if there is no other, 3 for an article or main in such a part, and 4 for hidden parts."""

    text: str
    tags: int
    linked: float
    element: int
    outside: int


class _Open(NamedTuple):
    name: str
    block: int  # number of the nearest block element
    outside: int
    shut: bool  # its text is not shown
    link: bool


class _Lines(HTMLParser):
    """Collects a Line for each block. Elements are numbered as they open; work per event does not grow with the depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open = [_Open("", 0, 0, False, False)]
        self.often: dict[str, int] = {}  # open elements by name
        self.names, self.parents = [""], [0]  # of block elements by number
        self.parts: list[str] = []
        self.tags = self.inked = self.link_inked = 0

    def line(self) -> None:
        if self.parts:
            text = SPACES.sub(" ", "".join(self.parts)).strip()
            if text:
                top = self.open[-1]
                self.lines.append(Line(text, self.tags, self.link_inked / max(1, self.inked), top.block, top.outside))
                self.tags = 0
            self.parts = []
            self.inked = self.link_inked = 0

    def _implied(self, tag: str) -> None:
        """Close what a start tag ends without an end tag."""
        if self.often.get("head") and tag not in HEAD:
            self._close("head")
        if tag in BLOCK:
            for name in UNENDED:
                if self.often.get(name):
                    self._close(name)
            if self.names[self.open[-1].block] == "p":
                self._close("p")
        elif tag in ("option", "optgroup") and self.open[-1].name == "option":
            self._close("option")
        if tag in CLOSES and self.names[self.open[-1].block] in CLOSES[tag]:
            self._close(self.names[self.open[-1].block])

    def _outside(self, tag: str, attrs: list, outside: int) -> int:
        block = tag in BLOCK
        in_article = outside == 0 and (self.often.get("article") or self.often.get("main"))
        if tag in ("article", "main") and outside in (1, 2):
            outside = 0 if outside == 1 else 3
        inside = outside in (0, 3)
        if tag in OUTSIDE and not (tag == "header" and in_article):
            outside = max(outside, 1 if tag in ("form", "fieldset") and inside else 2) if outside != 3 else 2
        if not attrs or tag in ("html", "body"):
            return outside
        a = dict(attrs)
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower():
            return 4
        if outside not in (0, 1, 3) or not block:  # the name of a word inside a paragraph says nothing of the paragraph
            return outside
        named, role = OWN.sub("", f"{a.get('class') or ''} {a.get('id') or ''}"), (a.get("role") or "").lower()
        if tag == "header" and in_article:
            named = re.sub("header", "", named, flags=re.I)
        plain = LAYOUT.sub("", named)
        if role in ROLES - {"form"}:
            return 2
        if named.strip() and BOILERPLATE.search(named) and (tag not in KEPT or NO_ARTICLE.search(plain)):
            return 2 if ASIDE.search(plain) or outside == 3 else 1
        if role == "form":
            return 2 if outside == 3 else 1
        return outside

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.line()
        self.tags += 1
        if tag in ("br", "wbr"):
            self.parts.append(" " if tag == "br" else "")
            return
        self._implied(tag)
        if tag in VOID:
            return
        top = self.open[-1]
        block = top.block
        if tag in BLOCK:
            self.names.append(tag)
            self.parents.append(block)
            block = len(self.names) - 1
        self.open.append(_Open(tag, block, self._outside(tag, attrs, top.outside), top.shut or tag in RAW, top.link or tag == "a"))
        self.often[tag] = self.often.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no self-closing elements but the void ones

    def _close(self, tag: str) -> None:
        """Close the innermost open element of that name and what is open in it."""
        if tag in BLOCK:
            self.line()
        while True:
            gone = self.open.pop()
            self.often[gone.name] -= 1
            if gone.name == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        elif self.often.get(tag) and (tag in BLOCK or any(x.name == tag for x in self.open[-12:])):
            self._close(tag)
        elif tag in BLOCK:
            self.line()

    def handle_data(self, data: str) -> None:
        if self.often.get("head") and self.open[-1].name == "head" and data.strip():
            self._close("head")
        top = self.open[-1]
        if top.shut or top.name not in BLOCK and top.outside > 0 and self._block_outside() == 0:
            return
        self.parts.append(data)
        size = len(data) - data.count(" ")
        self.inked += size
        self.link_inked += size if top.link else 0

    def _block_outside(self) -> int:
        """``outside`` of the nearest block element; inline elements nest a few deep at most where it matters."""
        return next((x.outside for x in reversed(self.open[-12:]) if x.name in BLOCK or not x.name), 0)

    def unknown_decl(self, data: str) -> None:
        pass


def page_lines(html: str) -> _Lines:
    """The parser after the whole page. Sections that it refuses are skipped."""
    p = _Lines()
    try:
        p.feed(html)
        p.close()
    except AssertionError:
        p = _Lines()
        p.feed(re.sub(r"<!\[[^>]*>", " ", html))
        p.close()
    p.line()
    return p


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, the ends padded with their own values."""
    radius = max(1, int(np.ceil(sigma)))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, radius, mode="edge"), k / k.sum(), "valid")


def content_cluster(ratio: np.ndarray) -> np.ndarray:
    """Upper of two clusters of the smoothed ratios: the threshold halves the distance of the clusters' means. Means that differ by less than half are one cluster."""
    cut = ratio.mean()
    for _ in range(50):
        high = ratio >= cut
        if high.all() or not high.any() or ratio[~high].mean() >= ratio[high].mean() / 2:
            return np.ones(len(ratio), bool)
        new = (ratio[high].mean() + ratio[~high].mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return ratio >= cut


def _inside(element: int, parents: list[int]) -> list[bool]:
    """Which elements lie in ``element``, itself included: parents have smaller numbers."""
    out = [False] * len(parents)
    out[element] = True
    for e in range(element + 1, len(parents)):
        out[e] = out[parents[e]]
    return out


def _region(lines: list[Line], upper: np.ndarray, names: list[str], parents: list[int], most: float) -> tuple[int, bool]:
    """(content region, whether an article or main element marks it)."""
    held, often = [0] * len(names), [0] * len(names)
    for x, up in zip(lines, upper, strict=True):
        if up:
            held[x.element] += len(x.text)
            often[x.element] += 1
    for e in range(len(names) - 1, 0, -1):
        held[parents[e]] += held[e]
        often[parents[e]] += often[e]
    marked = max((e for e in range(1, len(names)) if names[e] in ("article", "main") and held[e] >= most * held[0] > 0), default=0)
    return marked or max((e for e in range(1, len(names)) if names[e] in ("section", "div", "td", "body") and often[e] == often[0]), default=0), marked > 0


def content_lines(lines: list[Line], upper: np.ndarray, sure: np.ndarray, names: list[str], parents: list[int], most: float = 0.8) -> list[Line]:
    """The lines of the content region that are content; see the module's description.

    ``sure`` are lines of the upper cluster by their own ratio and not only by that of their neighbours: a region that
    nothing marks starts and ends with such lines.
    """
    region, marked = _region(lines, sure, names, parents, most)
    inside = _inside(region, parents)
    here = [(x, bool(up), bool(own)) for x, up, own in zip(lines, upper, sure, strict=True) if inside[x.element]]
    high = [k for k, (_, _, own) in enumerate(here) if own]
    if not high:
        return []
    links = [not up and x.linked > 0.9 for x, up, _ in here]
    first, last = (0, len(here) - 1) if marked else (high[0], high[-1])
    kept = [k for k in range(first, last + 1) if not links[k]]
    home = lambda k: parents[here[k][0].element] if names[here[k][0].element] in TEXT else here[k][0].element  # noqa: E731  the element whose children the texts are

    def joins(k: int, near: int) -> bool:
        """The line is a paragraph or heading beside the content line; a heading may stand one element higher or lower."""
        if links[k] or names[here[k][0].element] not in TEXT and home(k) != home(near):
            return False
        own = {home(k), parents[home(k)]} if names[here[k][0].element] in HEADINGS else {home(k)}
        return bool(own & {home(near), parents[home(near)]}) if len(own) > 1 else home(k) == home(near)

    while first > 0 and joins(first - 1, first):
        first -= 1
        kept.insert(0, first)
    while last < len(here) - 1 and joins(last + 1, last):
        last += 1
        kept.append(last)
    return [here[k][0] for k in kept]


def main_text(html: str | None, sigma: float = 1.0, cluster: Callable[[np.ndarray], np.ndarray] = content_cluster) -> str:
    """Blocks of the article, joined by line feeds; empty if nothing on the page is an article."""
    if not html:
        return ""
    page = page_lines(html)
    names, parents = page.names, page.parents
    lines = [x for x in page.lines if not x.outside]
    in_article = [False] * len(names)
    for e in range(1, len(names)):
        in_article[e] = names[e] in ("article", "main") or in_article[parents[e]]
    if not any(in_article[x.element] for x in lines):
        lines = [x for x in page.lines if x.outside in (0, 3)]
    if not lines:
        return ""
    own = np.array([len(x.text) / max(x.tags, 1) for x in lines])
    ratio = smoothed(own, sigma)
    upper = cluster(ratio)
    sure = upper if upper.all() else upper & (own >= ratio[upper].min() - 1e-9)
    return "\n".join(x.text for x in content_lines(lines, upper, sure, names, parents))


def extract_articles(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Defined cases: a null or empty page gives an empty text, as does one on which nothing is an article; plain text comes
    back with its white space folded; truncated tags are read as the parser reads them; ``head``, ``title``, ``p``, ``li``,
    ``option`` and the like end where HTML lets their end tags be left out; repeated rows give repeated rows; a null page_id
    or url is kept; very long or deeply nested pages take time in proportion to their length; an empty table gives an empty
    table; extra columns are ignored. ``br`` is white space.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages"))
