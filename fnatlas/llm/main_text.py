"""Main text of web pages by smoothed text-to-tag ratios.

A streaming parser's events cut a page into blocks (the lines of the method: a heading, paragraph, list item and so on), each with its
characters, tags, links and the element that it stands in. The logarithms of the blocks' text-to-tag ratios, smoothed by a
Gaussian, are cut into two clusters by the threshold with the least squares inside; clusters whose means are less than a
factor of 4 apart are one. The ratios then decide:

- An article or main element is content if it has a block of the upper cluster. Without such an element, the content region is the
  smallest element around all blocks of the upper cluster, with headings and paragraphs that stand directly in the elements around it;
  other elements beside it, of the lower cluster, are left out.
- Inside the region a block, or an element of blocks, of the lower cluster goes if nearly all of its text is in three links or more (two, without an article): a menu that
  nothing names. All other blocks stay, short ones too.

Elements that HTML itself sets apart (nav, footer, aside, form, script, style and so on; header outside of an article), hidden ones and roles of that
kind never give blocks. What a ratio can't tell from prose, such as a reader's comment or an advert in a sentence, is left out if a
whole class name or the id is one of MARKED; names that merely contain such a word mean nothing.

Null and empty pages give empty text. Pages are whole; a page that ends in the middle of an
element is read to its end. Repeated rows are each returned. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's; a header is only inside an article or main.
_NEVER = frozenset("aside button canvas dialog footer form head iframe label menu nav noscript object option script select style svg template textarea title".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Whole class names and ids of what a ratio can't tell from an article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense ad-container ad-slot banner breadcrumb breadcrumbs comment comments comment-list commentlist comment-section comments-section consent cookie cookies cookie-banner cookie-consent cookie-notice "
    "disqus_thread footer gdpr header login menu modal nav navbar navigation newsletter notice notices notification notifications page-footer page-header pager pagination popup promo promotion reader-comments related related-posts reply replies respond "
    "share sharing share-buttons sidebar signup site-footer site-header social social-links sponsor sponsored sponsored-content subscribe toolbar user-comments widget".split()
)
#: Parts of a page that may be left out by their ratio.
_PARTS = frozenset("article section div ul ol dl table tbody tr td th li dd dt main center details".split())
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Means of the clusters that are closer than this (in logarithms) are one; links and share of a menu.
APART, MENU_LINKS, MENU_SHARE = float(np.log(4)), {"article": 3, "page": 2}, 0.8
#: A closed paragraph ends where one of these begins.
_LIGHT = frozenset({"p", "li", "dt", "dd", "option", "tr", "td", "th"})
#: A stray end tag inside one of these doesn't leave it.
_WALLS = frozenset({"article", "main", "body", "nav", "footer", "aside", "header", "form", "table"})


@dataclass
class Block:
    text: str
    tags: int
    element: int
    links: int
    link_chars: int


class _Blocks(HTMLParser):
    """Blocks, and the tree of block elements (element 0 is the page)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[Block] = []
        self.parts: list[str] = []
        self.tags = self.links = self.link_chars = 0
        self.open: list[tuple[str, bool, int]] = []  # element, whether it begins an excluded part, the element around it
        self.places: dict[str, list[int]] = {}  # each element's places in open
        self.walls: list[int] = []  # places of _WALLS in open
        self.hidden = 0
        self.element = 0
        self.parents, self.kinds = [-1], ["page"]

    def cut(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.done.append(Block(text, self.tags, self.element, self.links, self.link_chars))
            self.tags = self.links = self.link_chars = 0
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if (tag in _BLOCKS or tag == "body") and (k := next((k for k, x in enumerate(self.open[:3]) if x[0] == "head"), None)) is not None:
            self._close(k)  # a head that isn't closed ends where the body begins
        if tag in _BLOCKS:
            self.cut()
        if tag == "br":
            self.parts.append(" ")
        if not self.hidden:
            self.tags += 1
            self.links += tag == "a"
        if tag in _VOID:
            return
        if tag in _BLOCKS and self.open and self.open[-1][0] in _LIGHT and (tag in _LIGHT or self.open[-1][0] == "p"):
            self._close(len(self.open) - 1)
        a = dict(attrs)
        names = {*(a.get("class") or "").lower().split(), (a.get("id") or "").lower().strip()}
        apart = tag in _NEVER or tag == "header" and not (self.places.get("article") or self.places.get("main"))
        out = apart or tag not in ("html", "body", "article", "main") and ((a.get("role") or "").lower() in _ROLES or bool(names & MARKED) or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true")
        # an article among the comments is inside an excluded part anyway
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in _WALLS:
            self.walls.append(len(self.open))
        self.open.append((tag, out, self.element))
        self.hidden += out
        if tag in _BLOCKS and not self.hidden:
            self.parents.append(self.element)
            self.kinds.append(tag)
            self.element = len(self.kinds) - 1

    handle_startendtag = handle_starttag

    def parse_html_declaration(self, i: int) -> int:
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        try:
            k = super().parse_html_declaration(i)
        except AssertionError:  # no keyword that the parser knows
            k = -1
        return k if k >= 0 else self.parse_bogus_comment(i)

    def _drop(self, k: int) -> None:
        for tag, _, _ in self.open[k:]:
            self.places[tag].pop()
            if tag in _WALLS:
                self.walls.pop()
        del self.open[k:]

    def _close(self, k: int) -> None:
        self.cut()
        for _, out, around in reversed(self.open[k:]):
            self.hidden -= out
            self.element = around
        self._drop(k)

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.hidden
        k = at[-1] if (at := self.places.get(tag)) else -1
        if tag not in _BLOCKS and self.walls and self.walls[-1] > k:
            return  # a stray end tag doesn't leave its surroundings
        if k < 0:
            if tag in _BLOCKS:
                self.cut()
        elif tag in _BLOCKS or any(t in _BLOCKS or out for t, out, _ in self.open[k:]):
            self._close(k)
        else:
            self._drop(k)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.places.get("a"):
                self.link_chars += len("".join(data.split()))


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), "valid")


def _upper(x: np.ndarray) -> np.ndarray:
    """Which values are in the upper of two clusters: the cut of the sorted values with the least squared distances inside."""
    v = np.sort(x)
    n = len(v)
    if n < 2 or v[0] == v[-1]:
        return np.ones(n, bool)
    s, q = np.cumsum(v), np.cumsum(v * v)
    k = np.arange(1, n)
    inside = np.where(v[1:] > v[:-1], q[:-1] - s[:-1] ** 2 / k + (q[-1] - q[:-1]) - (s[-1] - s[:-1]) ** 2 / (n - k), np.inf)
    at = int(np.argmin(inside)) + 1
    if v[at:].mean() - v[:at].mean() < APART:
        return np.ones(n, bool)
    return x >= v[at]


def _ratios(done: list[Block]) -> np.ndarray:
    """The smoothed logarithms of the blocks' text-to-tag ratios."""
    return _smooth(np.log1p(np.array([len(b.text) / max(1, b.tags) for b in done])), SIGMA)


def _menu(where: str, chars: int, link_chars: int, links: int) -> bool:
    return links >= MENU_LINKS[where] and link_chars >= MENU_SHARE * chars


def _stays(done: list[Block], parents: list[int], kinds: list[str], high: np.ndarray) -> list[bool]:
    """Which blocks are content. Elements come after the elements around them."""
    n = len(kinds)
    tall, chars, link_chars, links, outer = [False] * n, [0] * n, [0] * n, [0] * n, [-1] * n
    for b, h in zip(done, high, strict=True):
        e = b.element
        tall[e] |= bool(h)
        chars[e] += len("".join(b.text.split()))
        link_chars[e] += b.link_chars
        links[e] += b.links
    for e in range(n):  # outer: the outermost article or main around an element
        around = outer[parents[e]] if e else -1
        outer[e] = around if around >= 0 else e if kinds[e] in ("article", "main") else -1
    for e in range(n - 1, 0, -1):
        tall[parents[e]] |= tall[e]
        for x in (chars, link_chars, links):
            x[parents[e]] += x[e]
    where = "article" if any(tall[e] and outer[e] == e for e in range(n)) else "page"
    if where == "article":
        inside = [outer[e] >= 0 and tall[outer[e]] for e in range(n)]
    else:
        region = 0  # down as long as one element has all that is high
        while True:
            below = [e for e in range(region + 1, n) if parents[e] == region and tall[e]]
            direct = any(h and b.element == region for b, h in zip(done, high, strict=True))
            if direct or len(below) != 1 or kinds[below[0]] not in _PARTS:
                break
            region = below[0]
        around, e = set(), region
        while e >= 0:
            around.add(e)
            e = parents[e]
        inside = [False] * n
        for e in range(n):
            inside[e] = e in around or parents[e] >= 0 and (inside[parents[e]] and parents[e] not in around or parents[e] == region or parents[e] in around and kinds[e] in _PLAIN)
    for e in range(1, n):
        menu = kinds[e] in _PARTS and not tall[e] and _menu(where, chars[e], link_chars[e], links[e])  # that nothing names
        if menu or not inside[parents[e]] and outer[e] != e:
            inside[e] = False
    return [inside[b.element] and (bool(h) or not _menu(where, len("".join(b.text.split())), b.link_chars, b.links)) for b, h in zip(done, high, strict=True)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    if not parser.done:
        return ""
    stay = _stays(parser.done, parser.parents, parser.kinds, _upper(_ratios(parser.done)))
    return " ".join(b.text for b, s in zip(parser.done, stay, strict=True) if s)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
