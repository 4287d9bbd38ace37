"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, lean

# HTML's elements by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
SKIP = frozenset("head script style noscript template title button select textarea option iframe object svg math canvas audio video".split())
#: What is by its tag no part of an article, a header outside of one too.
BESIDE = frozenset("nav footer aside form dialog menu header".split())
#: A start of one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: A start of the key ends an open element of the values, up to the nearest list or table.
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html article main section".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id that name what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot alert alerts announcement aside banner banners breadcrumb breadcrumbs "
    "colophon comment comments commentlist consent cookie cookies copyright disclaimer disqus feedback footer footers gdpr leaderboard login masthead menu menus "
    "modal nav navbar navigation navi newsletter notice notices notification notifications outbrain overlay pager pagination paywall popup promo promos "
    "promotion promoted recommended related replies respond search share sharing sidebar sidebars signup sitemap skyscraper social sponsor sponsored sponsors "
    "subnav subscribe subscription taboola tags toast toolbar topbar widget widgets".split()
)
MAIN = frozenset("article main".split())
#: Those that noise words never concern.
WHOLE = frozenset("html body article main".split())
#: Elements that hold one paragraph, and are never all of an article.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote caption figcaption summary".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: How an element is marked: by its name or class, or by its tag or role.
NAMED, TAGGED = 1, 2


class _Lines(HTMLParser):
    """Turns events into lines: the text of one block each, with its tags, link text and element. Elements are numbered
    in page order. Every event takes the same time however deep the page is nested."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: (tag, element, skipped, in the article)
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        #: Places in the stack: of each tag, of blocks, of the elements that ENDS_OWN looks up to.
        self.open: dict[str, list[int]] = {}
        self.blocks, self.scopes = [0], [0]
        #: Of each element: its parent, tag, mark, and whether it is the outermost article or main.
        self.parents, self.names, self.marks, self.mains = [0], [""], [0], [False]
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.noisy: dict[str, frozenset[str]] = {}

    def end_line(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.tags, min(self.linked, len(text)), self.stack[-1][1]))
                self.tags = 0
            self.parts = []
        self.linked = 0

    def noise(self, value: str, article: bool) -> bool:
        known = self.noisy.get(value)
        if known is None:
            known = self.noisy[value] = frozenset(SPLIT.split(CAMEL.sub(" ", value).lower()))
        return not NOISE.isdisjoint(known) or not article and "header" in known

    def judged(self, tag: str, attrs: list[tuple[str, str | None]], article: bool) -> tuple[bool, int]:
        """Whether the element is never shown, and its mark."""
        mark = TAGGED if tag in BESIDE and not (tag == "header" and article) else 0
        for name, value in attrs:
            if (name == "hidden" or name == "aria-hidden" and value == "true") and tag not in WHOLE:
                return True, 0
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True, 0
            if name == "role" and value and value.lower() in ROLES:
                mark = TAGGED
            if value and name in ("class", "id") and self.noise(value, article) and (tag not in WHOLE or tag == "article" and "comment" in value.lower()):
                mark = mark or NAMED
        return tag in SKIP, mark

    def pop_to(self, at: int) -> None:
        if self.stack[at][0] not in INLINE:
            self.end_line()
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            for places in (self.blocks, self.scopes):
                if places[-1] == len(self.stack):
                    places.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            elif tag == "br" and not self.stack[-1][2]:
                self.parts.append(" ")
            return
        if tag in INLINE:
            self.links += tag == "a"
            if attrs and any(self.judged(tag, attrs, True)):
                self.push(tag, True, 0, False)
            return
        if tag in ENDS_P and (p := self.open.get("p")) and p[-1] == self.blocks[-1]:
            self.pop_to(p[-1])
        if own := ENDS_OWN.get(tag):
            at = max(places[-1] if (places := self.open.get(o)) else 0 for o in own)
            if at > self.scopes[-1]:
                self.pop_to(at)
        article = self.stack[-1][3] or tag in MAIN or any(n == "role" and v == "main" for n, v in attrs)
        self.push(tag, *self.judged(tag, attrs, article), article)

    def push(self, tag: str, skip: bool, mark: int, article: bool) -> None:
        at = len(self.stack)
        if tag not in INLINE:
            self.end_line()
            self.links = 0
            self.blocks.append(at)
            if tag in SCOPES:
                self.scopes.append(at)
        _, node, above, inside = self.stack[-1]
        self.parents.append(node)
        self.names.append(tag)
        self.marks.append(mark)
        self.mains.append(article and not inside)
        self.open.setdefault(tag, []).append(at)
        self.stack.append((tag, len(self.parents) - 1, above or skip, article))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        if (places := self.open.get(tag)) and (tag not in INLINE or places[-1] > self.blocks[-1]):
            self.pop_to(places[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def done(self) -> None:
        self.close()
        self.end_line()


def smoothed(ratios: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """The ratios under a Gaussian kernel that ends at three deviations and at the page's edges, to nine places, so that
    equal lines stay equal."""
    r = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[r : r + len(ratios)]
    return np.round(full / np.convolve(np.ones(len(ratios)), kernel)[r : r + len(ratios)], 9)


def threshold(values: np.ndarray) -> float:
    """Midway between the centres of two clusters of the values (one-dimensional 2-means from the extremes)."""
    low, high = float(values.min()), float(values.max())
    cut = (low + high) / 2
    for _ in range(20):
        above = values >= cut
        if above.all() or not above.any():
            break
        new = (values[above].mean() + values[~above].mean()) / 2
        if new == cut:
            break
        cut = new
    return cut


def upper(ratios: np.ndarray) -> np.ndarray:
    """Which lines lie in the upper of the two clusters of smoothed ratios."""
    even = smoothed(ratios)
    return even >= threshold(even)


class _Tree:
    """Sums and ranges over the elements of a page; every method is linear in their number."""

    def __init__(self, page: _Lines) -> None:
        self.page, self.parents = page, page.parents
        self.node = np.array([x[3] for x in page.lines], np.int64)
        self.last = list(range(len(self.parents)))
        for n in range(len(self.parents) - 1, 0, -1):
            self.last[self.parents[n]] = max(self.last[self.parents[n]], self.last[n])

    def held(self, weight: np.ndarray) -> list[float]:
        """What the lines in each element weigh together."""
        out = np.bincount(self.node, weight, len(self.parents)).tolist()
        for n in range(len(out) - 1, 0, -1):
            out[self.parents[n]] += out[n]
        return out

    def within(self, n: int) -> np.ndarray:
        """Which lines element n holds."""
        return (self.node >= n) & (self.node <= self.last[n])

    def beside(self, mass: list[float]) -> np.ndarray:
        """Which lines belong to elements that are marked and do not turn out to hold the article.

        A mark is a guess by name. It is taken back if the element holds the heaviest article or main element or, on
        pages without one, nearly all of the text: what is left outside weighs next to nothing beside it.
        """
        page, parents, marks = self.page, self.parents, list(self.page.marks)
        above, inner, tops = [0] * len(marks), {}, []
        for n in range(1, len(marks)):
            above[n] = parents[n] if marks[parents[n]] else above[parents[n]]
            if marks[n]:
                inner.setdefault(above[n], []).append(n)
        mains = [n for n, x in enumerate(page.mains) if x and mass[n] > 0]
        heads = [0] * len(marks)
        for n in range(len(marks) - 1, 0, -1):
            heads[n] += page.names[n] == "h1"
            heads[parents[n]] += heads[n]
        if mains:
            free = [n for n in mains if not marks[n] and not above[n]]
            best = max(mains, key=lambda n: mass[n])
            if free and mass[top := max(free, key=lambda n: mass[n])] >= 0.25 * mass[best]:
                best = top
            n = best if marks[best] else above[best]
            while n:
                marks[n], n = 0, above[n]
        else:
            tops = [(-mass[n], n) for n in inner.get(0, [])]
            heapq.heapify(tops)
            rest, titles = mass[0] + sum(x for x, _ in tops), heads[0] - sum(heads[n] for _, n in tops)
            while tops:
                own, n = -tops[0][0], tops[0][1]
                share = 0.02 if marks[n] == TAGGED else 0.5 if heads[n] and not titles else 0.1
                if rest >= share * own:
                    break
                heapq.heappop(tops)
                marks[n] = 0
                rest, titles = rest + own, titles + heads[n]
                for k in inner.get(n, []):
                    heapq.heappush(tops, (-mass[k], k))
                    rest, titles = rest - mass[k], titles - heads[k]
        out = [False] * len(marks)
        for n in range(1, len(marks)):
            out[n] = bool(marks[n]) or out[parents[n]]
        return np.array(out)[self.node]


def blocks(html: str | None) -> list[str]:
    """The text blocks of the page's main content, in page order.

    Every line (one block of text) gets the ratio of its unlinked characters to its tags; the smoothed ratios fall
    into two clusters. Elements marked by tag, role or class as no part of an article weigh less, unless they hold
    what the upper cluster is made of, and the lines are clustered again. The region is the article or main elements
    if they hold enough of the upper cluster's text, or else the deepest element, but no single paragraph, that holds
    all of it. All lines of the region stay, short ones too, but for those of marked elements and, outside an article
    element, menus: three or more lines in a row that are mostly links, before or behind all of the upper cluster.
    """
    page = _Lines()
    page.feed(html or "")
    page.done()
    lines = page.lines
    if not lines:
        return []
    size = np.array([len(x[0]) for x in lines], float)
    links = np.array([x[2] for x in lines], float)
    tags = np.array([max(x[1], 1) for x in lines], float)
    ratios, plain = np.log1p((size - links) / tags), size - links
    tree = _Tree(page)
    beside = tree.beside(tree.held(np.where(upper(ratios), plain, 0.0)))
    weight = np.where(upper(ratios * np.where(beside, 0.25, 1.0)) & ~beside, plain, 0.0)
    held = tree.held(weight)
    total = held[0]
    mains = [n for n, x in enumerate(page.mains) if x and held[n] > 0]
    mains = [n for n in mains if held[n] >= 0.25 * max(held[m] for m in mains)]
    if mains and sum(held[n] for n in mains) >= 0.3 * total:
        region = np.logical_or.reduce([tree.within(n) for n in mains])
        return [lines[k][0] for k in np.flatnonzero(region & ~beside)]
    root = 0
    if total:
        root = max(n for n, w in enumerate(held) if w >= total * (1 - 1e-9))
        while root and (page.names[root] in PARAGRAPHS or np.count_nonzero(tree.within(root)) < 2):
            root = page.parents[root]
    chosen = np.flatnonzero(tree.within(root) & ~beside).tolist()
    core = np.flatnonzero(weight)
    menu: set[int] = set()
    run: list[int] = []
    for k in [*chosen, -1]:
        if k >= 0 and 2 * links[k] > size[k] and len(core) and not core[0] < k < core[-1]:
            run.append(k)
            continue
        if len(run) > 2:
            menu.update(run)
        run = []
    return [lines[k][0] for k in chosen if k not in menu]


def main_text(html: str | None) -> str:
    return "\n".join(blocks(html))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without `html`, with text and n_chars (code points), underscored where pages has such columns.

    Null, empty and text-free pages give an empty text; repeated rows stay repeated; an empty table gives no rows.
    Very long and very deeply nested pages take time in proportion to their length. Each page is parsed in one pass on its own; nothing is shuffled, and rows stay as they are.
    """
    rest = [c for c in pages.columns if c != html]
    text, n_chars = fresh(pages.select(*rest), "text", "n_chars")
    slim = pages.select(*rest, F.col(html).alias("\0html"))
    schema = slim.drop("\0html").withColumn(text, F.lit("")).withColumn(n_chars, F.lit(0).cast("long")).schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = [main_text(v.as_py()) for v in part.column(len(rest))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], schema.names)

    return slim.mapInArrow(lean(parse), schema)
