"""Main text of web pages by text-to-tag ratio."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktide.llm.common import others

#: Fixed values of HTML and of common page layouts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var".split()
)
#: Cells of a row are one block, with a space between them.
SPACED = frozenset("br td th img".split())
NEVER = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea label iframe svg"
    " canvas object audio video menu dialog fieldset".split()
)
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsored promo promotion"
    " cookie cookies consent gdpr notice notices sidebar sidebars aside nav navbar navigation menu menus breadcrumb"
    " breadcrumbs footer header masthead comment comments commentlist disqus replies reply respond share sharing"
    " social related recommended newsletter subscribe subscription popup modal overlay widget toolbar pagination"
    " pager login signup search form topbar topnav subnav sidenav discussion reviews reactions adbox adslot".split()
)
#: Words that mean clutter also at the start of a joined name.
STARTS = ("cookie", "sidebar", "advert", "sponsor", "newsletter", "breadcrumb", "masthead")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NEGATED = re.compile(r"(?:has|no|with|without|is|not)[-_]", re.I)
NEGATIONS = frozenset("has no with without not".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: Elements that may be the container of a content region.
REGIONS = frozenset("body div section td article main center".split())
#: Share of a page's text that its articles must hold to stand for the page.
MAIN_SHARE = 1 / 3
#: Standard deviation, in lines, and reach of the smoothing.
SIGMA, REACH = 1.0, 2
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _hinted(value: str) -> set[str]:
    """Words of a class or id that hint at clutter; one after a negation does not."""
    found = set()
    for one in value.split():
        if not NEGATED.match(one):
            words = [w.lower() for w in _PARTS.split(one)]
            for before, word in zip(["", *words], words):
                if (word in HINTS or word.startswith(STARTS)) and before not in NEGATIONS:
                    found.add(word)
    return found


def _is_clutter(tag: str, attrs: list[tuple[str, str | None]], hints: bool = True) -> bool | str:
    """Whether an element is clutter; "header" for one that may hold the title of an article."""
    if tag in NEVER:
        return True
    if tag in ("html", "body", "main"):
        return False
    found = set()
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if hints and name in ("class", "id"):
            found |= _hinted(value)
    return "header" if found == {"header"} else bool(found)


class _Lines(HTMLParser):
    """Turns parser events into lines: text of a block, tags since the last, and its region.

    Blocks inside clutter are not kept, their tags count for the next line. ``lenient``
    goes by tags alone, and an article or main is content wherever it stands.
    """

    def __init__(self, lenient: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.lenient = lenient
        self.open: list[tuple[str, bool | str, int]] = []  # tag, clutter, region
        self.count: Counter[str] = Counter()  # open elements of every tag
        self.lines: list[tuple[str, int, int]] = []  # text, tags, region
        self.main: set[int] = set()  # regions that are, or are inside, an article or main
        self.regions = 0
        self.parts: list[str] = []
        self.tags = 0

    def _clutter(self) -> bool:
        return bool(self.open and self.open[-1][1])

    def _region(self) -> int:
        return self.open[-1][2] if self.open else 0

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append((text, self.tags, self._region()))
            self.tags = 0

    def _push(self, tag: str, clutter: bool | str, region: int) -> None:
        self.open.append((tag, clutter, region))
        self.count[tag] += 1

    def _close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.count.subtract(t for t, _, _ in self.open[at:])
                del self.open[at:]
                return
            if self.open[at][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in SPACED:
            self.parts.append(" ")
            if tag in VOID:
                return
        elif tag in VOID:
            if tag == "hr":
                self.end_block()
            return
        top = tag in MAIN and self._region() not in self.main  # its class tells its subject
        own = _is_clutter(tag, attrs, not (self.lenient or top))
        clutter = self._clutter() or own
        if self.lenient and tag in MAIN:
            clutter = False
        if tag in INLINE:
            if clutter:  # also those inside clutter, whose end tags must not close it
                self._push(tag, True, self._region())
            return
        if tag not in SPACED:
            self.end_block()
            self._close("p", REGIONS | {"li", "blockquote"})
            if tag == "li":
                self._close("li", frozenset(("ul", "ol", "menu")))
        region = self._region()
        if tag == "header" and not self._clutter():
            clutter = "header"  # its headings come back inside an article
        elif tag in HEADINGS and clutter and self.open and self.open[-1][1] == "header" and region in self.main:
            clutter = bool(own) or any(c is True for _, c, _ in self.open)
        if tag in REGIONS and not clutter:
            inside = region in self.main
            if tag in MAIN or not inside:
                self.regions += 1
                region = self.regions
                if tag in MAIN or inside:
                    self.main.add(region)
        self._push(tag, clutter, region)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in SPACED:
            self.parts.append(" ")
        elif tag not in INLINE:
            self.end_block()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self._clutter():
            self.parts.append(data)


def _content(lines: list[tuple[str, int, int]]) -> set[int]:
    """Lines of the content regions.

    The ratio of a line is its code points over its tags. Ratios are smoothed
    along the page, and those that reach their standard deviation form the
    content cluster. A region counts if most of its text is in the cluster and
    its own ratio is not far below; it is taken whole, so short paragraphs stay.
    """
    size = np.array([len(t) for t, _, _ in lines], dtype=np.float64)
    tags = np.array([max(1, n) for _, n, _ in lines], dtype=np.float64)
    region = np.array([r for _, _, r in lines])
    ratio = size / tags
    offsets = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-(offsets**2) / (2 * SIGMA**2))
    smooth = np.convolve(np.pad(ratio, REACH, mode="edge"), kernel / kernel.sum(), mode="valid")
    level = smooth.std()
    cluster = smooth >= level
    names, at = np.unique(region, return_inverse=True)
    total, marked = np.bincount(at, size), np.bincount(at, size * cluster)
    own = total / np.bincount(at, tags)
    good = (marked * 2 >= total) & (own * 2 >= min(level, own.max()))
    if not good.any():
        good = total == total.max()
    return set(np.flatnonzero(good[at]).tolist())


def main_text(html: str | None) -> str:
    """Blocks of the main content, one a line; empty for null or if there is none.

    A page whose article and main elements hold at least ``MAIN_SHARE`` of its text is
    read inside them only. If clutter takes all of a page (an element left open, a class that
    misleads), the page is read again by its tags alone.
    """
    if not html:
        return ""
    for lenient in (False, True):
        page = _Lines(lenient)
        page.feed(html)
        page.close()
        page.end_block()
        if page.lines:
            break
    else:
        return ""
    lines = [x for x in page.lines if x[2] in page.main]
    size = lambda rows: sum(len(t) for t, _, _ in rows)
    if size(lines) < MAIN_SHARE * size(page.lines):
        lines = page.lines
    chosen = _content(lines)
    return "\n".join(text for i, (text, _, _) in enumerate(lines) if i in chosen)


def extracted(html: str | Column = "html") -> Column:
    """Main text of every whole page."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return of(html)


def extract(pages: DataFrame) -> DataFrame:
    """Every row with ``text`` and ``n_chars``; rows are independent, nothing is shuffled."""
    given = others(pages, "text", "n_chars")
    rows = pages.select(*given, extracted().alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
