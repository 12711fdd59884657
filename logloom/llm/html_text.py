"""Main text of web pages by text-to-tag ratios over a stream of parser events.

The standard library's parser streams a page's events. Every block-level tag ends a line; a line's
ratio is its text length, links left out, over the tags met in it. What tags, roles, classes and ids
say is a prior: it scales the ratio of a line in a sidebar, notice, advert, form or the like. The
ratios are smoothed by a Gaussian and split into two clusters by a threshold between their means.
Lines of the upper cluster are the seeds of the content region:

- where most of the seeds' weight lies in article and main elements, the region is all of these;
- else it is the smallest block that holds all seeds, with the lines without links right above it.
  Rows of nothing but links outside the seeds are menus there: lines of two or more links, and
  above the seeds runs of two or more such lines.

All lines of the region are text, short ones too, but for those that the prior speaks against:
they stay where the ratios put them into the upper cluster nevertheless. Marks of elements around
the whole region say nothing about it. Menus, page headers, footers and asides by tag or role, and
what is silent (scripts, styles), are no text in any case.

Defined results: a null or empty page, and one without a content line, gives an empty text;
repeated rows give equal texts; an empty table gives no rows; unclosed, crossed and unknown tags
are tolerated; a very long page is parsed whole, by itself. Columns other than page_id, url and
html are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import bounded_batches, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never text of the page.
SILENT = frozenset("head title script style noscript template textarea select option button svg math canvas audio video object iframe datalist".split())
#: Boilerplate, unless the article lies inside.
FRAME = frozenset("nav header footer menu dialog".split())
#: Boilerplate wherever it stands.
ASIDE = frozenset("aside".split())
#: Boilerplate by the prior.
LIKELY = frozenset("form".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
#: Words of class and id names that mark boilerplate.
MARKS = frozenset(
    """ad ads adv advert advertisement adverts adsense adslot advertising banner sponsor sponsored promo promotion promoted
    cookie cookies consent gdpr notice notification alert popup modal overlay paywall newsletter subscribe signup subscription
    sidebar sidebars aside rail widget widgets related recommended recommendations trending popular
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead
    footer footers copyright legal disclaimer
    comment comments commentlist respond reply replies disqus
    share sharing social login search searchbox form skip""".split()
)
#: Those that a text has for its own subjects: on a part of a text in an article they mark nothing.
SUBJECTS = frozenset("promotion notice alert rail related recommended recommendations trending popular navigation copyright legal disclaimer social search form reply replies share sharing login menu".split())
#: Words that may stand beside MARKS in a name; a name with any other word marks nothing.
BESIDE = frozenset(
    """area bar block body bottom box button buttons card cards col column container content div fixed float grid group head header holder icon icons
    inner item items left link links list main middle nav out outer page panel post posts primary region right row secondary section site slot sticky
    story stories tab tabs text thread title top under unit wrap wrapper zone js module modules more also this us my the by a b c d""".split()
)
CONTENT_ROOTS = frozenset("article main".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Where the search for an implied end stops.
SCOPES = frozenset("html body article main section div table ul ol dl td th blockquote aside nav header footer form".split())
#: Parts of a text; the block that contains a text is none of them.
PARTS = frozenset("p pre blockquote figure figcaption ul ol li dl dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6".split())
SIGMA = 1.0
#: What the prior leaves of a marked line's ratio.
MARKED = 0.01
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named(names: str, but: frozenset[str]) -> bool:
    """Whether one of the names has a word of MARKS that is none of ``but``, and no words but marks, numbers and those of BESIDE."""
    for name in names.split():
        words = [w for w in _NAME.findall(_CAMEL.sub(" ", name).lower()) if not w.isdigit()]
        if any(w in MARKS and w not in but for w in words) and all(w in MARKS or w in BESIDE for w in words):
            return True
    return False


def _mark(tag: str, attrs: list[tuple[str, str | None]], in_root: bool) -> int:
    """2: not shown, or boilerplate by its role; 1: boilerplate by its names; 0: neither."""
    out = 0
    part = tag in PARTS and in_root
    for k, v in attrs:
        v = v or ""
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and _HIDDEN.search(v)) or (k == "role" and v.strip().lower() in ROLES):
            return 2
        if k == "class" or (k == "id" and not part):  # ids of a text's parts are anchors
            out = max(out, int(_named(v, SUBJECTS if part else frozenset())))
    return out


class Lines(HTMLParser):
    """Collects (text, tags, link characters, boilerplate, content root, block, links if it has no other words, marking block) of each line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.anchors, self.plain = 0, False  # of the line: links, words outside them
        self.blocks: list[list] = [["", 0, None]]  # tag, parent and last block inside (None: open) of each block; the page is 0
        # tag, silent, boilerplate, root, sticky, block, marking block (0: none)
        self.stack: list[tuple[str, bool, bool, int, bool, int, int]] = []
        self.open: Counter[str] = Counter()
        self.roots = 0

    def _top(self) -> tuple[str, bool, bool, int, bool, int, int]:
        return self.stack[-1] if self.stack else ("", False, False, 0, False, 0, 0)

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, _, boiler, root, _, block, mark = self._top()
            self.lines.append((text, self.tags, min(self.linked, len(text)), boiler, root, block, 0 if self.plain else self.anchors, mark))
            self.tags = 0
        self.parts, self.linked = [], 0
        self.anchors, self.plain = int(self.links > 0), False

    def _pop_to(self, tag: str) -> None:
        while self.stack:
            got, *_, block, _ = self.stack.pop()
            if got not in INLINE:
                self.blocks[block][2] = len(self.blocks) - 1
            self.open[got] -= 1
            self.links -= got == "a"
            if got == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._end_line()
        elif tag in ("br", "wbr", "img"):
            self.parts.append(" " if tag == "br" else "")
        self.tags += 1
        if (ends := CLOSES.get(tag)) and any(self.open[x] for x in ends):
            for entry in reversed(self.stack):
                if entry[0] in ends:
                    self._pop_to(entry[0])
                    break
                if entry[0] in SCOPES:
                    break
        if tag in VOID:
            return
        if tag == "body" and self.open["head"]:
            self._pop_to("head")
        _, silent, boiler, root, sticky, block, mark = self._top()
        marked = _mark(tag, attrs, root > 0) if tag not in ("html", "body") else 0
        silent = silent or tag in SILENT
        if tag in INLINE:  # of a line's own parts the marked ones are no text
            silent = silent or marked > 0
        else:
            self.blocks.append([tag, block, None])
            block = len(self.blocks) - 1
            if (tag in CONTENT_ROOTS or ("role", "main") in attrs) and not marked:
                if not sticky:
                    boiler, mark = False, 0
                if not root or not (boiler or mark):
                    self.roots += 1
                    root = self.roots if tag == "article" or not root else root
            if marked == 2 or tag in ASIDE:
                boiler = sticky = True
            elif tag in FRAME and not (tag == "header" and root):
                boiler = True
            if marked or tag in LIKELY:
                mark = mark or block
                sticky = sticky or marked > 0
        self.stack.append((tag, silent, boiler, root, sticky, block, mark))
        self.open[tag] += 1
        self.links += tag == "a"
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in SILENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._end_line()
        self.tags += 1
        if self.open[tag]:
            self._pop_to(tag)

    def handle_data(self, data):
        if not self._top()[1]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)
            else:
                self.plain = self.plain or any(c.isalnum() for c in data)

    def close(self):
        """A comment or tag that the page's end cuts off runs to the end, as in browsers."""
        if _CUT_OFF.match(self.rawdata):
            self.rawdata = ""
        super().close()
        self._end_line()


_CUT_OFF = re.compile(r"<[a-zA-Z/!?]")


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """ratios under a Gaussian of three sigmas to each side, renormalised at the ends."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weigh = lambda v: np.convolve(v, kernel)[reach : reach + len(v)]
    return weigh(ratios) / weigh(np.ones_like(ratios))


def threshold(values: np.ndarray) -> float:
    """Halfway between the means of two clusters (Lloyd's iterations in one dimension)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        under, over = values[values <= cut], values[values > cut]
        if not len(over) or not len(under):
            break
        new = float(under.mean()), float(over.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def container(blocks: list[list], marked: np.ndarray) -> tuple[int, int]:
    """The smallest block that holds all marked ones and is no mere part of a text; its first and last block inside."""
    at, last = int(marked.min()), int(marked.max())
    end = lambda x: len(blocks) if blocks[x][2] is None else blocks[x][2]
    if at == last:  # a line's own block is not what contains it
        at = blocks[at][1]
    while at and (end(at) < last or blocks[at][0] in PARTS):
        at = blocks[at][1]
    return at, end(at) if at else len(blocks)


def content_lines(lines: list[tuple[str, int, int, bool, int, int, int, int]], blocks: list[list]) -> list[str]:
    """The texts of the content region, in page order."""
    if not lines:
        return []
    boiler, root, block, links, mark = (np.array([x[k] for x in lines]) for k in range(3, 8))
    length = np.array([len(x[0]) - x[2] for x in lines], float)
    prior = np.where(boiler | (mark > 0), MARKED, 1.0)
    if boiler.all():
        return []
    ratio = length * prior / np.maximum(1, [x[1] for x in lines])
    smooth = smoothed(ratio)
    # the prior once more, since a line between others takes on their ratios
    upper = ~boiler & (smooth * prior >= threshold(smooth))
    if not upper.any():
        upper = ~boiler & (mark == 0)
    if not upper.any():
        upper = ~boiler
    rooted = ~boiler & (root > 0)
    inside = upper & rooted
    if inside.any() and smooth[inside].sum() >= smooth[upper & ~rooted].sum():
        region, first = rooted, -1
    else:
        first, last = container(blocks, block[upper])
        region = ~boiler & (block >= first) & (block <= last)
        above = np.flatnonzero(region)[0]
        while above and not boiler[above - 1] and not mark[above - 1] and lines[above - 1][2] == 0:  # a title or lead above
            above -= 1
            region[above] = True
        at = np.flatnonzero(upper)
        for i in np.flatnonzero(region & (links > 0)):
            beside = (i > 0 and links[i - 1] > 0) or (i + 1 < len(lines) and links[i + 1] > 0)
            if (i < at[0] and (links[i] > 1 or beside)) or (i > at[-1] and links[i] > 1):
                region[i] = False
    # marks of the region's own surroundings do not count
    against = (mark > first) & (mark > 0)
    region &= ~against | upper
    return [lines[i][0] for i in np.flatnonzero(region)]


def extract(html: str | None) -> str:
    """The main text of a page, its blocks joined by newlines."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    return "\n".join(content_lines(parser.lines, parser.blocks))


def _extract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = [extract(x) for x in pdf["html"]]
        yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInPandas(_extract_batches, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
