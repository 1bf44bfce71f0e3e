"""The main text of web pages.

The standard library's parser reads a page as a stream of events. Blocks of text are the lines;
the ratio of text to tags of each line is smoothed with a Gaussian, and lines above the
standard deviation of the page form its content clusters. Elements that say by name, role or
label that they are furniture (menus, footers, adverts and so on) count as lines without text,
unless the page has its clusters nowhere else: a label or a form around them is overruled.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_right
from html.parser import HTMLParser
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows

# Element names and labels.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes that was left open, unless one of the second set lies between.
_TABLE = frozenset(("table",))
_ITEM_ENDS = BLOCKS - {"address", "div", "p"}
CLOSES = {
    "li": (frozenset(("li",)), _ITEM_ENDS - {"li"}),
    "dt": (frozenset(("dt", "dd")), _ITEM_ENDS - {"dt", "dd"}),
    "dd": (frozenset(("dt", "dd")), _ITEM_ENDS - {"dt", "dd"}),
    "td": (frozenset(("td", "th")), _TABLE | {"tr"}),
    "th": (frozenset(("td", "th")), _TABLE | {"tr"}),
    "tr": (frozenset(("tr", "td", "th")), _TABLE),
    **dict.fromkeys(("tbody", "tfoot", "thead"), (frozenset("caption tbody tfoot thead tr td th".split()), _TABLE)),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
}
ENDS_P = BLOCKS - frozenset("body caption option tbody td tfoot th thead tr".split())
_P = frozenset(("p",)), frozenset("button caption object table td template th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset(
    "aside button canvas datalist dialog footer form head iframe input menu nav noscript object script select style "
    "svg template textarea title".split()
)
REGIONS = frozenset(("article", "main"))
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "promotion related replies share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Labels that the head of an article has as well, and words that make a label tell of a layout.
HEADS = frozenset(("header", "masthead"))
LAYOUT = frozenset("has is js no with without".split())
#: Elements that clusters may overrule, as they may labels of any but these, which hold what readers wrote.
SOFT = frozenset(("form",))
READERS = frozenset("comment comments disqus replies".split())
#: Blocks beside a cluster that belong to it, unless most of their text is links.
BESIDE = frozenset("blockquote dd div dl dt figure li ol p pre section table tbody td tr ul".split())
_PARTS = re.compile("[-_]+")
#: Lines on each side that smoothing takes in, and its width.
RADIUS, SIGMA = 2, 1.0
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]


class _Line(NamedTuple):
    text: str
    tags: int
    furniture: bool
    region: int
    block: int
    linked: int  # characters within links


class _Element(NamedTuple):
    name: str
    furniture: bool
    region: int
    block: int
    soft: int  # the innermost soft element around


_PAGE = _Element("", False, 0, 0, 0)


class _Soft:
    """What an element holds that is furniture by a label or as a form only, without inner ones."""

    def __init__(self, around: int, readers: bool):
        self.around, self.readers = around, readers
        self.chars = self.blocks = 0
        self.region = False


class _Lines(HTMLParser):
    """Collects a line for each block, in page order.

    Articles and main elements inside others belong to the outermost one's region. Paragraphs,
    list items, table cells and the like end where the next one starts. Text of furniture is not
    kept: a line that has nothing else is furniture itself. Soft elements are numbered in page
    order; those whose number is in ``overruled`` are no furniture. Open elements are also found by
    name, so that time follows the page's length, however many are left open."""

    def __init__(self, overruled=frozenset()):
        super().__init__(convert_charrefs=True)
        self.overruled = overruled
        self.lines: list[_Line] = []
        self.open: list[_Element] = []
        self.places: dict[str, list[int]] = {}  # of open elements by name
        self.blocks: list[tuple[str, int]] = [("", 0)]  # name, block around it; the first is the page
        self.softs: list[_Soft] = [_Soft(0, False)]
        self.parts: list[str] = []
        self.tags = self.regions = self.linked = 0
        self.other = self.unclosed = False  # furniture in this line; no comment ends from here on

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text or self.other:
            around = self.open[-1] if self.open else _PAGE
            self.lines.append(_Line(text, self.tags, not text, around.region, around.block, self.linked))
        self.parts, self.tags, self.linked, self.other = [], 0, 0, False

    def cut(self, first):
        while len(self.open) > first:
            self.places[self.open.pop().name].pop()

    def close_open(self, names, until):
        found = [self.places[n] for n in names if self.places.get(n)]
        if found:
            wall = max((self.places[n][-1] for n in until if self.places.get(n)), default=-1)
            inside = [at[k] for at in found if (k := bisect_right(at, wall)) < len(at)]
            if inside:
                self.cut(min(inside))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES:
                self.close_open(*CLOSES[tag])
            if tag in ENDS_P:
                self.close_open(*_P)
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag == "body":
            self.cut(0)
        _, furniture, region, block, soft = self.open[-1] if self.open else _PAGE
        if soft or not furniture:
            if tag in FURNITURE - SOFT or (tag == "header" and not region):
                furniture, soft = True, 0
            else:
                labels = _labelled(tag, attrs, region) if attrs and tag != "body" else None
                if labels is not None or tag in SOFT:
                    self.softs.append(_Soft(soft, bool(labels and labels & READERS)))
                    soft = len(self.softs) - 1
                    furniture = furniture or soft not in self.overruled
                elif tag in REGIONS:
                    self.softs[soft].region = True
                self.softs[soft].blocks += tag == "p" or tag in HEADINGS
        if tag in REGIONS and not furniture and not region:
            self.regions += 1
            region = self.regions
        if tag in BLOCKS:
            self.blocks.append((tag, block))
            block = len(self.blocks) - 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(_Element(tag, furniture, region, block, soft))

    def parse_comment(self, i, report=1):
        """Of a comment without an end, only its start is skipped; it is looked for once."""
        end = -1 if self.unclosed else super().parse_comment(i, report)
        if end >= 0:
            return end
        self.unclosed = True
        return i + 4

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def handle_data(self, data):
        around = self.open[-1] if self.open else _PAGE
        if around.soft and not self.places.get("a"):
            self.softs[around.soft].chars += len(data.strip())
        if around.furniture:
            self.other = self.other or not data.isspace()
        else:
            self.parts.append(data)
            if self.places.get("a"):
                self.linked += len(data.strip())


def _labelled(tag, attrs, region):
    """The labels by which attributes say that an element is furniture; none: None.

    Labels are looked for among the words of a class or id, of an article or main element only
    as whole names, since these often tell what else is on the page.
    """
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return READERS  # never shown, so never overruled
        if name in ("class", "id") and value:
            labels = _labels(value, tag in REGIONS)
            if labels and not (region and labels <= HEADS):
                return labels
        if name == "role" and value and value.lower() in ROLES:
            return frozenset((value.lower(),))
    return None


@functools.lru_cache(4096)
def _labels(value, whole):
    found = set()
    for label in value.lower().split():
        parts = [label] if whole else _PARTS.split(label)
        if LAYOUT.isdisjoint(parts):
            found.update(parts)
    return frozenset(found & LABELS)


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by line feeds.

    Of a page with article or main elements, all blocks of those that hold a content cluster
    are kept, so no short paragraph is lost; of other pages, the clusters, what lies between the
    first and the last of them, and the blocks of the same element and headings of it or
    those around it that stand next to these and are not mostly links. Furniture is left out in either case.

    A label or form around the page's clusters is overruled: if there are none outside such
    elements, or only some with less text than one that holds an article or main element, the one
    with most text of its own is read as content, with those around it. It must hold an article,
    main element or two paragraphs or headings; what readers wrote is never overruled.
    """
    if not html:
        return ""
    parser = _parsed(html)
    text, whole = _chosen(parser)
    if not whole:
        heaviest = max((s for s in parser.softs[1:] if not s.readers and (s.region or s.blocks > 1 and not text)), key=_weight, default=None)
        if heaviest is not None and heaviest.chars > len(text):
            overruled, at = set(), parser.softs.index(heaviest)
            while at:
                overruled.add(at)
                at = parser.softs[at].around
            text = _chosen(_parsed(html, overruled))[0] or text
    return text


def _weight(soft):
    return soft.region, soft.chars


def _parsed(html, overruled=frozenset()):
    parser = _Lines(overruled)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def _chosen(parser):
    """The text of a page's clusters, and whether it is that of whole article or main elements."""
    lines = parser.lines
    chosen = content_lines([0.0 if line.furniture else len(line.text) / max(1, line.tags) for line in lines])
    regions = {lines[i].region for i in chosen} - {0}
    if regions:
        return "\n".join(line.text for line in lines if not line.furniture and line.region in regions), True
    inside = lines[_reach(parser, chosen[0], -1) : _reach(parser, chosen[-1], 1) + 1] if chosen else []
    return "\n".join(line.text for line in inside if not line.furniture), False


def _reach(parser, at, step):
    """The last line from ``at`` on that belongs to its cluster; furniture between does not end it."""
    blocks, lines = parser.blocks, parser.lines
    block = lines[at].block
    container = blocks[block][1] if blocks[block][0] == "p" or blocks[block][0] in HEADINGS else block
    around, outer = {container}, container
    while outer:
        outer = blocks[outer][1]
        around.add(outer)
    # Other blocks of the page itself may be anything, so only its paragraphs belong.
    beside = BESIDE if blocks[container][0] not in ("", "body", "html") else frozenset(("p",))
    i = at + step
    while 0 <= i < len(lines):
        line = lines[i]
        name, parent = blocks[line.block]
        if not line.furniture:
            own = name in beside and container in (parent, blocks[parent][1]) and 2 * line.linked <= len(line.text)
            if not (own or name in HEADINGS and parent in around):
                break
            at = i
        i += step
    return at


def content_lines(ratios: list[float]) -> list[int]:
    """Indexes of lines whose ratio, smoothed and as it is, is above the standard deviation of all.

    Their own ratio counts too, so that a cluster does not reach out to the line beside it.
    """
    n = len(ratios)
    if not any(ratios):
        return []
    smooth = []
    for i in range(n):
        low, high = max(0, i - RADIUS), min(n, i + RADIUS + 1)
        weights = _KERNEL[low - i + RADIUS : high - i + RADIUS]
        smooth.append(sum(w * r for w, r in zip(weights, ratios[low:high])) / sum(weights))
    mean = sum(smooth) / n
    spread = math.sqrt(sum((s - mean) ** 2 for s in smooth) / n)
    return [i for i in range(n) if min(ratios[i], smooth[i]) > spread]


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars`` (code points).

    A map over the pages without shuffle. Null or empty pages, and pages without content, give
    the empty text. Broken markup is read as far as it goes: end tags close what they can, a comment
    without an end is text, and a page that stops in the middle keeps what came before. Time follows the page's length. Null ids and urls, repeated rows and
    pages of any length pass through; other columns are not read.
    """

    def make():
        def run(ids, urls, pages):
            texts = [main_text(html) for html in pages]
            return ids, urls, texts, [len(t) for t in texts]

        return run

    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return map_rows(pages, [id_col, url_col, html_col], f"{', '.join(kinds)}, text string, n_chars bigint", make)
