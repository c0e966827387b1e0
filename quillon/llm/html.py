"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing, clusters.

The standard library's streaming parser gives events; a block is the text between
two block-level tags (or line breaks), with the number of tags met in it.  Blocks in
elements that are never article text (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, reader comments; by tag, role, or a name in the class or id
that means such) are set apart, but neither a form nor an element with such a role or
name if it holds most of the page's text without links and comments, and four times
that of the articles beside it.  If the names leave less than a quarter of the text that
is found without them, they don't count; those of comments if nothing is left.  Over the other blocks the ratio of text to tags is smoothed by a
Gaussian, and blocks above a share of its standard deviation form the content
clusters, less what at their ends is only smoothed that high.  These alone choose the region: the smallest container (no paragraph, list
item, heading or inline element) that holds all clusters but links.  The page's text is every
block of it, but those outside of clusters that are mostly links.  An article or main
element has no say in this beyond its being a container.

Character references are decoded, white space within a block becomes one space, and
blocks are joined by a line feed; nothing is capped.  Null or empty html, and pages
without text, give an empty text; ids are long integers; repeated rows give repeated rows;
other columns don't matter.  Broken markup is taken as the parser gives it: an
end tag closes everything open within its element, an unmatched one is ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead title tr ul".split()
)
NEVER = frozenset(
    "annotation annotation-xml applet aside audio button canvas datalist dialog embed footer frameset head iframe input label menu meter nav noframes "
    "noscript object optgroup option progress script search select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words of a name in a class or id; the name's other words have to be QUALIFIERS.
WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination "
    "popup promo promotion promotions related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget widgets".split()
)
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
QUALIFIERS = frozenset(
    "area article bar block blog bottom box btn button buttons container fixed footer form global header home icons inner item items left link links list main message mobile "
    "page panel popup post primary right secondary section site slot sticky text top unit web wrap wrapper zone x".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(["article", "main"])
CONTAINERS = BLOCK - HEADINGS - frozenset("address br caption dd dt figcaption hr legend li option p pre summary title".split())
CELLS = frozenset(["td", "th"])
KEPT, SOFT, HARD = 0, 1, 2
#: Names that leave less than one part in this many of the text don't count.
LEAST_PART = 4
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGMA, DEVIATIONS, FAIR_PART = 1.0, 0.5, 8


@dataclass
class Block:
    text: str
    tags: int
    linked: int
    path: tuple[int, ...]
    apart: bool


@dataclass
class Open:
    """An open element; ``hard``: its text is never counted, ``start``: the volume before it."""

    tag: str
    number: int
    region: int
    apart: bool
    header: bool
    hard: bool
    soft: bool
    start: int


class Blocks(HTMLParser):
    """Collects the blocks of a page; ``lifted`` elements aren't set apart."""

    def __init__(self, words: frozenset[str] = WORDS, lifted: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.words, self.lifted = words, lifted
        self.stack: list[Open] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.number = self.tags = self.linked = self.links = 0
        self.volume = self.regions = 0  # characters outside of links and what is never text, and those in regions
        self.held: dict[int, int] = {}  # of each soft element

    def named(self, name: str) -> bool:
        """Whether a name of a class or id means something that isn't the article."""
        found = {x.lower() for x in WORD.findall(name)}
        return not self.words.isdisjoint(found) and found <= self.words | QUALIFIERS

    def apart(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in NEVER:
            return HARD
        kind = SOFT if tag == "form" else KEPT
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in (value or "").replace(" ", ""):
                return HARD
            if key == "role" and value in ROLES:
                kind = max(kind, SOFT)
            if key in ("class", "id") and value and tag not in ("html", "body", "main"):
                names = value.split()
                found = [x for x in names if (x.lower() in self.words if tag in REGIONS else self.named(x))]
                if any(not COMMENTS.isdisjoint(y.lower() for y in WORD.findall(x)) for x in found):
                    return HARD
                if found:
                    kind = max(kind, SOFT)
        return kind

    def handle_starttag(self, tag, attrs):
        if tag == "p" or tag == "li":
            self.close_implied(tag)
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in CELLS:
            self.parts.append(" ")
        if tag in VOID:
            return
        self.number += 1
        up = self.stack[-1] if self.stack else Open("", 0, 0, False, False, False, False, 0)
        region, apart, header, hard = up.region, up.apart, up.header, up.hard
        if tag in REGIONS and not apart and not region:
            region = self.number
        soft = False
        if tag == "header":  # of an article's own header the headings stay
            apart, header, hard = True, region > 0 and not apart, hard or not region
        elif header and tag in HEADINGS:
            apart, header = False, False
        elif not hard:
            kind = self.apart(tag, attrs)
            soft, hard = kind == SOFT, kind == HARD
            apart = apart or hard or soft and self.number not in self.lifted
        self.stack.append(Open(tag, self.number, region, apart, header, hard, soft, self.volume))
        self.links += tag == "a"

    def close_implied(self, tag: str) -> None:
        """An open paragraph or list item ends where the next begins, in the same block."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].tag
            if name == tag:
                self.flush()
                self.pop_to(i)
                return
            if name in BLOCK:
                return

    def pop_to(self, i: int) -> None:
        for x in self.stack[i:]:
            self.links -= x.tag == "a"
            if x.soft:
                self.held[x.number] = self.volume - x.start
        del self.stack[i:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                if tag not in BLOCK and any(x.tag in BLOCK for x in self.stack[i + 1 :]):
                    return  # an inline element doesn't close the blocks begun in it
                self.pop_to(i)
                return

    def handle_data(self, data):
        if not self.links and not (self.stack and self.stack[-1].hard):
            self.volume += len(data.strip())
            if self.stack and self.stack[-1].region and not self.stack[-1].apart:
                self.regions += len(data.strip())
        if self.stack and self.stack[-1].apart:
            return  # also of a script or an advert within a line
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.tags, self.linked, tuple(x.number for x in self.stack if x.tag in CONTAINERS), bool(self.stack) and self.stack[-1].apart))
            self.tags = 0
        self.parts, self.linked = [], 0


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel's weight is renewed at both ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    near = lambda y: np.convolve(np.pad(y, reach), kernel, "valid")
    return near(x) / near(np.ones_like(x))


def content(blocks: list[Block]) -> list[bool]:
    """Whether each block is in a cluster of high text-to-tag ratio.

    A cluster begins and ends with a block whose own ratio is a fair part of that, not with one
    that merely stands beside such."""
    own = np.array([len(b.text) / max(1, b.tags) for b in blocks], float)
    ratio = smoothed(own)
    least = min(DEVIATIONS * ratio.std(), ratio.max())
    inside, high = ratio >= least, np.flatnonzero((ratio >= least) & (FAIR_PART * own >= least))
    if len(high):
        cluster = np.cumsum(np.diff(inside, prepend=False) & inside)  # its number, from one
        at = np.arange(len(own))
        k = np.searchsorted(high, at)
        before, after = high[np.maximum(k - (high[np.minimum(k, len(high) - 1)] != at), 0)], high[np.minimum(k, len(high) - 1)]
        inside &= (before <= at) & (after >= at) & (cluster[before] == cluster) & (cluster[after] == cluster)
    return inside.tolist()


def chosen(blocks: list[Block]) -> list[str]:
    """The blocks of the smallest container that holds the clusters."""
    blocks = [b for b in blocks if not b.apart]
    if not blocks:
        return []
    inside = content(blocks)
    linked = lambda b: 2 * b.linked > len(b.text)
    cluster = [b for b, x in zip(blocks, inside, strict=True) if x and not linked(b)]
    shared = set.intersection(*(set(b.path) for b in cluster)) if cluster else set()
    holder = max(shared, default=None)
    return [b.text for b, x in zip(blocks, inside, strict=True) if (holder is None or holder in b.path) and not (linked(b) and not x)]


def parsed(html: str, words: frozenset[str], lifted: frozenset[int] = frozenset()) -> Blocks:
    parser = Blocks(words, lifted)
    parser.feed(html)
    parser.close()
    parser.flush()
    parser.pop_to(0)
    return parser


def found(html: str, words: frozenset[str]) -> str:
    """The text where elements named by these words are set apart."""
    parser = parsed(html, words)
    if lifted := frozenset(k for k, n in parser.held.items() if 2 * n > parser.volume and n > LEAST_PART * parser.regions):
        parser = parsed(html, words, lifted)
    return "\n".join(chosen(parser.blocks))


def main_text(html: str) -> str:
    """The article's blocks, joined by line feeds."""
    text = found(html, WORDS)
    if LEAST_PART * len(text) < len(html) and LEAST_PART * len(text) < len(other := found(html, COMMENTS)):
        text = other
    return text or found(html, frozenset())


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [(i, u, main_text(h)) for i, u, h in rows_of([batch])]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "url", "text"])

    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return df.mapInArrow(run, "page_id long, url string, text string")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    df = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
