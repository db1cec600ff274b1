"""Main text of a page: streaming parser events make lines, whose text-to-tag ratios, smoothed by a Gaussian and split by
threshold clustering, tell which regions hold content.

A line ends where a block begins or ends, at a line break and at a newline; lines of tags alone have ratio zero and count in the
smoothing. Elements that can never be text are not read. What is declared as something beside the main text (a nav, footer or
form, a role, a class or id such as "comments") isn't cut out by its name: the name lowers the ratio of the lines within to a
fiftieth, and the clustering decides. The region is the lowest that holds all dense lines, widened to an article or main around
it and those beside that; within it all blocks stay but those declared as something else that aren't dense, and, outside an article, runs of links.

Edge cases: null or empty html, and html without text, give the empty string, as does a page whose article is empty and whose
other text is all declared as something else. Of a page where everything is so declared the clustering picks as of any other.
Unclosed and truncated markup is read to its end. An empty table gives no rows; repeated rows are read each by itself; further
columns don't matter. Pages of any length are fed in slices. Where ratios tie, all lines are dense.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: What is never text.
NEVER = frozenset("head title script style noscript template button select option textarea input iframe object svg canvas audio video".split())
#: Elements, roles and names of what stands beside the main text.
BESIDE = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs share sharing social comment comments reply replies "
    "discussion disqus related newsletter subscribe subscription popup modal overlay footer masthead pagination pager".split()
)
REGION = frozenset("article main section div td body".split())
SLICE = 1 << 16
SIGMA = 1.0
#: What a declaration as something else makes of a line's ratio.
LOWERED = 0.02
#: A block of so many words is dense beside much longer ones too.
PARAGRAPH = 20
#: So many blocks of links in a row, with at least this share of their text in links, are a menu.
LINKS, LINKED = 3, 0.8
WORD = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects (text, tags, block, characters in links) for each line, (region, declared) for each block, declared being how many
    open elements are declared as something else. Regions are numbered as they open; parents holds the outer region."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.blocks = [], []
        self.parents, self.kinds, self.declared_of = [-1], ["page"], [0]
        self.stack, self.open, self.muted, self.region, self.declared = [], Counter(), 0, 0, 0
        self.text, self.tags, self.linked = [], 0, 0

    def flush(self, ends_block: bool = True):
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text or self.tags:
            if not self.blocks or self.blocks[-1] != (self.region, self.declared, len(self.blocks)):
                self.blocks.append((self.region, self.declared, len(self.blocks) + 1))
            self.lines.append((text, self.tags, len(self.blocks) - 1, self.linked))
            self.tags = 0
        if ends_block and self.blocks:
            self.blocks[-1] = (*self.blocks[-1][:2], -1)  # the next line begins another block
        self.text, self.linked = [], 0

    def beside(self, tag, attrs):
        if tag in BESIDE or tag == "header" and not self.open["article"]:
            return True
        if tag in ("body", "html", "main", "article"):
            return False
        for k, v in attrs:
            if k == "role" and v and v.lower() in ROLES or k in ("class", "id") and v and not HINTS.isdisjoint(WORD.findall(v.lower())):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if not self.muted:
            self.tags += 1
        if tag in VOID:
            return
        never = tag in NEVER or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        beside = not never and self.beside(tag, attrs)
        if beside and tag not in BLOCK:  # such text would run into the block around it
            never, beside = True, False
        self.stack.append((tag, never, self.region, self.declared))
        self.open[tag] += 1
        self.muted += never
        self.declared += beside
        if tag in REGION:
            self.parents.append(self.region)
            self.kinds.append(tag)
            self.declared_of.append(self.declared)
            self.region = len(self.kinds) - 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if not self.muted:
            self.tags += 1
        if not self.open[tag]:
            return
        while True:
            top, never, self.region, self.declared = self.stack.pop()
            self.open[top] -= 1
            self.muted -= never
            if top == tag:
                return

    def handle_data(self, data):
        if self.muted:
            return
        first, *rest = data.split("\n")
        for k, part in enumerate((first, *rest)):
            if k:
                self.flush(False)
            self.text.append(part)
            if self.open["a"]:
                self.linked += len(part)

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # an unknown marked section: as browsers do, a comment up to the next ">"
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)


def threshold(values: np.ndarray) -> float:
    """Two-means split of a line: the middle between the centres."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        under, over = values[values <= cut], values[values > cut]
        if not len(over) or not len(under):
            return min(cut, float(values.min()))
        now = (float(under.mean()), float(over.mean()))
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel / kernel.sum())
    return full[reach : reach + len(ratios)]


def scores(p: Lines) -> np.ndarray:
    """The smoothed ratio of each line, lowered where it is declared as something else."""
    lowered = np.array([LOWERED ** min(4, p.blocks[b][1]) for _, _, b, _ in p.lines])
    ratios = np.array([len(t) / max(1, n) for t, n, _, _ in p.lines])
    return smoothed(ratios * lowered) * lowered


def dense_blocks(p: Lines) -> np.ndarray:
    """For each block whether one of its lines is over the threshold, or it is a paragraph that nothing declares as something else."""
    value = scores(p)
    has = np.array([bool(t) for t, *_ in p.lines])
    over = has & (value > threshold(value))
    words, dense = np.zeros(len(p.blocks), int), np.zeros(len(p.blocks), bool)
    for k, (t, _, b, _) in enumerate(p.lines):
        words[b] += t.count(" ") + bool(t)
        dense[b] |= over[k]
    declared = np.array([b[1] for b in p.blocks])
    plain = (words > 0) & (declared == declared[words > 0].min())
    dense |= plain & (words >= PARAGRAPH)
    return dense if dense.any() else plain


def main_text(html: str | None) -> str:
    """Blocks of the content region, in page order, joined by one space."""
    if not html:
        return ""
    p = Lines()
    for i in range(0, len(html), SLICE):
        p.feed(html[i : i + SLICE])
    p.close()
    p.flush()
    if not any(t for t, *_ in p.lines):
        return ""
    texts: list[list[str]] = [[] for _ in p.blocks]
    linked = [0] * len(p.blocks)
    for t, _, b, a in p.lines:
        if t:
            texts[b].append(t)
            linked[b] += a
    size = [sum(map(len, t)) for t in texts]
    region, declared = [b[0] for b in p.blocks], [b[1] for b in p.blocks]
    if min(d for d, n in zip(declared, size, strict=True) if n) and any(k in ("article", "main") and not d for k, d in zip(p.kinds, p.declared_of, strict=True)):
        return ""  # an article, and nothing in it
    dense = dense_blocks(p)
    least = min(declared[k] for k in np.flatnonzero(dense))
    gain: Counter = Counter()  # dense text under each region
    told: set[int] = set()  # regions with text
    for k, n in enumerate(size):
        if n and declared[k] <= least:
            told.add(region[k])
        gain[region[k]] += n * bool(dense[k])
    for r in range(len(p.kinds) - 1, 0, -1):  # inner regions have the larger numbers
        gain[p.parents[r]] += gain[r]
        if r in told:
            told.add(p.parents[r])
    best = 0
    for r in range(1, len(p.kinds)):  # the lowest region that holds all dense text
        if gain[r] == gain[0] and p.parents[r] == best:
            best = r
    marked = {r for r in range(1, len(p.kinds)) if p.kinds[r] in ("article", "main") and r in told and p.declared_of[r] <= least}
    outer = _outermost(p.parents, marked)
    around = best
    while around > 0 and around not in outer:
        around = p.parents[around]
    article = around > 0
    chosen = set(outer) if article else {best}
    inside = [-1] * len(p.kinds)  # how much was declared where the chosen region began
    for r in range(len(p.kinds)):
        inside[r] = p.declared_of[r] if r in chosen else inside[p.parents[r]] if r else -1
    menu = set() if article else _menus(texts, linked, size, dense)
    base = [max(least, inside[region[k]]) for k in range(len(size))]
    return " ".join(" ".join(texts[k]) for k in range(len(size)) if size[k] and inside[region[k]] >= 0 and (dense[k] or declared[k] <= base[k] and k not in menu))


def _menus(texts, linked, size, dense) -> set[int]:
    """Blocks in runs of links."""
    out: set[int] = set()
    run: list[int] = []
    for k in [*(k for k, n in enumerate(size) if n), -1]:
        if k >= 0 and linked[k] >= LINKED * size[k] and not dense[k]:
            run.append(k)
        else:
            out.update(run if len(run) >= LINKS else ())
            run = []
    return out


def _outermost(parents: list[int], marked: set[int]) -> list[int]:
    under = [False] * len(parents)  # inside a marked region; outer regions have the smaller numbers
    for r in range(1, len(parents)):
        under[r] = under[parents[r]] or parents[r] in marked
    return [r for r in marked if not under[r]]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; one narrow pass without a shuffle."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
