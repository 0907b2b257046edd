"""Main text of raw pages: parser events, text-to-tag ratios, Gaussian smoothing, clusters.

The standard library's streaming parser gives events.  Text between two block borders
is one line (a block of the result), with the number of tags met before its end.  A
line's ratio of text to tags is weighted by the elements it lies in: NEVER by boilerplate
(nav, footer, aside, form, ..., or a class or id made of boilerplate words alone), less in
a doubtful element.  The ratios are smoothed with a Gaussian; lines at or over a
threshold, the smoothed ratios' standard deviation (at most their mean), form clusters.

The cluster with most text seeds the region.  Of the elements around the seed, the region
is the one with the largest sum of its lines' smoothed ratios above the threshold (below
it they count against it), with a premium for article, main and the like; of equals the
innermost.  The region's lines are the result, short ones too, but for

* boilerplate;
* a doubtful element, or a block of links, whose mean smoothed ratio is under the threshold;
* a header, unless it stands in an article, main or section of the region.

Scanning is map-only, a page at a time; pages are never cut.  Defined cases: null,
empty and tagless html (its text is the result), unclosed and stray tags, unknown
character references (kept as they are); rows that repeat an id are judged one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sparkkit

SIGMA = 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Blocks that hold a piece of text and are no region.
LEAVES = frozenset("p pre blockquote li dd dt td th tr h1 h2 h3 h4 h5 h6 figcaption caption address summary".split())
#: Elements whose text is not shown, or is the page's controls.
UNSEEN = frozenset("script style noscript template head title select option textarea button iframe object embed svg canvas audio video map".split())
BOILERPLATE = frozenset("nav aside footer form dialog fieldset menu input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A class or id names boilerplate if it has one of the first words and none but these and the third; doubtful parts likewise.
MARKS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsbygoogle banner sponsor sponsored promo promoted promotion menu nav navbar navigation breadcrumb breadcrumbs footer sidebar side aside widget widgets notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login share sharing social comment comments reply replies respond disqus discussion pagination pager toolbar".split())
DOUBTFUL = frozenset("alert subscription form search related recommended recommendations disclaimer legal copyright".split())
NEUTRAL = frozenset("site page main top bottom left right box block wrapper wrap container section list area inner outer primary secondary global link links item items button buttons slot unit zone panel bar content post posts article entry blog user reader view thread module row col column fixed sticky mobile desktop".split())
HEADER = frozenset("header masthead".split())
#: Class or id words, and premiums, of elements that hold the text.
CONTENT = frozenset("article content entry main post story text".split())
PREMIUM, SMALL_PREMIUM, LESS = 1.5, 1.2, 0.5
LINKS = 0.6
_PART, _MARK, _HEAD, _DOUBT = range(4)
#: Blocks that a new block of the same list closes.
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("first", "kind", "last", "parent", "premium", "seen", "tag", "weight")

    def __init__(self, tag: str, parent: _Node | None, first: int, kind: int = _PART, premium: float = 1.0):
        self.tag, self.parent, self.first, self.last, self.kind, self.premium = tag, parent, first, None, kind, premium
        self.weight = 0.0 if kind == _MARK else 1.0 if kind == _PART else LESS
        # boilerplate within a line is no line of its own
        self.seen = tag not in UNSEEN and not (kind == _MARK and tag not in BLOCKS)
        if parent is not None:
            self.weight, self.seen = min(self.weight, parent.weight), self.seen and parent.seen


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]


def _made_of(words: list[str], marks: frozenset[str]) -> bool:
    return not marks.isdisjoint(words) and all(w in marks or w in NEUTRAL for w in words)


def _judge(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, float]:
    """What an element is by its name and attributes, and its premium as a region."""
    premium = PREMIUM if tag in ("article", "main") else 1.0
    kind = _MARK if tag in BOILERPLATE else _HEAD if tag == "header" else _PART
    if tag in ("html", "body"):
        return kind, premium
    for k, v in attrs:
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "role" and v and v.lower() in ROLES) or (k == "style" and v and re.search(r"display\s*:\s*none", v)):
            kind = _MARK
        elif k == "role" and v and v.lower() in ("main", "article"):
            premium = PREMIUM
        elif k in ("class", "id") and v:
            for name in v.split():
                words = _words(name)
                if _made_of(words, MARKS):
                    kind = _MARK
                elif kind == _PART and _made_of(words, HEADER):
                    kind = _HEAD
                elif kind == _PART and _made_of(words, DOUBTFUL | MARKS):
                    kind = _DOUBT
                elif premium == 1.0 and not CONTENT.isdisjoint(words):
                    premium = SMALL_PREMIUM
    return kind, premium


class _Lines(HTMLParser):
    """Lines (text, tags, link signs, nodes) of a page; ``open`` is the element that the parser is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Node("", None, 0)
        self.nodes = [self.root]
        self.n_open: Counter[str] = Counter()
        self.linked: list[int] = []
        self.n_linked = 0
        self.lines: list[str] = []
        self.tags: list[int] = []
        self.where: list[_Node] = []
        self.text: list[str] = []
        self.n_tags = 0

    def flush(self) -> None:
        line = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if line:
            self.lines.append(line)
            self.tags.append(self.n_tags)
            self.linked.append(self.n_linked)
            self.where.append(self.open)
            self.n_tags = self.n_linked = 0

    def _close(self, node: _Node) -> None:
        while self.open is not node.parent:
            self.open.last = len(self.lines)
            self.n_open[self.open.tag] -= 1
            self.open = self.open.parent

    def _find(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> _Node | None:
        n = self.open
        if not any(self.n_open[t] > 0 for t in tags):
            return None
        while n.parent is not None:
            if n.tag in tags:
                return n
            if n.tag in stop:
                return None
            n = n.parent
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.n_tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag in CLOSES["p"] and (p := self._find({"p"}, frozenset(("button", "table", "td", "th", "article", "section", "div", "li")))):
            self._close(p)
        if tag in SAME and (n := self._find(SAME[tag], frozenset(("ul", "ol", "dl", "table", "select")))):
            self._close(n)
        if tag in ("body",) and (head := self._find({"head"}, frozenset())):
            self._close(head)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        self.open = _Node(tag, self.open, len(self.lines), *_judge(tag, attrs))
        self.nodes.append(self.open)
        self.n_open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag in BLOCKS:
            self.flush()
        stop = frozenset(("td", "th", "article", "main", "body")) if tag not in BLOCKS else frozenset()
        if tag not in VOID and (n := self._find({tag}, stop)):
            self._close(n)

    def handle_data(self, data: str) -> None:
        if self.open.seen:
            self.text.append(data)
            if self.n_open["a"] > 0:
                self.n_linked += len(data.strip())

    def finish(self) -> None:
        self.close()
        self.flush()
        for n in self.nodes:
            if n.last is None:
                n.last = len(self.lines)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the window's weights are normalised at the ends."""
    r = int(np.ceil(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    lo = max(0, r)
    return np.convolve(x, w)[lo : lo + len(x)] / np.convolve(np.ones(len(x)), w)[lo : lo + len(x)]


def content_ratios(lengths: np.ndarray, tags: np.ndarray, weights: np.ndarray | float = 1.0, sigma: float = SIGMA, level: float = 1.0) -> tuple[np.ndarray, float]:
    """Smoothed weighted text-to-tag ratios, and the threshold: ``level`` times their standard deviation (at most their mean)."""
    s = smooth(lengths * weights / np.maximum(tags, 1), sigma)
    return s, level * min(s.std(), s.mean())


def content_region(lengths: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines' smoothed ratio reaches the threshold."""
    s, limit = content_ratios(lengths, tags)
    return s >= limit


def main_text(html: str | None, sigma: float = SIGMA, level: float = 1.0) -> str:
    p = _Lines()
    p.feed(html or "")
    p.finish()
    weight = np.array([n.weight for n in p.where])
    if not weight.any():
        return ""
    length = np.array([len(x) for x in p.lines], float)
    s, limit = content_ratios(length, np.array(p.tags, float), weight, sigma, level)
    content = (s >= limit) & (weight > 0)
    if not content.any():
        content = weight > 0
    total = _sums(length * content)
    new = np.flatnonzero(np.r_[True, content[1:] != content[:-1]])
    clusters = [(total[b] - total[a], -a, b) for a, b in zip(new, np.r_[new[1:], len(length)], strict=True) if content[a]]
    _, start, end = max(clusters)
    seed = -start + int(np.argmax((length * weight)[-start:end]))
    over = _sums(np.where(weight > 0, s - limit, 0.0))
    region = _region(p.where[seed], over)
    keep = weight > 0
    ratios, linked = _sums(s), _sums(np.array(p.linked, float))
    letters = _sums(length)
    for n in p.nodes:
        size = n.last - n.first
        if not n.weight or not size or n.first < region.first or n.last > region.last or n is region or n.tag not in BLOCKS:
            continue
        weak = ratios[n.last] - ratios[n.first] < limit * size
        links = n.tag not in LEAVES and size > 1 and linked[n.last] - linked[n.first] >= LINKS * (letters[n.last] - letters[n.first])
        if (weak and (links or n.kind == _DOUBT)) or (n.kind == _HEAD and not _own_header(n, region)):
            keep[n.first : n.last] = False
    return "\n\n".join(x for x, k in zip(p.lines[region.first : region.last], keep[region.first : region.last], strict=True) if k)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.r_[0.0, np.cumsum(x)]


def _region(n: _Node, over: np.ndarray) -> _Node:
    """Of the elements around a line, the one with the best sum; leaves are left first."""
    while n.parent is not None and (n.tag not in BLOCKS or n.tag in LEAVES):
        n = n.parent
    best, top = n, -np.inf
    while n is not None:
        if n.parent is None or (n.tag in BLOCKS and n.tag not in LEAVES):
            score = over[n.last] - over[n.first]
            score *= n.premium if score > 0 else 1 / n.premium
            if score > top + 1e-9 * abs(top if np.isfinite(top) else 0.0):
                best, top = n, score
        n = n.parent
    return best


def _own_header(n: _Node, region: _Node) -> bool:
    n = n.parent
    while n is not None:
        if n.tag in ("article", "main", "section") or n.premium > 1:
            return True
        if n is region:
            return False
        n = n.parent
    return False


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row: page_id, the kept columns, text, n_chars."""
    src = pages.select(F.col(html_col).cast("string").alias("_html"), F.col(id_col).alias("page_id"), *keep)
    kinds = dict(src.dtypes)
    names = ["page_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                texts = [main_text(h) for h in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(sparkkit.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
