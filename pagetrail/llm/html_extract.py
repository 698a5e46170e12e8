"""Main text of web pages by line-block distribution.

The markup of a page is read once, tolerant of missing end tags and in linear
time. Every block element gives one line of text: character references decoded,
white space turned into single spaces, trimmed. Boilerplate (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) gives no lines.

A line weighs as much as its text, a line that is nearly all links nothing.
Where the page marks articles (``article``, ``main``), lines outside weigh
nothing. Empty lines separate what does not stand together: different articles,
and lines of different containers with boilerplate between them. Boilerplate
between two lines of one container, or within an article, separates nothing.

The weights over a sliding window of ``WINDOW`` lines are summed for each line.
A *surge point* is where the sum rises from nothing, a *dive point* where it
falls back to nothing. Of the stretches between them those stay whose densest
window has 1/``SHARE`` of the page's densest, or ``ENOUGH`` characters; where
the densest window lies in an ``article``, lines of ``main`` outside articles
weigh nothing. All lines from the first to the last weighing line of a kept
stretch are joined by two line feeds.

Scripts, styles, templates, embedded objects and comments never give text, nor
does a tag that the end of the page cuts off.

Rows: null or blank html gives an empty text; a null ``page_id`` or ``url`` is
passed on; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import in_arrow

# Element names of HTML by the role they play here.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr caption ul".split()
)
DROPPED = frozenset(
    "nav footer aside form menu dialog search button select input label fieldset svg math canvas audio video object applet head datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr "
    "notice notices newsletter subscribe subscription signup login popup modal overlay sidebar sidebars sidenav menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar header comment comments commentlist disqus respond replies reply related recommended share sharing "
    "social toolbar pagination pager skip copyright widget widgets paywall".split()
)
# Words that say where or what a box is and may stand beside the words above.
BESIDE = frozenset(
    "site page top bottom left right main global primary secondary box container wrapper wrap list area section block bar inner outer item items content "
    "post posts article articles link links button buttons unit slot row text thread form media icons nav js id".split()
)
NAMES = WORDS | BESIDE
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "optgroup", "legend", "caption", "tbody", "thead", "tfoot", "tr"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_OTHER = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_START = re.compile(r"<(?:[!?]|/?[A-Za-z])")
_TAG = re.compile(r"""<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:=\s*+(?:"[^"]*"|'[^']*')|[^>=]|=)*+)>""", re.S)
_PLAIN_TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>[^>]*+)>", re.S)  # quotes mean nothing
_ZEROS = re.compile(r"(?<=&#)0+(?=[0-9])|(?<=&#[xX])0+(?=[0-9a-fA-F])")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")  # beyond all characters
_ATTR = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
_NAME_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WINDOW = 3
SHARE, ENOUGH = 8, 40
CONTAINERS = frozenset("article body center details div main section td".split())
PAGE, MAIN, ARTICLE = 1, 2, 3
NOTHING, BUT_HEADINGS, ALL = 0, 1, 2  # what is dropped inside an element; the header of an article may hold its heading


def _decoded(raw: str) -> str:
    if "&#" in raw:
        raw = _HUGE.sub("\ufffd", _ZEROS.sub("", raw))
    return entities.unescape(raw) if "&" in raw else raw


def _boilerplate(name: str, attrs: str) -> bool:
    if name in DROPPED:
        return True
    if not attrs.strip() or name in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        value = _decoded(m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            for word in value.split():
                parts = _NAME_PART.findall(_CAMEL.sub(" ", word).lower())
                if not WORDS.isdisjoint(parts) and NAMES.issuperset(parts):
                    if not (name == "article" and parts[-1] not in ("comment", "comments", "reply", "ad", "advert", "promo", "sponsored")):
                        return True
        elif key == "role" and value.strip().lower() in ROLES:
            return True
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Lines:
    """Lines of one page: their text, how much of it is links, where they stand, and whether the line before is apart from them."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.linked: list[int] = []
        self.place: list[int] = []  # PAGE, MAIN or ARTICLE
        self.apart: list[bool] = []
        self._parts: list[str] = []
        self._linked = 0
        self._part = self._depth = 0  # of the line before: article or main it stands in, and how many containers are open
        self._low = (0, PAGE)  # least open containers since then, and the place there
        self._cut = False  # boilerplate since then

    def add(self, raw: str, in_link: bool) -> None:
        if raw:
            self._parts.append(raw)
            if in_link:
                self._linked += len("".join(raw.split()))

    def end(self, place: int, part: int, depth: int) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                low, there = self._low
                elsewhere = self._cut and there == PAGE and self._depth > low < depth
                self.apart.append(bool(self.text) and (part != self._part or elsewhere))
                self.text.append(text)
                self.linked.append(self._linked)
                self.place.append(place)
                self._part, self._depth, self._low, self._cut = part, depth, (depth, place), False
            self._parts, self._linked = [], 0

    def left(self, depth: int, place: int) -> None:
        """Containers were closed; ``depth`` are still open."""
        if depth < self._low[0]:
            self._low = depth, place

    def boilerplate(self) -> None:
        self._cut = True


def tags_of(page: str):
    """(start, end, match) of every tag and other piece of markup; whoever reads sends the place to go on from, or None."""
    at, quotes, last = 0, True, page.rfind(">")
    while start := _START.search(page, at):
        i = start.start()
        if page[i + 1] in "!?":
            m = _OTHER.match(page, i)
        elif i > last:
            yield i, len(page), None
            return
        else:
            m = _TAG.match(page, i) if quotes else None
            if m is None:  # a quote swallows the rest of the page: from here on quotes mean nothing
                quotes, m = False, _PLAIN_TAG.match(page, i)
        go_on = yield i, m.end(), m
        at = m.end() if go_on is None else go_on


def lines_of(page: str) -> Lines:
    """Read the markup: one line per block of text."""
    out = Lines()
    stack = []  # of open elements: (name, state before it, inline elements open in the block around it)
    place, part, depth, dropped, in_link = PAGE, 0, 0, NOTHING, False
    parts = 0
    blocks, inline = Counter(), Counter()  # open blocks; open other elements of the innermost block
    at, go_on, reader = 0, None, tags_of(page)

    def end_line() -> None:
        out.end(place, part, depth)

    def pop_to(size: int) -> None:
        nonlocal place, part, depth, dropped, in_link, inline
        while len(stack) > size:
            (name, state, around), was = stack.pop(), dropped
            if name in BLOCKS:
                if not was:
                    end_line()
                blocks[name] -= 1
                inline = around
            else:
                inline[name] -= 1
            place, part, depth, dropped, in_link = state
            if name in CONTAINERS:
                out.left(depth, place)
            if was and not dropped and name not in HEADINGS:
                out.boilerplate()

    while True:
        try:
            start, end, m = reader.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at and not dropped:
            out.add(_decoded(page[at:start]), in_link)
        at = end
        if m is None:
            break
        if m.re is _OTHER:
            if m["cdata"] and not dropped:
                out.add(m["cdata"], in_link)
            continue
        tag = m["name"].lower()
        if m["close"]:
            if tag == "br":
                out.add(" ", in_link) if not dropped else None
            elif (blocks if tag in BLOCKS else inline)[tag] > 0:  # an inline end tag closes nothing beyond its block
                pop_to(_innermost(stack, tag))
            elif tag == "p":
                end_line() if not dropped else None
            continue
        if tag in RAW:  # no markup inside; up to its end tag
            close = _END_OF[tag].search(page, at)
            at = go_on = close.end() if close else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                end_line() if not dropped else None
            elif not dropped:
                out.add(" ", in_link)
            continue
        shut = {"p"} if tag in CLOSES_P else SELF_CLOSING.get(tag, ())
        if any(blocks[e] for e in shut):
            for i in range(len(stack) - 1, -1, -1):
                e = stack[i][0]
                if e in shut:
                    pop_to(i)
                    break
                if e in BLOCKS or e == "table":
                    break
        attrs = m["attrs"]
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        state = (place, part, depth, dropped, in_link)
        if tag in BLOCKS and not dropped:
            end_line()
        if tag in ("td", "th") and not dropped:
            out.add(" ", in_link)
        if dropped:
            if _boilerplate(tag, attrs):
                dropped = ALL
            elif dropped == BUT_HEADINGS and tag in HEADINGS:
                dropped = NOTHING
        elif tag == "header" or _boilerplate(tag, attrs):
            end_line()
            dropped = BUT_HEADINGS if tag == "header" and place > PAGE else ALL
            out.boilerplate()
        elif tag in ("article", "main"):
            parts += 1
            place, part = (ARTICLE if tag == "article" else max(place, MAIN)), parts
        if tag == "a":
            in_link = True
        stack.append((tag, state, inline))
        if tag in CONTAINERS:
            depth += 1
        if tag in BLOCKS:
            blocks[tag] += 1
            inline = Counter()
        else:
            inline[tag] += 1
    if at < len(page) and not dropped:
        out.add(_decoded(page[at:]), in_link)
    pop_to(0)
    end_line()
    return out


def _innermost(stack: list, tag: str) -> int:
    return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)


def window_sums(weights: np.ndarray) -> np.ndarray:
    """For each line the weight of it and the lines after it, ``WINDOW`` in all."""
    return np.convolve(weights, np.ones(WINDOW, np.int64), "full")[WINDOW - 1 :]


def stretches(sums: np.ndarray) -> list[tuple[int, int]]:
    """From surge point to dive point (exclusive), those that are dense enough."""
    alive = np.concatenate(([False], sums > 0, [False]))
    surge, dive = np.flatnonzero(alive[1:] & ~alive[:-1]), np.flatnonzero(alive[:-1] & ~alive[1:])
    least = min(sums.max(initial=0) / SHARE, ENOUGH)
    return [(s, e) for s, e in zip(surge, dive) if sums[s:e].max() >= least]


def kept_lines(lines: Lines) -> list[str]:
    """The lines between surge and dive points of the window sums."""
    rows, weights = [], []  # line numbers, -1 for empty lines
    marked = max(lines.place, default=PAGE) > PAGE
    for i, (text, linked, place, apart) in enumerate(zip(lines.text, lines.linked, lines.place, lines.apart)):
        if apart:
            rows += [-1] * WINDOW
            weights += [0] * WINDOW
        rows.append(i)
        weights.append(len(text) if (place > PAGE if marked else 4 * linked < 3 * len("".join(text.split()))) else 0)
    if not rows:
        return []
    rows, weights = np.array(rows), np.array(weights, np.int64)
    places = np.where(rows < 0, 0, np.array(lines.place)[rows])
    sums = window_sums(weights)
    if marked and sums[places == ARTICLE].max(initial=0) == sums.max():
        weights[places == MAIN] = 0
        sums = window_sums(weights)
    out = []
    for s, e in stretches(sums):
        heavy = s + np.flatnonzero(weights[s:e])
        out += [lines.text[i] for i in rows[heavy[0] : heavy[-1] + 1] if i >= 0]
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(kept_lines(lines_of(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches):
        for b in batches:
            html = b.column("html")
            texts = [main_text(x.as_py()) for x in html]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    return in_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
