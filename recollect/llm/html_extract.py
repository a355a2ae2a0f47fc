"""Main text of web pages by minimum-cut labelling of text blocks.

A page is read into blocks of text. A linear classifier over a block's elements, class names, length, link share and
punctuation gives the cost of either label, which become the capacities of its edges to the two terminals. Blocks that
follow each other, and blocks next to each other within one element, are tied by smoothness edges, the stronger the
nearer they are in the document tree. The smallest cut, found by maximum flow, labels all blocks at once.

The classifier's weights are set by hand (no page comes with labels); `fit` sets them anew from labelled blocks. Names weigh, none
decides alone: a name's last part says what the element is ("post-comments" are comments, "article-header" heads an
article), names that only tell how it looks or what it is filed under ("has-sidebar", "tag-legal") say nothing, and on an element
that holds text itself a name weighs less than on one that holds others. Hidden elements are left out for good.

White space inside a block (line breaks too) is one space; character references are decoded; blocks are joined in page
order by two line feeds.

Rows: null or empty html, and pages of boilerplate only, give the empty text. Unclosed elements are closed as browsers
do for paragraphs and list items, an unclosed comment or script runs to the end of the page, and text outside any
element is a block. Repeated rows are extracted each by itself; empty tables give empty results; of other columns only
those asked for are kept. Time is linear in the page's length, whatever its nesting.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches

TAG = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")

# Elements by their role in HTML.
RAW = frozenset("script style template noscript textarea iframe title".split())
LEFT_OUT = frozenset("object svg select canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
HOLDS_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th span b i em strong a".split())
ELEMENT_WEIGHT = {"article": 4.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "header": -6.0, "menu": -9.0, "button": -9.0, "dialog": -9.0, "head": -20.0, "figcaption": -0.5, "address": -2.0, "fieldset": -6.0}
GOOD = frozenset("article articlebody post entry story content main body text blog title headline".split())
BAD = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|masthead|header|footer|foot|side|sidebar|rail|widgets?|notices?|cookies?|consent|gdpr|popup|modal|overlay|alert|subscribe|subscription|newsletter|signup|login|share|sharing|social|follow|related|recommend\w*|more|tags?|comments?|comment\w+|disqus|respond|reply|replies|discussion|form|search|toolbar|pagination|pager|copyright|legal|disclaimer|complementary|navigation|contentinfo|byline|meta|skip|hidden)\Z"
)
#: On an article or main element these alone say that it is none of the page's.
OTHER_ARTICLE = re.compile(r"(?:comments?|reply|replies|teaser|related|promo\w*|ads?|advert\w*|sponsor\w*)\Z")
#: Beginnings of names that tell how an element looks, or what it is filed under, not what it is.
ABOUT = frozenset("has with without no not is js tag category cat type status format lang page layout theme style".split())
#: Weights of the classifier's features, in the order of `features`.
WEIGHTS = (-2.6, 1.0, 1.1, -7.0, 0.8, 0.5, -6.0)
#: Steps in the tree beyond which two blocks count as this far apart.
FAR = 64


@dataclass
class Block:
    text: str
    linked: int  # characters within links
    context: float  # sum of the weights of the elements around it
    place: int  # number of the block element that holds it
    holder: int  # number of the block element around that
    tag: str


@dataclass
class Page:
    blocks: list[Block]
    above: list[int]  # of each numbered block element, the one around it; 0 is the page
    depth: list[int]


def _evidence(name: str, on_text: bool) -> float:
    """What one class name, id, role or item property says."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name.lower()) if x]
    if not parts or (len(parts) > 1 and parts[0] in ABOUT):
        return 0.0
    good = any(x in GOOD for x in parts)
    if BAD.match(parts[-1]):
        if parts[-1] in ("header", "more", "meta") and good:
            return 0.0
        return -2.5 if on_text else -8.0
    if len(parts) > 1 and not good and any(map(BAD.match, parts)):
        return -1.5 if on_text else -5.0
    return 3.0 if good else 0.0


def _weight(tag: str, attributes: str, inside_main: bool) -> float:
    weight = 0.0 if tag == "header" and inside_main else ELEMENT_WEIGHT.get(tag, 0.0)
    if tag in LEFT_OUT:
        return -40.0
    if not attributes or tag in ("html", "body"):
        return weight
    found: list[float] = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and UNSEEN.search(value)):
            return -40.0
        if key in ("class", "id", "role", "itemprop"):
            for name in value.split():
                if tag in ("article", "main"):
                    found.append(-12.0 if OTHER_ARTICLE.match(name.lower()) else 0.0)
                else:
                    found.append(_evidence(name, tag in HOLDS_TEXT))
    if not found:
        return weight
    return weight + min(0.0, min(found)) + max(0.0, max(found))


def read(page: str) -> Page:
    blocks: list[Block] = []
    above, depth = [0], [0]
    stack: list[tuple[str, float]] = []  # element, sum of weights
    around: list[tuple[str, int]] = []  # block elements with their numbers
    count: dict[str, int] = {}
    ends: dict[str, tuple[int, int]] = {}  # of an element, the last end that was looked for
    parts: list[str] = []
    linked = raw_until = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                place = around[-1][1] if around else 0
                blocks.append(Block(text, linked, stack[-1][1] if stack else 0.0, place, above[place], around[-1][0] if around else ""))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if count.get("a"):
                linked += len(text)

    def close(k: int) -> None:
        while len(stack) > k:
            name, _ = stack.pop()
            count[name] -= 1
            if name in BLOCK:
                around.pop()

    def end_of(tag: str, at: int) -> int:
        """Where the element that begins at this place ends, or the length of the page and one more."""
        found = ends.get(tag)
        if found is None or found[0] < at:
            m = re.compile(rf"(?i)</{tag}\s*>").search(page, at)
            found = ends[tag] = (m.start(), m.end()) if m else (len(page) + 1, len(page) + 1)
        return found[1]

    at = 0
    for m in TAG.finditer(page):
        if m.start() < raw_until:
            continue
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        closing, tag = (m[1], m[2]) if m[2] else (m[4], m[5])
        if tag is None:
            continue
        tag = tag.lower()
        attributes = (m[3] if m[2] else m[6]) or ""
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                end = end_of(tag, at)
                if end <= len(page) or tag != "title":
                    at = raw_until = min(end, len(page))
                elif (rest := page.find("<", at)) >= 0:  # an unclosed title ends with its text
                    at = raw_until = rest
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                say(" ")
            continue
        if tag in BLOCK:
            flush()
        if closing:
            if count.get(tag):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] in BLOCK and tag not in BLOCK:
                        break
            continue
        closes = (("p", "select") if tag in BLOCK and tag != "option" else ()) + CLOSES.get(tag, ())
        for name in closes:
            if not count.get(name):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in BLOCK and stack[k][0] not in ("p", name, "td", "th", "option"):
                    break
        if tag in LEFT_OUT and end_of(tag, at) > len(page):
            continue  # never closed
        weight = _weight(tag, attributes, bool(count.get("article") or count.get("main")))
        stack.append((tag, (stack[-1][1] if stack else 0.0) + weight))
        count[tag] = count.get(tag, 0) + 1
        if tag in BLOCK:
            outer = around[-1][1] if around else 0
            above.append(outer)
            depth.append(depth[outer] + 1)
            around.append((tag, len(above) - 1))
    if raw_until <= at < len(page):
        say(page[at:])
    flush()
    return Page(blocks, above, depth)


def features(block: Block) -> tuple[float, ...]:
    """What the classifier weighs."""
    words = block.text.count(" ") + 1
    ends = block.text[-1] in ".!?…:;\"”»"
    return (1.0, block.context, math.log(1 + words), min(1.0, block.linked / len(block.text)), float(ends), float(block.tag in ("h1", "h2", "h3", "h4", "p", "blockquote", "pre")), float(block.text[0] == "©"))


def score(block: Block, weights: tuple[float, ...] = WEIGHTS) -> float:
    """Log-odds of content."""
    return sum(w * x for w, x in zip(weights, features(block), strict=True))


def fit(blocks: list[Block], content: list[bool], ridge: float = 1.0, rounds: int = 30) -> tuple[float, ...]:
    """Weights from labelled blocks: logistic regression by Newton's method, drawn towards the weights that are set."""
    import numpy as np

    x, y, start = np.array([features(b) for b in blocks]), np.array(content, float), np.array(WEIGHTS)
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * (w - start)
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), slope)
    return tuple(w.tolist())


def ties(page: Page) -> list[tuple[int, int, float]]:
    """Smoothness edges: blocks that follow each other, and neighbours within one element."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(page.blocks):
        if i:
            x, y, apart = page.blocks[i - 1].place, b.place, 0
            while x != y and apart < FAR:  # up to the element around both
                if page.depth[x] >= page.depth[y]:
                    x = page.above[x]
                else:
                    y = page.above[y]
                apart += 1
            out.append((i - 1, i, 1.2 / (1 + apart)))
        if (j := last.get(b.holder)) is not None:
            out.append((j, i, 0.8))
        last[b.holder] = i
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the content side of the smallest cut (Dinic's maximum flow, capacities in thousandths)."""
    n = len(scores)
    source, sink = n, n + 1
    arcs: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, forth: int, back: int) -> None:
        arcs[a].append(len(to))
        to.append(b)
        room.append(forth)
        arcs[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, z in enumerate(scores):
        c = round(1000 * abs(z))
        if z > 0:
            arc(source, i, c, 0)
        elif c:
            arc(i, sink, c, 0)
    for a, b, w in edges:
        c = round(1000 * w)
        arc(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in arcs[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not room[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(arcs[u]):
                e = arcs[u][nxt[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                nxt[u] += 1
                continue
            path.append(e)
            u = to[e]


def extract(page: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    if not page:
        return ""
    found = read(page)
    if not found.blocks:
        return ""
    content = min_cut([score(b, weights) for b in found.blocks], ties(found))
    return "\n\n".join(b.text for b, c in zip(found.blocks, content, strict=True) if c)


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_column: str = "html", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The kept columns, text and n_chars of each page."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for (pages_here,) in batches(iter([batch]), "_html"):
                texts = [extract(p, weights) for p in pages_here]
                kept = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    source = pages.select(*keep, pages[html_column].alias("_html"))
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep)
    return source.mapInArrow(run, f"{kinds}, text string, n_chars long")
