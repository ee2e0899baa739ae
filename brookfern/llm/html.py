"""Main text of web pages by minimum-cut labelling of blocks.

A page becomes its blocks of text in page order.  A linear classifier gives each block log odds
of being content from the elements around it, their class and id words, its share of link
text, its length and its punctuation; these are the capacities to the two terminals.  Blocks
that are neighbours on the page, and blocks that are next to each other under one parent, are
joined by edges on the same scale, whose capacity falls with their distance in the tree: neighbours outvote a name
like ``social-history``, but not one like ``social``.  The minimum cut, found by maximum flow, is the
cheapest labelling.  Blocks whose costs outweigh all their edges are settled first, which changes no
minimum cut and leaves few blocks to the flow.  A marked inline element is a block within the block around it.

Defined results: null or empty html has empty text; scripts, styles, templates, form
controls, the head and comments of the markup are never text; an unclosed element ends with its
parent, an unclosed button, select or svg at the next block, and unclosed code at the end of the page; a stray end tag is ignored; a page cut off in a tag keeps what came before;
repeated pages give equal texts; very long pages are read whole; other columns pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>"
    r"|</?[a-zA-Z][^<>]*(?:>|$)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose text is never text of the page.  Only the code of the first two runs to the end of the page if they are not closed.
CODE = ("script", "style")
SKIPPED = frozenset((*CODE, "textarea", "noscript", "template", "iframe", "svg", "math", "select", "button", "title", "object", "canvas"))
_TAGS = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in SKIPPED}
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_VALUES = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
_UNSEEN = re.compile(r"\sstyle\s*=[^>]*display\s*:\s*none", re.I)

#: Elements that do not end a block of text (fixed by the HTML vocabulary).
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Log odds for content (positive) or boilerplate (negative) of an element around a block.
ELEMENT = {"article": 2.0, "main": 1.5, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "head": -12.0, "dialog": -8.0, "fieldset": -8.0}
#: Words of class, id, role and label attributes.
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notification alert comment comments respond disqus sidebar aside menu nav navigation navbar breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager copyright legal skip search toolbar complementary contentinfo teaser tracking".split())
GOOD_WORDS = frozenset("article content post entry story main body text prose".split())
#: Words of names that say where something stands or what shape it has, but not what it is.
PLACE_WORDS = frozenset("area bar block bottom box button buttons center col column container first form group head header icons info inner item items label last law left link links list message messages module more news outer page panel policy right row section site slot small text this thread title top unit us widget wrap wrapper".split())
#: Log odds of a name all of whose telling words are boilerplate words (of others by the cube of their share), and of one with a content word.
BAD_WEIGHT, GOOD_WEIGHT = -6.0, 1.0
HEADER_OUTSIDE = -8.0
#: Log odds that blocks that are neighbours on the page, or next to each other under one parent, are alike.
NEIGHBOUR, SIBLING = 2.4, 0.8


class _Block:
    """A run of text; an inline boilerplate element in it is a block of its own, which stands among its parts."""

    __slots__ = ("parts", "links", "score", "path", "tag", "host")

    def __init__(self, path: tuple[int, ...], tag: str, score: float, host: _Block | None = None):
        self.parts, self.links, self.path, self.tag, self.score, self.host = [], 0, path, tag, score, host

    def text(self, kept: set[int] | None = None) -> str:
        """Its own text, with that of inner blocks if they are kept."""
        pieces = [p if isinstance(p, str) else p._raw(kept) for p in self.parts if isinstance(p, str) or (kept is not None and id(p) in kept)]
        return " ".join(entities.unescape("".join(pieces)).split())

    def _raw(self, kept: set[int]) -> str:
        return "".join(p if isinstance(p, str) else p._raw(kept) for p in self.parts if isinstance(p, str) or id(p) in kept)


def _name_odds(name: str) -> float:
    """Log odds of one class, id, role or label: the share of boilerplate words among those that say what it is."""
    words = [w for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    bad = sum(w in BAD_WORDS for w in words)
    if bad:
        return BAD_WEIGHT * (bad / sum(w in BAD_WORDS or w not in PLACE_WORDS and w not in GOOD_WORDS for w in words)) ** 3
    return GOOD_WEIGHT if any(w in GOOD_WORDS for w in words) else 0.0


def _attr_score(attrs: str) -> float:
    if not attrs:
        return 0.0
    odds = [_name_odds(name) for m in _ATTR.findall(attrs) for name in "".join(m).split()]
    least = min(odds, default=0.0)
    return (least if least < 0 else max(odds, default=0.0)) + (BAD_WEIGHT if _HIDDEN.search(_VALUES.sub("", attrs)) or _UNSEEN.search(attrs) else 0.0)


def blocks(page: str) -> list[_Block]:
    """The blocks of a page, in page order; only the last ones of those inline may have no text."""
    # Open elements: name, number, score of it and all around it, whether an article or main is around, the block that goes on after it.
    stack: list[tuple[str, int, float, bool, _Block | None]] = [("", 0, 0.0, False, None)]
    out: list[_Block] = []
    now: _Block | None = None
    links, number, at = 0, 0, 0
    dropped = 0  # open elements whose text is skipped

    def add(text: str) -> None:
        nonlocal now
        if dropped:
            return
        if now is None:
            if not text.strip():
                return
            outer = [e for e in stack if e[0] not in INLINE]
            now = _Block(tuple(e[1] for e in outer), outer[-1][0], stack[-1][2])
            out.append(now)
        now.parts.append(text)
        if links:
            now.links += len(text.strip())

    def shut(i: int) -> None:
        """Close the open elements from the i-th on."""
        nonlocal now, dropped
        for name, _, _, _, goes_on in reversed(stack[i:]):
            if name in SKIPPED:
                dropped -= 1
            elif name in INLINE and goes_on is not None:
                now = goes_on
        del stack[i:]

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name, attrs, close = m["name"].lower(), m["attrs"] or "", bool(m["close"])
        if name in SKIPPED and not close:
            if attrs.endswith("/") and name in ("svg", "math"):
                continue
            tag = _TAGS[name].search(page, at)
            while tag and not tag[1] and name in CODE:
                tag = _TAGS[name].search(page, tag.end())
            if tag and tag[1]:
                stop = page.find(">", tag.end())
                at = len(page) if stop < 0 else stop + 1
            elif name in CODE:
                break
            elif name in ("button", "select", "svg", "math"):
                # Not closed before the next one: it ends with its parent or at the next block.
                number += 1
                dropped += 1
                stack.append((name, number, stack[-1][2], stack[-1][3], now))
            if name == "title":
                now = None
            continue
        if name in INLINE or name in SKIPPED:
            if name == "br":
                if now is not None:
                    now.parts.append(" ")
            elif close:
                if name == "a":
                    links = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        shut(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] not in SKIPPED:
                        break
            elif name not in VOID:
                links += name == "a"
                score = min(0.0, _attr_score(attrs))
                if score < 0 or stack[-1][0] in INLINE:
                    # Marked inline elements are blocks inside the block around them; plain ones in them only balance their end tags.
                    number += 1
                    goes_on = None
                    if score < 0 and not dropped:
                        goes_on, outer = now, [e for e in stack if e[0] not in INLINE]
                        now = _Block((*(e[1] for e in outer), number), outer[-1][0], stack[-1][2] + score, goes_on)
                        out.append(now)
                        if goes_on is not None:
                            goes_on.parts.append(now)
                    stack.append((name, number, stack[-1][2] + score, stack[-1][3], goes_on))
                    if score < 0 and goes_on is None and not dropped:
                        now.tag = "span"
            continue
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    shut(i)
                    break
            now, links = None, 0
            continue
        if dropped and name in ("option", "optgroup"):
            continue
        while stack[-1][0] in SKIPPED:
            shut(len(stack) - 1)
        if name in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    shut(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in same:
                    shut(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "tbody", "div", "section", "article") or (name in ("td", "th") and stack[i][0] == "tr"):
                    break
        elif name == "body":
            stack = [e for e in stack if e[0] != "head"]
        now, links = None, 0
        if name in VOID:
            continue
        number += 1
        score, inside = stack[-1][2], stack[-1][3]
        own = ELEMENT.get(name, 0.0)
        if name == "header" and not inside:
            own = HEADER_OUTSIDE
        stack.append((name, number, score + own + _attr_score(attrs), inside or name in ("article", "main"), None))
    return [b for b in out if b.text()]


def _lean(text: str, surroundings: float, link_share: float, tag: str) -> float:
    """Cost of calling the block boilerplate less the cost of calling it content."""
    lean = surroundings - 6.0 * (link_share - 0.3) * (link_share > 0.3)
    words = text.count(" ") + 1
    lean += min(words, 60) / 20 - 0.8
    if text[-1:] in ".!?:;\"”»…)" or any(c in text for c in ".,;"):
        lean += 0.4
    if tag in ("p", "blockquote", "pre"):
        lean += 0.8
    elif tag in ("h1", "h2", "h3"):
        lean += 0.8
    if surroundings <= 0 and (text[:1] in "©®" or "all rights reserved" in text.lower()):
        lean -= 4.0
    return lean


def min_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: lean > 0 is lost by False, < 0 by True, an edge by unlike ends."""
    n = len(lean)
    label: list[bool | None] = [None] * n
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        around[a].append((b, w))
        around[b].append((a, w))
    pull, hold = list(lean), [sum(w for _, w in near) for near in around]
    ready = deque(i for i in range(n) if abs(pull[i]) > hold[i] or not hold[i])
    while ready:
        i = ready.popleft()
        if label[i] is not None:
            continue
        label[i] = pull[i] > 0
        for j, w in around[i]:
            if label[j] is None:
                pull[j] += w if label[i] else -w
                hold[j] -= w
                if abs(pull[j]) > hold[j] + 1e-12 or hold[j] <= 1e-12:
                    ready.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow(rest, pull, around), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _flow(rest: list[int], pull: list[float], around: list[list[tuple[int, float]]]) -> list[bool]:
    """Source side of the minimum cut over the unsettled blocks (Dinic's algorithm)."""
    place = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(forth)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in rest:
        if pull[i] > 0:
            edge(source, place[i], pull[i], 0.0)
        elif pull[i] < 0:
            edge(place[i], sink, -pull[i], 0.0)
        for j, w in around[i]:
            if j in place and i < j:
                edge(place[i], place[j], w, w)
    while True:
        level = [-1] * (sink + 1)
        level[source] = 0
        line = deque([source])
        while line:
            a = line.popleft()
            for e in graph[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    line.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(rest))]
        turn = [0] * (sink + 1)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, a = [], source
                continue
            while turn[a] < len(graph[a]):
                e = graph[a][turn[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(graph[a]):
                path.append(graph[a][turn[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                a = to[path.pop() ^ 1]
                turn[a] += 1


def main_text(page: str | None) -> str:
    """The blocks of the article, in page order, joined by two line breaks."""
    found = blocks(page or "")
    if not found:
        return ""
    texts = [b.text() for b in found]
    lean = [_lean(t, b.score, min(1.0, b.links / len(t)), b.tag) for t, b in zip(texts, found, strict=True)]
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, ...], int] = {}
    for i, block in enumerate(found):
        path = block.path
        if i:
            before = found[i - 1].path
            shared = 0
            for x, y in zip(before, path, strict=False):
                if x != y:
                    break
                shared += 1
            apart = len(before) + len(path) - 2 * shared
            edges[i - 1, i] = NEIGHBOUR / (1 + apart)
        parent = path[:-1]
        if parent in last:
            pair = (last[parent], i)
            edges[pair] = edges.get(pair, 0.0) + SIBLING
        last[parent] = i
    keep = min_cut(lean, [(a, b, w) for (a, b), w in edges.items()])
    kept = {id(b) for b, k in zip(found, keep, strict=True) if k}
    # An inner block stands in the text of the block around it if both are kept.
    shown = [b for b, k in zip(found, keep, strict=True) if k and not (b.host is not None and id(b.host) in kept)]
    return "\n\n".join(b.text(kept) for b in shown)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of column ``html`` in column ``text``, which is replaced if there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n for n in batch.schema.names if n != text]
            texts = pa.array([main_text(x.as_py()) for x in batch.column(batch.schema.get_field_index(html))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), texts], [*keep, text])

    kinds = [(f.name, f.dataType.simpleString()) for f in pages.schema.fields if f.name != text]
    return pages.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*kinds, (text, "string")]))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
