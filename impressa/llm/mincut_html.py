"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks: runs of text between block-level tags.  A linear classifier over the
block's text, tags, class names and containers gives every block a score; its size becomes the capacity of
an edge to the source (content) or the sink (boilerplate).  Neighbouring blocks in page order and
blocks of the same parent element are joined by smoothness edges, stronger the closer they are in
the element tree.  The minimum cut, found by maximum flow, separates content from boilerplate:
a doubtful block follows its surroundings, a clear one keeps its label.

Scripts, styles and other elements without readable text never become blocks.  Character
references are decoded, white space inside a block becomes one space, and the content blocks are
joined by one space in page order; nothing else is dropped.

Defined cases: null or empty html gives an empty text; broken markup is read as far as its tags go
(a closing tag without an opening one is ignored, an unclosed element ends with its parent; an element
without readable text that is not closed inside its parent ends before the next block, and only an
unclosed script, style, title or textarea goes on to the end of the page); an element whose names speak
both for and against it says nothing, its text decides; formulas are text;
repeated rows are extracted alike; null keys are kept; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from impressa.llm.registry import query, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
                  re.S)
_NAMED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

# Elements by role, as HTML defines them.
SILENT = frozenset("script style noscript template svg iframe object canvas audio video head title select option "
                   "textarea button datalist annotation annotation-xml".split())
RAW = frozenset("script style title textarea".split())  # their content holds no tags
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search "
                   "section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What containers say about the text inside: log-odds of being content.
CONTAINER = {"article": 3.0, "main": 2.5, "nav": -6.0, "aside": -6.0, "footer": -6.0, "header": -5.0, "form": -6.0,
             "menu": -6.0, "dialog": -6.0, "search": -6.0, "address": -2.0}
BAD_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar side aside ad ads advert adverts "
    "advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe signup login search share sharing social related recommended widget comment "
    "comments respond reply replies discussion disqus copyright legal pagination pager toolbar contentinfo complementary "
    "form paywall".split())
GOOD_NAMES = frozenset("article content post entry story main body text prose maincontent".split())
# Linear classifier of a block's own text.
BIAS, PER_WORD, MAX_WORDS, LINKS, SENTENCE, HEADING, LIST_ITEM = -0.4, 0.06, 40, -4.0, 0.5, 0.3, -0.5
# Smoothness: capacity between neighbours in page order and between neighbours of one parent.
ADJACENT, SIBLING = 1.2, 0.8


class _Block:
    __slots__ = ("parts", "linked", "parent", "path", "score", "tag")

    def __init__(self, parent, path, score, tag):
        self.parts, self.linked, self.parent, self.path, self.score, self.tag = [], 0, parent, path, score, tag


def _named(attributes: str) -> float:
    """What class, id and role say.  A name is bad if one of its parts is (``comment-body`` is part of a
    comment); good and bad names on one element cancel out."""
    good = bad = 0
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _WORD.findall(name)
            if not BAD_NAMES.isdisjoint(parts):
                bad += 1
            elif not GOOD_NAMES.isdisjoint(parts):
                good += 1
    return 0.0 if good and bad else -6.0 * bad + 1.0 * good


class _Silent:
    """Where elements without readable text end; remembers closing tags it has found."""

    def __init__(self, page: str):
        self.page, self.close = page, {}

    def _closing(self, tag: str, at: int):
        known = self.close.get(tag)
        if known is None or known[0] < at:
            m = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(self.page, at)
            known = self.close[tag] = (m.start(), m.end()) if m else (len(self.page), -1)
        return known

    def end(self, tag: str, at: int, parent: str) -> int:
        start, stop = self._closing(tag, at)
        if tag in RAW:
            return stop if stop >= 0 else len(self.page)
        block, depth = None, 0
        for m in _TAG.finditer(self.page, at, start):
            name = (m[2] or m[5] or "").lower()
            if name not in BLOCKS:
                continue
            block = m.start() if block is None else block
            if name == parent:
                depth += -1 if m[1] or m[4] else 1
                if depth < 0:  # the parent ends first
                    return block
        if stop >= 0:
            return stop
        return len(self.page) if block is None else block


def blocks(page: str) -> list[_Block]:
    """Text blocks with their container's log-odds, in page order."""
    out: list[_Block] = []
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]  # (tag, number, log-odds) of open block elements
    path: tuple[int, ...] = (0,)
    number, links, fresh, at = 0, 0, True, 0
    silent = _Silent(page)

    def text(piece: str):
        nonlocal fresh
        if fresh:
            if not piece.strip():
                return
            out.append(_Block(stack[-1][1], path, stack[-1][2], stack[-1][0]))
            fresh = False
        out[-1].parts.append(piece)
        if links:
            out[-1].linked += len(piece)

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], (m[3] or m[6] or "")
        if tag in SILENT:
            if not closing and not attributes.endswith("/"):
                if tag == "head":
                    continue
                at = silent.end(tag, at, stack[-1][0])
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            if not fresh:
                out[-1].parts.append(" ")
        elif tag in BLOCKS:
            fresh = True
            if tag in VOID:
                continue
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        path = path[:i]
                        links = 0
                        break
            else:
                if tag in ("p", "li") and stack[-1][0] == tag or tag not in ("li", "ul", "ol") and stack[-1][0] == "p":
                    stack.pop()
                    path = path[:-1]
                number += 1
                own = CONTAINER.get(tag, 0.0) + (_named(attributes) if attributes else 0.0)
                stack.append((tag, number, stack[-1][2] + own))
                path = (*path, number)
    return out


def _odds(block: _Block, words: list[str]) -> float:
    n = len(words)
    size = sum(map(len, block.parts)) or 1
    odds = block.score + BIAS + PER_WORD * min(n, MAX_WORDS) + LINKS * min(1.0, block.linked / size)
    if n and words[-1][-1] in ".!?…":
        odds += SENTENCE
    if block.tag[:1] == "h" and block.tag[1:].isdigit():
        odds += HEADING
    return odds + (LIST_ITEM if block.tag == "li" else 0.0)


def _closeness(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """1 for the same parent, falling with the steps between the two in the element tree."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return 1.0 / (1.0 + 0.5 * max(0, len(a) + len(b) - 2 * same - 2))


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of the minimum cut with terminal capacities ``|odds|`` and
    symmetric ``edges``, by Dinic's blocking flows."""
    n = len(odds)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(u, v, c, back):
        graph[u].append(len(to))
        to.append(v)
        cap.append(c)
        graph[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, o in enumerate(odds):
        if o > 0:
            add(source, i, o, 0.0)
        elif o < 0:
            add(i, sink, -o, 0.0)
    for u, v, c in edges:
        add(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for u in queue:
            for e in graph[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        while True:  # one augmenting path after another in the level graph, without recursion
            walk, u = [], source
            while u != sink:
                while place[u] < len(graph[u]):
                    e = graph[u][place[u]]
                    if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                        break
                    place[u] += 1
                else:
                    if not walk:
                        break
                    u = to[walk.pop() ^ 1]
                    place[u] += 1
                    continue
                walk.append(e)
                u = to[e]
            if u != sink:
                break
            flow = min(cap[e] for e in walk)
            for e in walk:
                cap[e] -= flow
                cap[e ^ 1] += flow


def main_text(page: str | None) -> str:
    """The page's content blocks."""
    found, odds, texts = [], [], []
    for b in blocks(page or ""):
        joined = "".join(b.parts)
        words = (entities.unescape(joined) if "&" in joined else joined).split()
        if words:
            found.append(b)
            texts.append(" ".join(words))
            odds.append(_odds(b, words))
    if not found:
        return ""
    if min(odds) > 0:
        return " ".join(texts)
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT * _closeness(found[i - 1].path, b.path)))
        before = last.get(b.path[:-1])
        if before is not None and before != i - 1:
            edges.append((before, i, SIBLING))
        last[b.path[:-1]] = i
    return " ".join(t for t, keep in zip(texts, minimum_cut(odds, edges)) if keep)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html") \
        .mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


@query("op9_mincut_html")
def op9(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))
