"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks: runs of text between block-level tags. A linear classifier (tags, class and id
words, link share, length) gives each block a cost for either label, its capacities to the two
terminals. Neighbouring blocks, and blocks that follow each other in one parent, are joined by edges
that cost what splitting them costs; an edge across a sectioning element costs less. The minimum cut
labels all blocks of a page at once; costs and edges are of one size, so a block's surroundings decide where
its own costs are weak or wrong. Blocks whose terminal costs outweigh all their edges are settled
beforehand, which leaves the cut the same and less of a flow to find.

The parser reads a page once, from left to right, with a stack and the places of open tags in it, so
its time grows with the page's length however deep it is nested and whatever it leaves open.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, map_text, only

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What can end a tag, or start a quoted value in it.
EDGE = re.compile(r">|=\s*[\"']?")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden|itemprop)(?![^\s=/])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Fixed values of the HTML standard: elements that are empty, that hold no markup, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math canvas object audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul caption head button label".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot option optgroup label button legend caption body html head".split())
#: Which open elements a start tag ends, and where the search for them stops.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
P_STOPS = ("table", "td", "th", "button")
SECTION = frozenset("nav aside footer header form dialog menu search".split())
#: Words in class, id or role that speak for or against main text.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promotions banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside complementary contentinfo widget widgets cookie cookies consent notice notices gdpr privacy popup modal dialog overlay newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations trending popular comment comments commentlist disqus reply replies respond reader pagination pager toolbar search alert copyright legal disclaimer skip hidden outbrain taboola tags".split()
)
FOR = frozenset("article articlebody content main maincontent post entry story body text prose".split())
SCALE = 1000
#: Weights of the classifier and of edges, in one unit: what a block's own evidence or a neighbour is worth.
BASE, PER_WORD, MOST_WORDS, LINKS = -0.4, 1 / 15, 2.0, -3.0
TAGS = {"p": 0.8, "blockquote": 0.8, "pre": 0.8, "h1": 0.9, "h2": 0.9, "h3": 0.9, "h4": 0.9, "h5": 0.9, "h6": 0.9, "li": -0.3}
OUTSIDE, INSIDE, HEADER = -4.0, 2.5, -5.0
SAME_PARENT, NEXT, SIBLING, APART = 0.8, 0.4, 0.4, 0.35


class _Node:
    __slots__ = ("bad", "block", "good", "header", "link", "number", "parent", "tag")

    def __init__(self, tag: str, number: int, parent: _Node | None, bad: bool, good: bool, header: bool, link: bool):
        self.tag, self.number, self.parent, self.bad, self.good, self.header, self.link = tag, number, parent, bad, good, header, link
        self.block = self if parent is None or tag in BLOCK else parent.block  # the nearest block-level element


class _Block:
    __slots__ = ("links", "node", "parts", "text")

    def __init__(self, node: _Node):
        self.node, self.parts, self.links, self.text = node, [], 0, ""


def _opened(tag: str, attributes: str, number: int, parent: _Node) -> _Node:
    bad, good, header = parent.bad, parent.good, parent.header
    if tag in ("article", "main"):
        bad, good, header = bad and parent.tag in SECTION, True, False
    elif tag == "header" and good and not bad:
        header = True  # an article's own header: headings in it count
    elif tag in SECTION or tag in ("button", "select", "label", "fieldset"):
        bad, good = True, False
    if attributes and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                bad, good = True, False
            elif name in ("class", "id", "role", "itemprop"):
                words = set(re.split(r"[^a-z0-9]+", value))
                if words & AGAINST and tag not in ("article", "main"):
                    bad, good = True, False
                elif words & FOR and not bad:
                    good = True
    return _Node(tag, number, parent, bad, good, header, parent.link or tag == "a")


class _Stack:
    """Open elements, and for each tag where in the stack it is open."""

    def __init__(self):
        self.nodes, self.at, self.blocks = [_Node("", 0, None, False, False, False, False)], {}, []

    def top(self) -> _Node:
        return self.nodes[-1]

    def last(self, *tags: str) -> int:
        """Where the innermost of these tags is open; 0: none is."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def push(self, node: _Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at place and all inside it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the tag's > is. A quoted value may hold one; a quote that nothing closes is an ordinary character."""
    while True:
        found = EDGE.search(html, at)
        if found is None:
            return len(html)
        at, mark = found.end(), html[found.end() - 1]
        if mark == ">":
            return at - 1
        if mark in last and at <= last[mark]:
            at = html.index(mark, at) + 1


def page_blocks(html: str) -> list[_Block]:
    """Blocks with text, in page order; comments, scripts, styles and other raw elements are left out."""
    stack, number, at, end = _Stack(), 0, 0, len(html)
    last = {mark: html.rfind(mark) for mark in "\"'>"}
    blocks, now = [], _Block(stack.top())

    def finish() -> None:
        nonlocal now
        if now.parts:
            text = " ".join(unescape("".join(now.parts)).split())
            if text:
                now.text = text
                blocks.append(now)
        now = _Block(stack.top())

    def add(text: str) -> None:
        if not now.parts:
            if text.isspace():
                return
            now.node = stack.top()
        now.parts.append(text)
        if stack.top().link:
            now.links += len(text)

    def imply(tag: str) -> None:
        """Closes what a block-level start tag ends: a p, and list items, cells and the like."""
        if tag in CLOSES_P:
            stops = P_STOPS if tag in ("li", "dt", "dd") else (*P_STOPS, "li", "dd", "dt")
            place = stack.last("p")
            if place > stack.last(*stops):
                stack.cut(place)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            place = stack.last(*ends)
            if place > stack.last(*stops):
                stack.cut(place)

    while at < end:
        start = html.find("<", at)
        if start < 0 or start > last[">"]:  # no tag can end any more: what is left is text, up to an unfinished tag
            rest = html[at:] if start < 0 or not NAME.match(html, start + 1) else html[at:start]
            if rest:
                add(rest)
            break
        if start > at:
            add(html[at:start])
        if html.startswith("<!--", start):
            close = html.find("-->", start + 2)
            at = close + 3 if close >= 0 else end
            continue
        if html[start + 1 : start + 2] in ("!", "?"):
            at = html.index(">", start) + 1
            continue
        named = NAME.match(html, start + 1)
        if not named:
            add("<")
            at = start + 1
            continue
        stop = _tag_end(html, named.end(), last)
        attributes, tag, at = html[named.end() : stop], named[2].lower(), stop + 1
        if not named[1]:
            if tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    stop = html.find(">", close.end()) if close else -1
                    at = stop + 1 if stop >= 0 else end
                continue
            if tag == "br":
                if now.parts:
                    now.parts.append(" ")
                continue
            if tag in BLOCK:
                finish()
                imply(tag)
            if tag not in VOID:
                number += 1
                stack.push(_opened(tag, attributes, number, stack.top()))
            if tag in BLOCK:
                now.node = stack.top()
        else:
            place = stack.last(tag)
            if tag in BLOCK:
                finish()
            elif stack.blocks and place < stack.blocks[-1]:
                place = 0  # a stray inline end tag doesn't close blocks
            if place:
                stack.cut(place)
                if tag in BLOCK:
                    now.node = stack.top()
    finish()
    return blocks


def block_cost(block: _Block) -> int:
    """Positive: speaks for main text; what labelling it otherwise costs."""
    own, node, text = block.node.block, block.node, block.text
    value = BASE + min(MOST_WORDS, PER_WORD * (text.count(" ") + 1)) + LINKS * min(1.0, block.links / max(1, len(text))) + TAGS.get(own.tag, 0.0)
    if node.bad:
        value += OUTSIDE
    elif node.good:
        value += INSIDE
        if node.header and own.tag[:1] != "h":
            value += HEADER
    return round(SCALE * value)


def block_edges(blocks: list[_Block]) -> list[tuple[int, int, int]]:
    """Adjacent blocks, and blocks that follow each other in one parent; less where only one of them is in a
    sectioning element, or one named as such."""
    out, last_in = [], {}
    own = [b.node.block for b in blocks]

    def edge(i: int, j: int, weight: float) -> None:
        apart = (blocks[i].node.bad, blocks[i].node.good) != (blocks[j].node.bad, blocks[j].node.good)
        out.append((i, j, round(SCALE * weight * (APART if apart else 1.0))))

    for i, node in enumerate(own):
        above = node.parent or node
        if i:
            same = own[i - 1].parent is node.parent or own[i - 1] is above or own[i - 1].parent is node
            edge(i - 1, i, SAME_PARENT if same else NEXT)
        before = last_in.get(above.number)
        if before is not None and before < i - 1:
            edge(before, i, SIBLING)
        last_in[above.number] = i
    return out


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source's side: a node's positive cost is its capacity from the source, a
    negative one to the sink, an edge's weight its capacity either way. Of equal cuts, the one with
    the fewest nodes on the source's side."""
    n = len(costs)
    weight, near = [0] * n, [[] for _ in range(n)]
    for a, b, w in edges:
        weight[a] += w
        weight[b] += w
        near[a].append((b, w))
        near[b].append((a, w))
    label: list[bool | None] = [None] * n
    costs = list(costs)
    ready = deque(range(n))
    while ready:  # settle what outweighs its edges; its edges become costs of the neighbours
        i = ready.popleft()
        if label[i] is None and (costs[i] > weight[i] or costs[i] < -weight[i]):
            label[i] = costs[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    costs[j] += w if label[i] else -w
                    weight[j] -= w
                    ready.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        side = _flow_side([costs[i] for i in rest], [(number[a], number[b], w) for a, b, w in edges if a in number and b in number])
        for i in rest:
            label[i] = side[number[i]]
    return label  # type: ignore[return-value]


def _flow_side(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Dinic's maximum flow, then who the source still reaches."""
    n = len(costs)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: int, back: int) -> None:
        for x, y, w in ((a, b, forth), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            room.append(w)

    for i, c in enumerate(costs):
        if c > 0:
            join(source, i, c, 0)
        elif c < 0:
            join(i, sink, -c, 0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn, path = [0] * (n + 2), []
        while True:
            x = to[path[-1]] if path else source
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path = path[: next(k for k, e in enumerate(path) if room[e] == 0)]
                continue
            while turn[x] < len(out[x]):
                e = out[x][turn[x]]
                if room[e] > 0 and level[to[e]] == level[x] + 1:
                    path.append(e)
                    break
                turn[x] += 1
            else:
                if not path:
                    break
                path.pop()
                turn[to[path[-1]] if path else source] += 1


def main_text(html: str | None) -> str:
    """The main text: blocks in page order, two line feeds between; empty if there are none."""
    blocks = page_blocks(html or "")
    if not blocks:
        return ""
    labels = minimum_cut([block_cost(b) for b in blocks], block_edges(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages, nulls and repeats kept. A null or
    empty html, and one without main text, gives an empty text; an empty table gives none. Nothing is cut or
    capped: a page of any length and depth is read whole. Other columns, whatever their names, play no part. No shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = list(map(main_text, filled(batch.column("html")).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = only(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))
    return map_text(chosen, run, "page_id long, url string, text string, n_chars long", "html")
