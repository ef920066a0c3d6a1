"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text. Each block's classifier cost (length, links, element, enclosing parts) is its capacity to the content or
the boilerplate terminal; neighbouring blocks, and following blocks of one parent, are tied by edges that weaken with their distance
in the tree, and each block is tied to the longest one of its part. The minimum cut labels the blocks. What a part's name says counts the less, the more of the page's text the part holds,
so no name alone turns a page away; and a short block is worth little by itself: its neighbours decide.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import as_batch, table

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^<>]*+>|(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|/?[a-zA-Z][^<>]*+>)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
# Fixed values of HTML: elements by their part in a page.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object audio video canvas noframes xmp".split())
SWALLOWS = frozenset("script style".split())  # unclosed, they go on to the page's end
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())
AROUND = frozenset("nav footer aside form menu button select option dialog search fieldset legend".split())
TEXTUAL = frozenset("p blockquote pre figcaption td dd dt h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names, and roles, that name boilerplate; content.
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion reader recommend recommended related replies reply respond search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD_WORDS = frozenset("article content body entry post story main text".split())
#: Edge capacities: next block, next block of one parent; what a change of part leaves of them; the longest block of one part.
NEXT, SIBLING, ACROSS, SHARED = 1.2, 0.6, 0.05, 0.4
#: The classifier's weights: any block, on a page of WHOLE words or more; a word (to MANY); links; text elements; parts.
PLAIN, AMID, WHOLE, WORD, MANY, LINKS, TEXT, BARE = -0.4, -0.9, 200, 0.05, 60, -3.0, 0.6, 0.5
WRONG, HIDDEN, INSIDE, OUTSIDE, GOOD, WORST = -5.0, -8.0, 0.55, -1.0, 0.4, -8.0
_SCALE, _FAR = 1000, 40


@dataclass(slots=True)
class Box:
    """A part of a page: what its name is worth, and the words in it that aren't links'."""

    up: int
    worth: float
    hidden: bool
    words: float = 0.0


@dataclass(slots=True)
class Node:
    name: str
    up: Node | None
    depth: int
    part: int  # the nearest box
    inside: bool  # an article or main


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    linked: int


def names(attributes: str) -> tuple[set[str], str, bool]:
    """Words of class and id, the role, whether the element is hidden."""
    words: set[str] = set()
    role, hidden = "", False
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            words.update(x.lower() for x in _TOKEN.findall(value))
        elif key == "role":
            role = value.lower()
        elif key == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        else:
            hidden |= key == "hidden" or value.lower() == "true"
    return words, role, hidden


def _closing(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])[^>]*+>", re.I | re.A)


def blocks(page: str) -> tuple[list[Block], list[Box], bool]:
    """The page's blocks in order, its parts (the first is the page), and whether it has an article or main.

    White space in a block is one space; empty blocks fall away. Every character is read a bounded number of times.
    """
    boxes = [Box(0, 0.0, False)]
    root = Node("", None, 0, 0, False)
    node, out, run, linked, links, whole = root, [], [], 0, 0, False
    opened: dict[str, int] = {}
    unclosed: set[str] = set()
    at, n = 0, len(page)

    def close() -> None:
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(Block(text, node, linked))
                boxes[node.part].words += (text.count(" ") + 1) * (1 - min(1.0, linked / len(text)))
            run, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if links:
                linked += len(text.strip())

    def leave(upto: Node) -> None:
        nonlocal node
        while node is not upto:
            opened[node.name] -= 1
            node = node.up

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        slash, name, attributes = m.group(1), m.group(2), m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not slash and name not in unclosed and not attributes.rstrip().endswith("/"):
                level, stop = 1, at
                for c in _closing(name).finditer(page, at):
                    level += -1 if c.group(1) else (name not in SWALLOWS and not c.group().endswith("/>"))
                    if c.group(1):
                        stop = c.end()
                        if level <= 0 or name in SWALLOWS:
                            break
                if stop > at:
                    at = stop  # the element ends with its own closing tag, or with the last one that there is
                elif name in SWALLOWS:
                    at = n
                else:
                    unclosed.add(name)  # never closed: only the tag goes
            continue
        if name == "br":
            run.append(" ")
            continue
        if name == "a":
            links = 0 if slash else 1
            continue
        if name not in BLOCK:
            continue
        close()
        if slash:
            if opened.get(name):
                up = node
                while up.name != name:
                    up = up.up
                leave(up.up)
            if name != "li" and name != "p":
                links = 0
            continue
        if name in CLOSES_P and node.name == "p":
            leave(node.up)
        elif name in ("li", "option", "tr", "td", "th", "dd", "dt") and node.name in ({"td", "th"} if name in ("td", "th") else {"dd", "dt"} if name in ("dd", "dt") else {name}):
            leave(node.up)
        if name in VOID:
            continue
        part, inside = node.part, node.inside
        worth, hide = 0.0, False
        if name in ("article", "main"):
            whole = inside = True
            boxes.append(Box(part, 0.0, False))
            part = len(boxes) - 1
        elif name not in ("html", "body"):
            words, role, hide = names(attributes) if attributes else (set(), "", False)
            hide = hide or name == "head"
            if name in AROUND or (name == "header" and not inside) or role in BAD_ROLES or words & BAD_WORDS or ("header" in words and not inside):
                worth = WRONG
            elif words & GOOD_WORDS:
                worth = GOOD
            if worth or hide:
                boxes.append(Box(part, worth, hide))
                part = len(boxes) - 1
        opened[name] = opened.get(name, 0) + 1
        node = Node(name, node, node.depth + 1, part, inside)
    close()
    return out, boxes, whole


def standing(boxes: list[Box]) -> list[float]:
    """What each part is worth to its blocks: of a boilerplate name the share that the part lacks of the page's words, and what the parts around it are worth."""
    words = [b.words for b in boxes]
    for k in range(len(boxes) - 1, 0, -1):
        words[boxes[k].up] += words[k]
    out = [0.0]
    for k, b in enumerate(boxes[1:], 1):
        own = HIDDEN if b.hidden else b.worth * (1 - words[k] / words[0] if words[0] else 1) if b.worth < 0 else b.worth
        out.append(max(WORST, out[b.up] + own))
    return out


def preference(b: Block, worth: float, page_words: int, whole: bool) -> float:
    """How much the classifier prefers content over boilerplate for a block, alone. worth: of its part."""
    link = min(1.0, b.linked / max(1, len(b.text)))
    v = PLAIN + AMID * min(1.0, page_words / WHOLE) + WORD * min(b.text.count(" ") + 1, MANY) * (1 - link) + LINKS * link + worth
    v += TEXT if b.node.name in TEXTUAL else 0.0 if b.node.up else BARE
    return v + (INSIDE if b.node.inside else OUTSIDE if whole else 0.0)


def between(a: Node, b: Node) -> int:
    """Steps from one element to another in the tree, as far as _FAR."""
    steps = 0
    while a is not b and steps < _FAR:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def minimum_cut(prefer: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a block against its preference pays it, an edge between labels its capacity. Ties go to boilerplate.

    A block whose preference outweighs all its edges has its label for certain; its edges then pull its neighbours. What is left is
    cut by maximum flow.
    """
    n = len(prefer)
    t = [round(p * _SCALE) for p in prefer]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        w = round(w * _SCALE)
        if w > 0 and i != j:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    tie = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(t[i]) >= tie[i]:
            label[i] = t[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    t[j] += w if label[i] else -w
                    tie[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, content in zip(rest, _flow(rest, t, near), strict=True):
            label[i] = content
    return [bool(x) for x in label]


def _flow(rest: list[int], t: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Dinic's maximum flow from the content terminal; the blocks that it still reaches in the residual graph are content."""
    at = {i: k for k, i in enumerate(rest)}
    s, e = len(rest), len(rest) + 1
    to, cap, adj = [], [], [[] for _ in range(e + 1)]

    def arc(a: int, b: int, c: int, back: int) -> None:
        adj[a].append(len(to))
        to.append(b)
        cap.append(c)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, i in enumerate(rest):
        if t[i] > 0:
            arc(s, k, t[i], 0)
        elif t[i] < 0:
            arc(k, e, -t[i], 0)
        for j, w in near[i].items():
            if j in at and k < at[j]:
                arc(k, at[j], w, w)
    while True:
        level = [-1] * (e + 1)
        level[s] = 0
        q = deque([s])
        while q:
            a = q.popleft()
            for x in adj[a]:
                if cap[x] > 0 and level[to[x]] < 0:
                    level[to[x]] = level[a] + 1
                    q.append(to[x])
        if level[e] < 0:
            return [level[k] >= 0 for k in range(len(rest))]
        nxt = [0] * (e + 1)
        path: list[int] = []
        a = s
        while True:
            if a == e:
                least = min(cap[x] for x in path)
                for x in path:
                    cap[x] -= least
                    cap[x ^ 1] += least
                first = next(k for k, x in enumerate(path) if not cap[x])
                a = to[path[first] ^ 1]
                del path[first:]
            while nxt[a] < len(adj[a]) and not (cap[adj[a][nxt[a]]] > 0 and level[to[adj[a][nxt[a]]]] == level[a] + 1):
                nxt[a] += 1
            if nxt[a] < len(adj[a]):
                path.append(adj[a][nxt[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                a = to[path.pop() ^ 1]
                nxt[a] += 1


def labelled(page: str) -> tuple[list[Block], list[float], list[bool]]:
    """The page's blocks, what the classifier alone prefers, and the labels of the cut."""
    found, boxes, whole = blocks(page)
    worth, page_words = standing(boxes), sum(b.text.count(" ") + 1 for b in found)
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            w = NEXT / (1 + max(0, between(a.node, b.node) - 1) / 2)
            edges.append((i - 1, i, w if a.node.part == b.node.part else w * ACROSS))
        parent = id(b.node.up)
        if (j := last.get(parent)) is not None and j < i - 1:
            edges.append((j, i, SIBLING if found[j].node.part == b.node.part else SIBLING * ACROSS))
        last[parent] = i
    longest: dict[int, int] = {}
    for i, b in enumerate(found):
        if len(b.text) > len(found[longest.setdefault(b.node.part, i)].text):
            longest[b.node.part] = i
    edges += [(k, i, SHARED) for i, b in enumerate(found) if (k := longest[b.node.part]) != i]
    prefer = [preference(b, worth[b.node.part], page_words, whole) for b in found]
    return found, prefer, minimum_cut(prefer, edges)


def main_text(page: str | None) -> str:
    """The page's main text; empty for null, empty and text-free pages."""
    if not page:
        return ""
    found, _, label = labelled(page)
    return " ".join(b.text for b, keep in zip(found, label, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; n_chars counts code points. A null or empty page has an empty text; repeated rows each have theirs; pages of any length are read whole; further columns don't matter."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                text = [main_text(h) for h in part.column(2).to_pylist()]
                yield as_batch(schema, page_id=part.column(0), url=part.column(1), text=text, n_chars=[len(t) for t in text])

    return table(pages, {"page_id": "bigint", "url": "string", "html": "string"}).mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")


