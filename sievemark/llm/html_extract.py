"""Main text of web pages by minimum-cut labelling.

A page becomes its text blocks in page order.  A fitted classifier (:mod:`.html_model`) gives each block a cost of being
content and a cost of being boilerplate, the capacities of its edges to the two terminals; neighbouring blocks, and
blocks close to each other in the document tree, are joined by smoothness edges.  The minimum cut, found by maximum
flow, labels all blocks of the page at once.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import html_model

# Fixed values of HTML: elements by their content model.
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
#: Elements that show no text of their own; one that is never closed is an ordinary element.
UNSEEN = frozenset("template noscript svg canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these open elements, if no element of the second set lies between.
ENDS = {
    "p": ({"p"}, BLOCK - {"p"}),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCK - {"button", "option", "legend", "summary", "html", "body", "head"}

# Tags, roles and words of classes and ids that tell boilerplate or content.
BAD_TAGS = frozenset("nav footer aside form menu dialog button select option search fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: A name made of these, and of helpers, is that of boilerplate.
SURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "toolbar comment comments commentlist disqus replies respond sharing social recommended recommendations trending newsletter "
    "subscribe subscription signup login widget widgets pagination pager copyright disclaimer".split()
)
#: These may as well be about the matter of the text.
HINT_WORDS = frozenset("aside side foot search skip reply discussion share related form legal tags".split())
HELPER_WORDS = frozenset(
    "list box wrap wrapper bar block blocks section container area links link buttons button item items inner outer top bottom "
    "left right content text group row col column panel zone unit slot site page post posts article articles user reader readers "
    "latest more main header title body primary secondary".split()
)
GOOD_WORDS = frozenset("article content post entry story main body text prose".split())
NEUTRAL_WORDS = frozenset("has with no without is".split())

#: The costs of a block differ by at most this; so neighbours can overrule any classifier's verdict, if all agree.
MOST_COST = 5.0
ADJACENT = 0.5
TREE = 1.6
#: What is left of an edge between blocks that tags, roles or names tell apart.
CONTRAST = 0.1

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    tag: str
    parent: Element | None
    bad: bool = False
    header: int = 0  # 1 outside an article, 2 inside one
    article: bool = False
    good: bool = False
    hidden: bool = False
    named: int = 0  # how surely names tell boilerplate: 0 not at all, 1 by a word among others, 2 by a hint, 3 surely


@dataclass
class Block:
    element: Element
    text: str
    link_share: float = 0.0
    pieces: list[str] = field(default_factory=list, repr=False)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for m in _ATTRIBUTE.finditer(raw):
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


@lru_cache(4096)
def _told(name: str) -> int:
    """How surely one name of a class or an id tells boilerplate."""
    words = {w.lower() for w in _NAME_PART.findall(name)}
    words = {w for w in words if not w.isdigit()}
    if words & NEUTRAL_WORDS or not words & (SURE_WORDS | HINT_WORDS):
        return 0
    if words - SURE_WORDS - HINT_WORDS - HELPER_WORDS:
        return 1
    return 3 if words & SURE_WORDS else 2


def _element(tag: str, raw: str, parent: Element) -> Element:
    e = Element(tag, parent, parent.bad, parent.header, parent.article, parent.good, parent.hidden, parent.named)
    a = _attributes(raw)
    names = (a.get("class", "") + " " + a.get("id", "")).split() if tag not in ("html", "body") else []
    role = a.get("role", "").lower()
    if tag == "header" or role == "banner":
        e.header = max(e.header, 2 if parent.article else 1)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        e.hidden = True
    if tag in BAD_TAGS or (role in BAD_ROLES and role != "banner"):
        e.bad = True
    if tag in ("article", "main") or role in ("article", "main"):
        e.article = True
        return e
    words = {w.lower() for name in names for w in _NAME_PART.findall(name)}
    told = max(map(_told, names), default=0)
    if told == 0 and "header" in words and not words & NEUTRAL_WORDS and not parent.article:
        e.header = max(e.header, 1)
    elif told == 0 and words & GOOD_WORDS and not words & NEUTRAL_WORDS:
        e.good = True
    e.named = max(e.named, told)
    return e


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with character references decoded and white space as one space.

    Scripts, styles, comments, hidden elements and other raw content have no text.  Tags that are never closed, or
    closed without being open, are repaired the way browsers do for the common cases.
    """
    root = Element("#root", None)
    stack, found = [root], []
    open_: Counter[str] = Counter()
    last_end = page.rfind(">")  # no tag ends behind it
    pieces: list[str] = []
    linked = total = links = 0
    never_closed: set[str] = set()
    owner = root

    def flush():
        nonlocal linked, total
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and not owner.hidden:
                found.append(Block(owner, text, linked / total if total else 0.0))
            pieces.clear()
        linked = total = 0

    def close(upto: int):
        nonlocal owner
        flush()
        for e in stack[upto:]:
            open_[e.tag] -= 1
        del stack[upto:]
        owner = stack[-1]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = page[at:lt]
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            total += len(text)
            if links:
                linked += len(text)
            at = lt
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = (_TAG.match(page, at) or _LOOSE_TAG.match(page, at)) if at < last_end else None
        if not m:
            pieces.append("<")
            total += 1
            at += 1
            continue
        at = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                pieces.append(" ")
            elif tag in BLOCK:
                if open_[tag]:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
                else:
                    flush()
            continue
        if (tag in RAW or tag in UNSEEN and tag not in never_closed) and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at, last_end + 1)
            if end or tag in RAW:
                at = end.end() if end else n
                continue
            never_closed.add(tag)
        if tag == "a":
            links = 1  # links do not nest
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK:
            flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P and stack[-1].tag == "p":
                close(len(stack) - 1)
            if tag in ENDS:
                ended, scope = ENDS[tag]
                cut_at, many = None, sum(open_[t] for t in ended)
                for k in range(len(stack) - 1, 0, -1):
                    if not many:
                        break
                    if stack[k].tag in ended:
                        cut_at, many = k, many - 1
                    elif stack[k].tag in scope:
                        break
                if cut_at is not None:
                    close(cut_at)
            owner = _element(tag, m[3], stack[-1])
            stack.append(owner)
            open_[tag] += 1
            if tag in ("article", "main", "nav", "footer", "header", "aside", "section", "body"):
                links = 0
    flush()
    return found


def scores(found: list[Block], weights: tuple[float, ...] | None = None) -> np.ndarray:
    """The classifier: the log odds of content, within ``MOST_COST``."""
    w = np.array(weights or html_model.weights())
    return np.clip(html_model.features(found) @ w, -MOST_COST, MOST_COST)


def _steps(a: Element, b: Element) -> int:
    """Steps between two elements through the tree, 4 at most."""
    up = {id(a): 0}
    for k in (1, 2, 3):
        if a.parent is None:
            break
        a = a.parent
        up[id(a)] = k
    for k in range(4):
        if id(b) in up:
            return min(4, k + up[id(b)])
        if b.parent is None:
            break
        b = b.parent
    return 4


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbours in page order, and to the block before under the same element.

    Capacities fall with the distance in the tree, and where the markup around the two ends tells them apart.
    """
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    kind = [(b.element.bad, b.element.named > 1, b.element.header, b.element.article) for b in found]

    def add(i: int, j: int, capacity: float):
        edges[i, j] = edges.get((i, j), 0.0) + capacity * (1.0 if kind[i] == kind[j] else CONTRAST)

    for i, b in enumerate(found):
        if i:
            add(i - 1, i, ADJACENT * 2 / max(2, _steps(found[i - 1].element, b.element)))
        parent = b.element.parent if b.element.parent is not None else b.element
        # Siblings are two steps apart, cousins four.
        for distance, e in ((2, parent), (4, parent.parent)):
            if e is not None:
                j = last.get(id(e))
                if j is not None and j != i:
                    add(j, i, TREE * 2 / distance)
                last[id(e)] = i
    return edges


def minimum_cut(content: np.ndarray, boilerplate: np.ndarray, edges: dict[tuple[int, int], float]) -> np.ndarray:
    """True for the nodes on the content side of the minimum cut.

    content[i] is cut when i is labelled boilerplate, boilerplate[i] when it is labelled content, and an edge when its
    ends differ.  Nodes whose own preference outweighs all their edges are labelled at once, which changes no minimum
    cut; maximum flow settles the rest.
    """
    n = len(content)
    need = (content - boilerplate).astype(float)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    label = np.zeros(n, np.int8)
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] == 0 and abs(need[i]) > sum(near[i].values()):
            label[i] = 1 if need[i] > 0 else -1
            for j, c in near[i].items():
                del near[j][i]
                need[j] += c * label[i]
                queue.append(j)
            near[i] = {}
    rest = np.flatnonzero(label == 0)
    if len(rest):
        place = {int(i): k for k, i in enumerate(rest)}
        side = _max_flow(len(rest), [max(0.0, need[i]) for i in rest], [max(0.0, -need[i]) for i in rest], [(place[int(i)], place[j], c) for i in rest for j, c in near[i].items() if i < j])
        label[rest] = np.where(side, 1, -1)
    return label > 0


def _max_flow(n: int, source: list[float], sink: list[float], links: list[tuple[int, int, float]]) -> np.ndarray:
    """Dinic's algorithm; True for nodes that the source still reaches."""
    s, t, tiny = n, n + 1, 1e-12
    head, to, cap = [[] for _ in range(n + 2)], [], []

    def add(a: int, b: int, forth: float, back: float):
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        if source[i]:
            add(s, i, source[i], 0.0)
        if sink[i]:
            add(i, t, sink[i], 0.0)
    for a, b, c in links:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([level[i] >= 0 for i in range(n)], bool)
        turn, path, a = [0] * (n + 2), [], s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                keep = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(head[a]):
                path.append(head[a][turn[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                level[a] = -2  # a dead end in this phase
                a = to[path.pop() ^ 1]


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The content blocks of a page, joined by line feeds; empty for null or where there is none."""
    found = blocks(page or "")
    if not found:
        return ""
    z = scores(found, weights)
    content = np.logaddexp(0, z)
    keep = minimum_cut(content, content - z, smoothness(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def _extract(batches, weights: tuple[float, ...]):
    for batch in batches:
        texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; one pass without a shuffle.

    A null or empty page, or one without content, has an empty text.  Repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(partial(_extract, weights=html_model.weights()), "page_id long, url string, text string, n_chars long")
