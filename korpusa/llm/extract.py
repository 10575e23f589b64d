"""Main-text extraction by wrapper induction.

All different pages of each host (pages with different main texts; of equal ones one) are parsed and their
trees aligned with one reference page by simple tree matching: the largest ordered, label-preserving mapping
between two trees, by dynamic programming over child lists. Nodes whose text is the same on nearly all aligned
pages are the host's template. From the
root, the containers that hold most of the varying text on nearly all pages lead to the content slot.

A page's text is what it has at the host's slot, less template nodes and less chrome by kind (navigation,
headers, footers, asides, forms, scripts, adverts, notices, comments; by tag, role or class). Among
equally labelled nodes on the way the one with the most text is followed. Tags decide in two cases only:
articles (or a main element) that hold most of the slot's text narrow it, all of them in page order; and
a host with too few pages for a template, or a page without the slot, is read by its articles, else its
main element, else its body. A header inside an article belongs to it, and a form that holds most of the
page's text is no chrome.

Nodes with the same place and text on nearly all pages, counted exactly, are constant and go before matching; all
others take part in it. A mapping of two child lists costs the product of their lengths by nature, less what is
the same: equal subtrees map onto themselves, equal shapes are worked out once, children equal from the front are
paired at once. Memory stays in proportion to the two trees.

No host's pages are gathered anywhere: each step (constant nodes, places, reference, matches, ways to the slot)
is a sum or a minimum over all pages of a host, with partial sums where the pages are. Pages travel between
steps as their element trees. What a step tells of a host is joined to its pages: broadcast while its measured
total is under MOST_SHIPPED bytes, else by split_join.

Defined results: null html counts as empty and gives an empty text; null url belongs to the empty
host; every row keeps its own output row, repeated rows too; ties between nodes go to the first in page
order; parsing is linear in the page, however long, deep or broken; character references are decoded,
white space inside a block becomes one space, blocks are joined by one newline and nothing else is
dropped or capped; unclosed tags are closed as browsers do; an empty table gives an empty result; of the
input only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, passing, sliced, split_join, stored, table
from .urls import split_url

SHARE, LEAST_PAGES, MOST_SHIPPED = 0.8, 4, 16 << 20
#: Sums that a task holds before it hands them on.
MOST_HELD = 100_000
#: Nodes that places() tells of; no step of the induction calls it.
MOST_NODES = 400
#: Numbers of shapes and sizes of mappings that a worker keeps; more are worked out again.
MOST_KEPT = 100_000
#: From this width on a row of an alignment is an array; and the cells of an alignment's table that are held at once.
WIDE, MOST_CELLS = 64, 1 << 20
#: Characters of templates' parts, by kind, whose decoded form a worker keeps.
MOST_CACHED = 4 << 20
TOPS = ("#root", "html", "body")
#: Share of a node's varying text that its child must hold for the slot to lead into it.
LEADING = 0.7
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend option optgroup tbody td tfoot th thead tr dd dt li".split()) | {"p"}
#: Opening one of these closes an open one of those, up to the barrier.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
CHROME = frozenset(
    "aside audio button canvas datalist dialog embed footer form head header iframe input link map menu meta nav noembed noframes noscript object "
    "script select style svg template textarea title video xmp".split()
)
ROLES = frozenset("banner navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that mark chrome wherever they stand.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsbygoogle sponsor sponsored promo promotion banner sidebar sidebars navbar nav navigation "
    "menu menus breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notification comment comments commentlist disqus recommended "
    "newsletter subscribe subscription signup popup modal overlay pagination pager".split()
)
#: Words that mark chrome when nothing but filler stands beside them: share-buttons, but not market-share.
WEAK = frozenset("header notice notices discussion respond replies share sharing social related widget widgets toolbar skip login".split())
FILLER = frozenset(
    "area articles bar block bottom box button buttons container content form icons inner items left legal link links list main media outer page pages "
    "posts right section site stories to top wrap wrapper".split()
)
#: Elements that the way to the content slot may lead through.
CONTAINERS = frozenset("html body main article section div form center table tbody tr td".split())
ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
BARE = re.compile(r"(?<![\w-])hidden(?![\w=-])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(>?)")
STOP = re.compile(r">|=\s*+([\"'])")


class Node:
    __slots__ = ("children", "digest", "label", "marks", "noise", "own", "size", "tag")

    def __init__(self, tag: str, label: str = "", noise: bool = False):
        self.tag, self.label, self.noise, self.children = tag, label or tag, noise, []
        self.size, self.own, self.digest = 0, 0, 0  # characters below, those outside noise, and their hash: see measure()
        self.marks = None  # the children's places where they are known: see child_paths()


def marks_chrome(name: str) -> bool:
    """Whether one class or id name marks chrome."""
    parts = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
    return any(w in NOISE for w in parts) or (any(w in WEAK for w in parts) and all(w in WEAK or w in FILLER for w in parts))


@lru_cache(4096)
def open_tag(tag: str, rest: str) -> tuple[str, bool]:
    """Label and noise of an element from its tag and attributes."""
    if not rest or rest.isspace():
        return tag, tag in CHROME
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    words = {w for n in names for w in re.split(r"[^a-z0-9]+", n)}
    label = tag + "".join(sorted(f".{w}" for w in words if w and not w.isdigit()))
    noise = tag in CHROME or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    noise = noise or (tag not in ("html", "body", "main") and any(map(marks_chrome, names)))
    if not noise and "hidden" in rest:
        noise = BARE.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", rest)) is not None
    return label, noise


def open_node(tag: str, rest: str) -> Node:
    if len(rest) > 2048:
        return Node(tag, *open_tag.__wrapped__(tag, rest))
    return Node(tag, *open_tag(tag, rest))


class Stack(list):
    """Open elements, with the places of each tag among them."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self))
        self.append(node)

    def cut(self, place: int) -> None:
        while len(self) > place:
            self.at[self.pop().tag].pop()

    def last(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags: set[str], barrier: set[str]) -> None:
        """Closes the innermost of these tags, and those directly around it, if no barrier is further in."""
        place = self.last(tags)
        if place and place > self.last(barrier):
            while place > 1 and self[place - 1].tag in tags:
                place -= 1
            self.cut(place)


def parse(text: str) -> Node:
    """The element tree; text is kept as strings among the children."""
    root = Node("#root")
    stack, at, n = Stack(root), 0, len(text)
    for start, end, closing, tag, rest in iter_markup(text):
        if start > at:
            stack[-1].children.append(text[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            if stack.at.get(tag):
                stack.cut(stack.at[tag][-1])
            continue
        if tag in CLOSES_P:
            stack.close(P, P_BARRIER)
        if tag in CLOSES:
            stack.close(*CLOSES[tag])
        node = open_node(tag, rest)
        stack[-1].children.append(node)
        if tag not in VOID and not (rest.endswith("/") and tag == "svg"):
            stack.push(node)
    if at < n:
        stack[-1].children.append(text[at:])
    return root


P, P_BARRIER = {"p"}, {"td", "th", "button", "table", "object"}


def iter_markup(text: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, whether closing, tag or None, attributes) of all markup, in one pass; a quote counts after ``=`` only."""
    at, n = 0, len(text)
    while (start := text.find("<", at)) >= 0:
        if name := TAG.match(text, start):
            closing, tag, at = name[1] == "/", name[2].lower(), name.end()
            if name[3]:
                yield start, at, closing, tag, ""
            else:
                place = at
                while True:
                    m = STOP.search(text, place)
                    if m is None:  # the page ends inside a tag
                        yield start, n, False, None, ""
                        return
                    if m[1] is None:
                        break
                    end = text.find(m[1], m.end())
                    place = end + 1 if end >= 0 else m.end()
                rest, at = text[at : m.start()], m.end()
                yield start, at, closing, tag, rest
            if tag in RAW and not closing:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
                at = stop.start() if stop else n
                yield at, at, False, None, ""
            continue
        after = text[start + 1 : start + 2]
        if after == "!" and text.startswith("<!--", start):
            ends = [(e, k) for e, k in ((text.find("-->", start + 4), 3), (text.find("--!>", start + 4), 4)) if e >= 0]
            at = min(e + k for e, k in ends) if ends else n
            yield start, at, False, None, ""
            continue
        if after in ("!", "?"):
            end = text.find(">", start)
            at = end + 1 if end >= 0 else n
            yield start, at, False, None, ""
            continue
        if after == "/" and (end := text.find(">", start)) >= 0:
            at = end + 1
            yield start, at, False, None, ""
        else:
            at = start + 1  # a plain <; it stays text


def measure(root: Node, digests: bool = False) -> Node:
    """Sets size, own and (on request) digest of every node, and settles the noise of headers and forms."""
    order: list[tuple[Node, bool]] = []
    work = [(root, False)]
    while work:
        x, inside = work.pop()
        order.append((x, inside))
        inside = inside or x.tag in ("article", "main")
        work.extend((c, inside) for c in reversed(x.children) if isinstance(c, Node))
    for x, _ in reversed(order):
        size, text, digest = 0, 0, 0
        for c in x.children:
            if isinstance(c, Node):
                if c.tag not in RAW:
                    size += c.size
                    if digests and c.digest:
                        digest = stable(f"{digest}+{c.digest}")
            elif long := len(c.strip()):
                text += long
                if digests and (piece := clean(c)):
                    digest = stable(f"{digest}+{stable(piece)}")
        x.size, x.own, x.digest = size + text, text, digest
    for x, inside in order:
        if x.noise and x.label == x.tag and ((x.tag == "header" and inside) or (x.tag == "form" and 2 * x.size > root.size)):
            x.noise = False
        elif x.noise and x.tag == "form" and 2 * x.size > root.size:
            x.noise = any(marks_chrome(w) for w in x.label.split(".")[1:])
    for x, _ in reversed(order):
        x.own = 0 if x.noise or x.tag in RAW else x.own + sum([c.own for c in x.children if isinstance(c, Node)])
    return root


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def blocks(node: Node, drop: frozenset[int] = frozenset(), path: int = 0) -> list[str]:
    """Texts of the blocks below a node in page order, without chrome and dropped places."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if text := clean("".join(run)):
                out.append(text)
            run.clear()

    places = bool(drop)
    work: list[tuple[str, object, int]] = [("in", node, path)]
    while work:
        what, x, p = work.pop()
        if what == "flush":
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            if x.tag == "br":
                run.append(" ")
                continue
            if x is not node and (x.noise or (places and key_of(x, p) in drop)):
                if x.tag in BLOCK or x.tag in CHROME:
                    flush()
                continue
            block = x.tag in BLOCK
            if block:
                flush()
                work.append(("flush", None, 0))
            kids = x.children
            if places:
                marks = child_paths(x, p)
                work.extend(("in", c, q) for c, q in zip(reversed(kids), reversed(marks), strict=True))
            else:
                work.extend(("in", c, 0) for c in reversed(kids))
    flush()
    return out


def child_paths(x: Node, p: int) -> list[int]:
    """A number for the place of each child: by label and rank among its kind; texts have none (0)."""
    if x.marks is not None:
        return x.marks
    seen: dict[str, int] = {}
    out = []
    for c in x.children:
        if isinstance(c, Node):
            k = seen[c.label] = seen.get(c.label, -1) + 1
            out.append(stable(f"{p}/{c.label}[{k}]"))
        else:
            out.append(0)
    return out


def stable(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def key_of(x: Node, p: int) -> int:
    """What a template names a constant node by: its place and its whole text."""
    return stable(f"{p}={x.digest}")


# --- induction -----------------------------------------------------------------------------------------


def keys_of(tree: str) -> set[int]:
    """Keys of all nodes with text below the root of a written tree that may be template."""
    _, paths, tags, _, _, digests, _ = json.loads(tree)
    return {stable(f"{p}={d}") for p, tag, d in zip(paths, tags, digests, strict=True) if d and tag not in TOPS}


def trimmed(root: Node, constant: set[int] | frozenset[int] = frozenset()) -> Matched:
    """A copy with all elements, but without constant ones and what is below them; each with its place."""
    top = Matched(root, 0)
    queue = deque([top])
    while queue:
        m = queue.popleft()
        for c, p in zip(m.node.children, child_paths(m.node, m.path), strict=True):
            if isinstance(c, Node) and c.tag not in RAW and not (c.digest and constant and key_of(c, p) in constant):
                kid = Matched(c, p)
                m.kids.append(kid)
                queue.append(kid)
    return top


def spots_of(tree: str, constant: set[int] | frozenset[int] = frozenset()) -> list[int]:
    """The places of the nodes that trimmed() leaves of a written tree, nearest the root first."""
    parents, paths, _, _, _, digests, _ = json.loads(tree)
    kept = [True]
    for parent, p, d in zip(parents[1:], paths[1:], digests[1:], strict=True):
        kept.append(kept[parent] and not (d and constant and stable(f"{p}={d}") in constant))
    return [p for p, k in zip(paths, kept, strict=True) if k]


def places(tree: str, constant: set[int] | frozenset[int] = frozenset()) -> set[int]:
    """The first MOST_NODES of spots_of(): a look at the top of a tree."""
    return set(spots_of(tree, constant)[:MOST_NODES])


class Matched:
    """A node in matching, with its children that take part and the number of its shape: see Shapes."""

    __slots__ = ("kids", "node", "number", "path", "shape")

    def __init__(self, node: Node, path: int):
        self.node, self.path, self.kids, self.shape, self.number = node, path, [], -1, -1


def breadth_first(top: Matched) -> list[Matched]:
    nodes = [top]
    for m in nodes:  # the list grows meanwhile
        nodes += m.kids
    return nodes


class Shapes:
    """Simple tree matching by shape: a node's label and its children's shapes, in order, have a number.

    The largest mapping that keeps order, labels and parents depends on shapes only. Two equal ones map onto each
    other as they are. Of two lists of children those equal from the front pair up (no mapping gains by another
    partner for them), those of a label that the other list lacks go; the rest is aligned row by row. Nothing
    recurses, however deep the trees are, and what is kept of sizes and pairs may go at any time.
    """

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, tuple[int, ...]], int] = {}
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.nodes: list[int] = []
        self.held = 0
        self.sizes: dict[tuple[int, int], int] = {}
        self.paired: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def number(self, nodes: list[Matched]) -> None:
        """Numbers the shapes of all nodes of a tree, given breadth first."""
        for m in reversed(nodes):
            kids = tuple([k.shape for k in m.kids])
            key = (m.node.label, kids)
            at = self.numbers.get(key)
            if at is None:
                at = self.numbers[key] = len(self.labels)
                self.labels.append(m.node.label)
                self.kids.append(kids)
                self.nodes.append(1 + sum([self.nodes[k] for k in kids]))
                self.held += 1 + len(kids)
            m.shape = at

    def known(self, s: int, t: int) -> int:
        """The size of the largest mapping of two shapes, -1 if it has yet to be worked out."""
        if s == t:
            return self.nodes[s]
        if self.labels[s] != self.labels[t]:
            return 0
        return self.sizes.get((s, t), -1) if self.kids[s] and self.kids[t] else 1

    def size(self, s: int, t: int) -> int:
        found = self.known(s, t)
        work = [] if found >= 0 else [((s, t), self._size(s, t))]
        while work:
            pair, steps = work[-1]
            try:
                asked = steps.send(None if found < 0 else found)
            except StopIteration as done:
                found = done.value
                if len(self.sizes) >= MOST_KEPT:
                    self.sizes.clear()
                self.sizes[pair] = found
                work.pop()
            else:
                work.append((asked, self._size(*asked)))
                found = -1
        return found

    def _size(self, s: int, t: int) -> Iterator[tuple[int, int]]:
        """Asks for the sizes that it needs of children, one at a time, and returns that of the parents."""
        front, rest, across = self._unlike(s, t)
        row, rows = start_row(len(across)), {}
        for i in rest:
            x = self.kids[s][i]
            if x not in rows:
                if len(rows) * len(across) > MOST_CELLS:
                    rows.clear()
                sizes = {}
                for j in across:
                    y = self.kids[t][j]
                    if y not in sizes:
                        found = self.known(x, y)
                        sizes[y] = (yield x, y) if found < 0 else found
                rows[x] = as_row([sizes[self.kids[t][j]] for j in across])
            row = next_row(row, rows[x])
        return 1 + sum([self.nodes[x] for x in self.kids[s][:front]]) + int(row[-1])

    def _unlike(self, s: int, t: int) -> tuple[int, list[int], list[int]]:
        """How many children are equal from the front, and which others there are on both sides, of labels that both have."""
        a, b, front = self.kids[s], self.kids[t], 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            front += 1
        both = {self.labels[x] for x in a[front:]} & {self.labels[y] for y in b[front:]}
        return front, [i for i in range(front, len(a)) if self.labels[a[i]] in both], [j for j in range(front, len(b)) if self.labels[b[j]] in both]

    def pairs(self, s: int, t: int) -> list[tuple[int, int]]:
        """Which children the largest mapping of two shapes pairs, by their numbers; of equal ones the first."""
        found = self.paired.get((s, t))
        if found is not None:
            return found
        front, rest, across = self._unlike(s, t)
        found = [(i, i) for i in range(front)]
        if len(rest) == len(across) == 1:  # nothing to choose, as in a chain of nodes
            return [*found, (rest[0], across[0])]
        columns, held = [self.kids[t][j] for j in across], {}

        def sizes(i: int, width: int) -> list[int] | np.ndarray:
            x = self.kids[s][i]
            if x not in held:
                if len(held) * len(columns) > MOST_CELLS:
                    held.clear()
                each = {y: self.size(x, y) for y in dict.fromkeys(columns)}
                held[x] = as_row([each[y] for y in columns])
            return held[x][:width]

        def back(row: list[int], low: int, high: int, width: int) -> int:
            """Walks from row ``high`` up to ``low``, whose cells are ``row``; gives the column it arrives at."""
            if (high - low) * width > MOST_CELLS and high - low > 1:  # the lower half first, from the row between
                mid, at = (low + high) // 2, row
                for i in rest[low:mid]:
                    at = next_row(at, sizes(i, width))
                width = back(at, mid, high, width)
                return back(row[: width + 1], low, mid, width)
            table = [row]
            for i in rest[low:high]:
                table.append(next_row(table[-1], sizes(i, width)))
            at = high - low
            while at and width:
                if table[at][width] == table[at - 1][width]:
                    at -= 1
                elif table[at][width] == table[at][width - 1]:
                    width -= 1
                else:
                    at, width = at - 1, width - 1
                    found.append((rest[low + at], across[width]))
            return width

        if rest:
            back(start_row(len(across)), 0, len(rest), len(across))
        if self.held + len(found) <= MOST_KEPT:
            self.paired[s, t] = found
            self.held += 1 + len(found)
        return found


def start_row(width: int) -> list[int] | np.ndarray:
    return [0] * (width + 1) if width < WIDE else np.zeros(width + 1, np.int64)


def as_row(sizes: list[int]) -> list[int] | np.ndarray:
    return sizes if len(sizes) < WIDE else np.array(sizes, np.int64)


def next_row(row: list[int] | np.ndarray, sizes: list[int] | np.ndarray) -> list[int] | np.ndarray:
    """The row of an alignment's table below ``row``, from the sizes of the mappings of its node."""
    if isinstance(row, np.ndarray):
        new = np.maximum(row[1:], row[:-1] + sizes)
        return np.concatenate([row[:1], np.maximum.accumulate(new)])
    out, last = [0], 0
    for j, size in enumerate(sizes):
        if row[j + 1] > last:
            last = row[j + 1]
        if row[j] + size > last:
            last = row[j] + size
        out.append(last)
    return out


def simple_tree_match(a: Matched, b: Matched, memo: dict) -> int:
    """Size of the largest mapping that keeps order, labels and parents; ``memo`` keeps the numbers of shapes."""
    shapes = memo.setdefault("shapes", Shapes())
    shapes.number(breadth_first(a))
    shapes.number(breadth_first(b))
    return shapes.size(a.shape, b.shape)


def aligned(a: Matched, b: Matched, shapes: Shapes) -> Iterator[tuple[Matched, Matched]]:
    """The pairs of nodes of the best mapping of two trees with numbered shapes."""
    work = [(a, b)] if a.node.label == b.node.label else []
    while work:
        x, y = work.pop()
        yield x, y
        if x.shape == y.shape:
            work += zip(x.kids, y.kids, strict=True)
        elif x.kids and y.kids:
            work += [(x.kids[i], y.kids[j]) for i, j in shapes.pairs(x.shape, y.shape)]


def flat(root: Node) -> str:
    """A measured tree's elements, raw ones left out, as JSON: breadth first, each with its parent's number and its place."""
    nodes, parents, paths = [root], [-1], [0]
    for at, x in enumerate(nodes):  # the list grows meanwhile
        for c, p in zip(x.children, child_paths(x, paths[at]), strict=True):
            if isinstance(c, Node) and c.tag not in RAW:
                nodes.append(c)
                parents.append(at)
                paths.append(p)
    return json.dumps([parents, paths, *([getattr(x, name) for x in nodes] for name in FIELDS)], separators=(",", ":"))


FIELDS = ("tag", "label", "noise", "digest", "own")


def grown(tree: str) -> Node:
    """The elements that flat() wrote."""
    nodes: list[Node] = []
    for parent, path, tag, label, noise, digest, own in zip(*json.loads(tree), strict=True):
        x = Node(tag, label, noise)
        x.digest, x.own, x.marks = digest, own, []
        if nodes:
            above = nodes[parent]
            above.children.append(x)
            above.marks.append(path)
        nodes.append(x)
    return nodes[0]


def facts(page: str) -> tuple[str, str, str]:
    """Hashes of a page's main text and of its whole text, and its tree.

    Pages of equal main text count once, the one with the smallest hash and tree: copies of one article must
    not make it look like template.
    """
    tree = measure(parse(page), digests=True)
    text = stable("\n".join(t for x in content(tree, ()) for t in blocks(x)))
    return f"{text:016x}", f"{tree.digest:016x}", flat(tree)


def standing(found: list[int], shared: dict[int, int]) -> float:
    """On how many other pages a page's nodes stand, by place, on average."""
    return sum(shared.get(p, 1) - 1 for p in found) / len(found)


class Reference:
    """A host's reference page in matching: its nodes breadth first, the numbers of each node's children and of the node above."""

    #: Shapes of a worker's pages, begun anew when they are many.
    shapes = Shapes()

    def __init__(self, tree: str, fixed: set[int] | frozenset[int]):
        self.nodes, self.kids, self.above = breadth_first(trimmed(grown(tree), fixed)), [], [-1]
        for i, m in enumerate(self.nodes):
            m.number = i
            self.kids.append(range(len(self.above), len(self.above) + len(m.kids)))
            self.above += [i] * len(m.kids)
        self.numbered = None

    def aligned(self, other: Matched) -> list[tuple[int, int, int]]:
        """Of the nodes that have a partner on another page: number, size of the partner's text, and whether the text is the same."""
        if Reference.shapes.held > MOST_KEPT:
            Reference.shapes = Shapes()
        shapes = Reference.shapes
        if self.numbered is not shapes:
            shapes.number(self.nodes)
            self.numbered = shapes
        shapes.number(breadth_first(other))
        return sorted((x.number, y.node.own, int(x.node.digest == y.node.digest)) for x, y in aligned(self.nodes[0], other, shapes))

    def constant(self, i: int, counts: dict[int, list[int]], others: int) -> bool:
        """Whether a node is the same wherever matched, on nearly all pages; counts: pages matched, with equal text, and size of text by node."""
        n, same, _ = counts.get(i, NEVER)
        return n >= SHARE * others and same == n > 0

    def leading(self, found: list[tuple[int, int]], counts: dict[int, list[int]], others: int) -> Iterator[int]:
        """Nodes that on this page hold most of the varying text of the node above; -1 - i for all varying ones below i, which hold none."""
        below: dict[int, list[tuple[int, int]]] = {}
        for i, mass in found:
            if self.above[i] >= 0 and not self.constant(i, counts, others):
                below.setdefault(self.above[i], []).append((i, mass))
        for i, _ in found:
            held = sum(mass for _, mass in below.get(i, ()))
            if held:
                yield from (k for k, mass in below[i] if mass >= LEADING * held)
            elif self.kids[i]:
                yield -1 - i

    def template(self, counts: dict[int, list[int]], leads: dict[int, int], others: int, always: set[int] | frozenset[int]) -> dict:
        """Keys of constant nodes, and labels on the way to the content slot."""
        nodes, constant, work = self.nodes, set(always), [0]
        while work:
            i = work.pop()
            if nodes[i].node.digest and nodes[i].node.tag not in TOPS and self.constant(i, counts, others):
                constant.add(key_of(nodes[i].node, nodes[i].path))
            else:
                work.extend(self.kids[i])
        slot, at = [], 0
        while self.kids[at]:
            enough, all_lead = SHARE * counts.get(at, NEVER)[0], leads.get(-1 - at, 0)
            ways = [k for k in self.kids[at] if nodes[k].node.tag in CONTAINERS and not nodes[k].node.noise and not self.constant(k, counts, others) and counts.get(k, NEVER)[0] >= SHARE * others]
            ways = [k for k in ways if leads.get(k, 0) + all_lead >= enough]
            if not ways:
                break
            at = max(ways, key=lambda k: counts.get(k, NEVER)[2])
            slot.append(nodes[at].node.label)
        return {"constant": sorted(constant), "slot": slot}


NEVER = [0, 0, 0]


def induce(pages: list[str]) -> dict:
    """Template of one host from all its pages, in one process: the steps of templates().

    The order of the pages doesn't matter. Nodes with equal place and text on nearly all different pages are
    constant and go first, so that a long menu takes no part in matching. The others are aligned with those of
    the reference: the page whose nodes stand, by place, on most other pages (ties: by hash of its text).
    """
    found: dict[str, list[str]] = {}
    for text, *rest in map(facts, pages):
        found[text] = min(rest, found.get(text, rest))
    trees = [found[text][1] for text in sorted(found)]
    if len(trees) < LEAST_PAGES:
        return {"constant": [], "slot": []}
    seen = Counter(k for x in trees for k in keys_of(x))
    fixed = {k for k, n in seen.items() if n >= max(LEAST_PAGES, SHARE * len(trees))}
    spots = [spots_of(x, fixed) for x in trees]
    shared = Counter(p for x in spots for p in x)
    first = max(range(len(trees)), key=lambda i: standing(spots[i], shared))
    reference, others, counts = Reference(trees[first], fixed), len(trees) - 1, {}
    matched = [reference.aligned(trimmed(grown(x), fixed)) for i, x in enumerate(trees) if i != first]
    for i, mass, same in (x for found in matched for x in found):
        n, equal, held = counts.get(i, NEVER)
        counts[i] = [n + 1, equal + same, held + mass]
    leads = Counter(k for found in matched for k in reference.leading([x[:2] for x in found], counts, others))
    return reference.template(counts, leads, others, fixed)


def at_slot(root: Node, slot: tuple[str, ...]) -> Node | None:
    """The node at the end of these labels; among equally labelled children the one with the most text is followed."""
    at = root
    for label in slot:
        found = [c for c in at.children if isinstance(c, Node) and c.label == label and not c.noise]
        if not found:
            return None
        at = max(found, key=lambda c: c.own)
    return at if slot else None


def outermost(top: Node, tag: str) -> list[Node]:
    """Outermost elements of a tag below (or at) a node, noise left out, in page order."""
    out, work = [], [top]
    while work:
        x = work.pop()
        if x.noise and x is not top:
            continue
        if x.tag == tag:
            out.append(x)
        else:
            work.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def content(root: Node, slot: tuple[str, ...]) -> list[Node]:
    """The nodes whose blocks are the page's text, in page order."""
    top = at_slot(root, slot)
    least = 0 if top is None else top.own / 2
    top = top or next(iter(outermost(root, "body")), root)
    for tag in ("article", "main"):
        found = [x for x in outermost(top, tag) if x.own]
        if found and sum(x.own for x in found) > least:
            return found
    return [top]


@lru_cache(4096)
def read_template(text: str | None) -> tuple[frozenset[int], tuple[str, ...]]:
    t = json.loads(text) if text else {"constant": [], "slot": []}
    return frozenset(t["constant"]), tuple(t["slot"])


def places_of(root: Node, nodes: list[Node]) -> list[int]:
    """Place numbers of some nodes, as child_paths gives them; none stands below noise."""
    wanted, found, work = {id(x) for x in nodes}, {}, [(root, 0)]
    while work and len(found) < len(wanted):
        x, p = work.pop()
        if id(x) in wanted:
            found[id(x)] = p
        work.extend((c, q) for c, q in zip(x.children, child_paths(x, p), strict=True) if isinstance(c, Node) and not c.noise)
    return [found[id(x)] for x in nodes]


def main_text(html: str | None, template: str | None = None) -> str:
    if not html:
        return ""
    constant, slot = read_template(template)
    root = measure(parse(html), digests=bool(constant))
    found = content(root, slot)
    places = places_of(root, found) if constant else [0] * len(found)
    return "\n".join(t for x, p in zip(found, places, strict=True) for t in blocks(x, constant, p))


# --- plans ---------------------------------------------------------------------------------------------


def beside(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``rows`` with what is told of their host; told has one durable row a host, rows of other hosts go."""
    size = told.agg(F.sum(sum((F.length(F.col(c).cast("string")) for c in told.columns), F.lit(0)))).first()[0] or 0
    return rows.join(F.broadcast(told), "host") if size <= MOST_SHIPPED else split_join(rows, told, ["host"])


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def cached(make: Callable) -> Callable:
    """Keeps results for texts of MOST_CACHED characters in all, those used last."""
    held: dict[tuple, object] = {}
    total = 0

    @wraps(make)
    def get(*texts: str | None) -> object:
        nonlocal total
        if texts in held:
            found = held.pop(texts)
        else:
            found = make(*texts)
            total += sum(len(t or "") for t in texts)
        held[texts] = found
        while total > MOST_CACHED and len(held) > 1:
            oldest = next(iter(held))
            del held[oldest]
            total -= sum(len(t or "") for t in oldest)
        return found

    return get


@cached
def key_set(text: str | None) -> frozenset[int]:
    return frozenset(k & (1 << 64) - 1 for k in json.loads(text or "[]"))


@cached
def number_table(text: str | None) -> dict[int, list[int]]:
    return {at: rest for at, *rest in json.loads(text or "[]")}


@cached
def place_table(text: str | None) -> dict[int, int]:
    return {at & (1 << 64) - 1: n for at, (n,) in number_table.__wrapped__(text).items()}


@cached
def reference_page(tree: str, fixed: str | None) -> Reference:
    return Reference(tree, key_set(fixed))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as to_pylist() gives them; lists of numbers become objects a list at a time, not a number at a time."""
    columns = [[x if x is None else x.tolist() for x in c.to_numpy(zero_copy_only=False)] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
    return (dict(zip(batch.schema.names, row, strict=True)) for row in zip(*columns, strict=True))


SUMS = "host string, at long, n long, same long, mass long"


def tallied(rows: DataFrame, tally: Callable[[dict], Iterator[tuple[int, int, int, int]]]) -> DataFrame:
    """``(host, at, n, same, mass)``: sums of what ``tally`` gives for each row, in parts of MOST_HELD first."""

    def packed(held: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
        columns = list(zip(*((*key, *sums) for key, sums in held.items()), strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], ["host", "at", "n", "same", "mass"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        for b in sliced(batches, 64):
            for row in rows_of(b):
                host = row["host"]
                for at, n, same, mass in tally(row):
                    sums = held.get((host, at))
                    if sums is None:
                        sums = held[host, at] = [0, 0, 0]
                    sums[0] += n
                    sums[1] += same
                    sums[2] += mass
                if len(held) > MOST_HELD:
                    yield packed(held)
                    held = {}
        yield packed(held)

    return rows.mapInArrow(run, SUMS).groupBy("host", "at").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("mass").alias("mass"))


def listed(*columns: str, where: str = "true") -> Column:
    """Sums of a host as JSON, in a fixed order."""
    return F.to_json(F.array_sort(F.collect_list(F.when(F.expr(where), F.array(*columns) if len(columns) > 1 else F.col(columns[0])))))


def templates(pages: DataFrame) -> DataFrame:
    """``(host, template)`` from all different pages of each host; pages has host and html. The result is durable."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = list(zip(*map(facts, b.column("html").to_pylist()), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("host"), *(pa.array(c, pa.string()) for c in found)], ["host", "text", "digest", "tree"])

    def keys(row: dict) -> Iterator[tuple[int, int, int, int]]:
        return ((signed(k), 1, 0, 0) for k in keys_of(row["tree"]))

    def spots(row: dict) -> Iterator[tuple[int, int, int, int]]:
        return ((signed(p), 1, 0, 0) for p in spots_of(row["tree"], key_set(row["fixed"])))

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = b.to_pylist()
            score = [standing(spots_of(r["tree"], key_set(r["fixed"])), place_table(r["shared"])) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("text"), pa.array(score, pa.float64())], ["host", "text", "score"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for b in sliced(batches):
            found = [reference_page(r["first"], r["fixed"]).aligned(trimmed(grown(r["tree"]), key_set(r["fixed"]))) for r in b.to_pylist()]
            told = [pa.array([[x[k] for x in page] for page in found], kind) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("host"), *told], ["host", "at", "masses", "same"])

    def sums(row: dict) -> Iterator[tuple[int, int, int, int]]:
        return ((i, 1, same, mass) for i, mass, same in zip(row["at"], row["masses"], row["same"], strict=True))

    def ways(row: dict) -> Iterator[tuple[int, int, int, int]]:
        page = reference_page(row["first"], row["fixed"])
        return ((k, 1, 0, 0) for k in page.leading(list(zip(row["at"], row["masses"], strict=True)), number_table(row["counts"]), row["c"] - 1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 16):
            made = []
            for r in b.to_pylist():
                leads = {at: n for at, (n,) in number_table(r["leads"]).items()}
                t = reference_page(r["first"], r["fixed"]).template(number_table(r["counts"]), leads, r["c"] - 1, key_set(r["fixed"])) if r["first"] else {"constant": [], "slot": []}
                made.append(json.dumps(t))
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(made, pa.string())], ["host", "template"])

    with passing(pages.sparkSession):
        read_all = pages.where("html is not null").select("host", "html").mapInArrow(read, "host string, text string, digest string, tree string")
        known = stored(read_all.groupBy("host", "text").agg(F.min(F.struct("digest", "tree")).alias("x")).select("host", "text", "x.tree"))
        hosts = durable(known.groupBy("host").agg(F.count("*").alias("c")))
        large = hosts.where(F.col("c") >= LEAST_PAGES)
        often = beside(tallied(beside(known, large), keys), large).where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= SHARE * F.col("c")))
        told = durable(large.join(often.groupBy("host").agg(listed("at").alias("fixed")), "host", "left"))
        marks = tallied(beside(known, told), spots).groupBy("host").agg(listed("at", "n", where="n > 1").alias("shared"))
        marks = durable(told.join(marks, "host"))
        stood = beside(known, marks.select("host", "fixed", "shared")).mapInArrow(stand, "host string, text string, score double")
        first = durable(stood.groupBy("host").agg(F.min_by("text", F.struct(-F.col("score"), "text")).alias("first_text")))
        trees = beside(known, first).where("text = first_text").select("host", "first_text", F.col("tree").alias("first"))
        told = durable(marks.drop("shared").join(trees, "host"))
        others = beside(known, told.select("host", "fixed", "first", "first_text")).where("text <> first_text").drop("text", "first_text")
        matched = stored(others.mapInArrow(match, "host string, at array<long>, masses array<long>, same array<long>"))
        counts = tallied(matched, sums).groupBy("host").agg(listed("at", "n", "same", "mass").alias("counts"))
        told = durable(told.join(counts, "host"))
        leads = tallied(beside(matched.select("host", "at", "masses"), told.select("host", "c", "fixed", "first", "counts")), ways)
        every = hosts.select("host").join(told, "host", "left").join(leads.groupBy("host").agg(listed("at", "n").alias("leads")), "host", "left")
        return durable(every.select("host", "c", "fixed", "first", "counts", "leads").mapInArrow(finish, "host string, template string"))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", split_url(F.col("url"))[0].alias("host"))
    made = templates(rows)
    size = made.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    if size <= MOST_SHIPPED:
        joined = rows.join(F.broadcast(made), "host", "left")
    else:  # every host of a page with html has a template
        joined = split_join(rows.where("html is not null"), made, ["host"]).unionByName(rows.where("html is null").withColumn("template", F.lit(None).cast("string")))
    joined = joined.select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                text = pa.array([main_text(h.as_py(), t.as_py()) for h, t in zip(b.column("html"), b.column("template"), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
