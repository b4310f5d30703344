"""Main text of web pages by wrapper induction.

A node (path and text) is template by its share of all the host's different pages: it is on ``least_pages`` of them and on
``share`` of those that have its path, of the whole host or of one layout (the labels right below the body).  Pages without
that path, such as plain text or another layout, have no say.

Every page is aligned with the reference of its layout, the page with the least hash, by simple tree matching (the largest matching of
equal-labelled nodes that keeps parents and the order of siblings).  Template nodes and nodes with the text of the one that they are aligned
with are constant, all other text varies.  Its sizes are summed by path over all different pages of the layout, and the layout's slot is the
deepest path that holds nearly all of the varying text and, on nearly all pages, leaves no heading out.  Layouts of fewer than ``least_pages``
pages have no slot; where a host has no other, all its pages count as one layout.  The host's wrapper is small: its template nodes and the slots.

A page's text then is what is below the wrapper's slot, without constant nodes and without elements whose tag, role,
class or id says that they are none of the article (menus, adverts, forms, comments, ...), whose text varies, too.  A
slot that still holds <article> or <main> elements is narrowed to these.  Where a host has too few pages for a wrapper, or a page
has none of its slots, the page's <article>, else its <main>, else the element that holds most of the text takes the slot's place.

Pages are never grouped by host and none is left out: nodes and sizes are counted by pre-aggregated groupings, references are minima, and
wrappers go to the pages by a join, which Spark broadcasts where it knows their size.

Defined results: a null or empty page, or one without main text, has the empty text; pages without a url
share the empty host; repeated rows are pages of their own, and copies (of a text, in a layout) count once; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ship

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
#: Elements that are none of an article, and words in a role, class or id that say so.
NOT_TEXT = frozenset("nav footer aside form script style noscript iframe textarea title head svg button select template dialog menu canvas object audio video map input option datalist math xmp noembed noframes".split())
NOT_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NOT_WORD = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager skip copyright legal".split())
WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "label", "children", "drop", "_raw", "_text")

    def __init__(self, tag: str, label: str, drop: bool):
        self.tag, self.label, self.drop = tag, label, drop
        self.children: list[Node | str] = []
        self._raw: str | None = None
        self._text: str | None = None

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def text(self) -> str:
        """All text below, white space collapsed."""
        if self._text is None:
            if self._raw is None:
                self.join()
            self._text = " ".join(self._raw.split())
        return self._text

    def join(self) -> None:
        """All text below every node, with a space at every edge of a block."""
        order: list[Node] = [self]
        for n in order:
            order.extend(c for c in n.children if isinstance(c, Node) and c._raw is None)
        for n in reversed(order):
            edge = "" if n.tag in INLINE else " "
            n._raw = edge + "".join([c._raw if isinstance(c, Node) else entities.unescape(c) if "&" in c else c for c in n.children]) + edge


def element(tag: str, attributes: str) -> Node:
    label, drop = tag, tag in NOT_TEXT
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                label += ("." if name == "class" else "#") + re.sub(r"\d+", "0", value)
                drop |= tag not in ("html", "body", "article", "main") and not NOT_WORD.isdisjoint(WORDS.findall(value))
                drop |= tag == "article" and not {"comment", "comments", "reply", "ad", "advert", "related", "promo"}.isdisjoint(WORDS.findall(value))
            elif name == "role":
                drop |= value in NOT_ROLE
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                drop |= tag not in ("html", "body")
    return Node(tag, label, drop)


def parse(page: str | None) -> Node:
    """A tolerant parser: every page has a tree."""
    root = Node("#root", "", False)
    stack, at, text = [root], 0, page or ""
    while at < len(text):
        m = TOKEN.search(text, at)
        if not m:
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in CLOSES:
            ends, scope = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends.split():
                    del stack[i:]
                    break
                if stack[i].tag in scope.split():
                    break
        node = element(tag, m.group(3))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            stop = end.start() if end else len(text)
            node.children.append(text[at:stop])
            at = stop
            if end:
                at = (text.find(">", stop) + 1) or len(text)
        elif tag not in VOID:
            stack.append(node)
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def pieces(node: Node, constant: frozenset[str], path: str) -> Iterator[str]:
    """The text below a node in page order, with a space at every edge of a block."""
    todo: list[tuple[Node | str, str]] = [(node, path)]
    while todo:
        n, where = todo.pop()
        if isinstance(n, str):
            yield entities.unescape(n) if "&" in n else n
            continue
        here = f"{where}/{n.label}"
        if n is not node and (n.drop or (constant and mark(here, n) in constant)):
            yield " "
            continue
        edge = "" if n.tag in INLINE else " "
        if edge:
            yield edge
            todo.append((edge, here))
        todo.extend((c, here) for c in reversed(n.children))


def mark(path: str, node: Node) -> str:
    return hashlib.md5(f"{path}\n{node.text()}".encode("utf-8", "surrogatepass")).hexdigest()[:16]


def find(node: Node, wanted, path: str = "") -> Iterator[tuple[str, Node]]:  # noqa: ANN001
    """The topmost kept nodes that are wanted, with the path above them."""
    todo = [(node, path)]
    while todo:
        n, where = todo.pop()
        if n.drop:
            continue
        if wanted(n, f"{where}/{n.label}"):
            yield where, n
        else:
            todo.extend((c, f"{where}/{n.label}") for c in reversed(n.nodes()))


def tagged(tree: Node, path: str = "") -> list[tuple[str, Node]]:
    """The <article> elements, else <main>."""
    for tag in ("article", "main"):
        found = list(find(tree, lambda n, p, t=tag: n.tag == t, path))
        if found:
            return found
    return []


def content(tree: Node, slots: tuple[str, ...] = ()) -> list[tuple[str, Node]]:
    """The nodes of the first slot that the page has, narrowed to tagged elements inside, else the page's tagged elements."""
    for slot in slots:
        found = list(find(tree, lambda n, p, s=slot: p == s))
        if found:
            return [x for where, n in found for x in tagged(n, where) or [(where, n)]]
    return tagged(tree)


def extract(page: str | None, constant: frozenset[str] = frozenset(), slots: tuple[str, ...] = ()) -> str:
    tree = parse(page)
    found = content(tree, slots) or [densest(tree)]
    return " ".join("".join(t for where, n in found for t in (*pieces(n, constant, where), " ")).split())


def densest(tree: Node) -> tuple[str, Node]:
    """The deepest element that holds 80 % of the page's kept text."""
    own = lambda where, n: len("".join(pieces(n, frozenset(), where)))
    where, node = body_of(tree)
    size = own(where, node)
    while size:
        path = f"{where}/{node.label}"
        inner = [(own(path, c), c) for c in node.nodes() if not c.drop and c.tag not in INLINE and c.tag != "p"]
        best = max(inner, key=lambda x: x[0], default=(0, None))
        if best[1] is None or best[0] < 0.8 * size:
            break
        where, node = path, best[1]
    return where, node


#: Lists of so few pairs are matched without arrays.
SMALL = 144


class Matcher:
    """Simple tree matching: the largest alignment of two trees' nodes that keeps labels, parents and the order of siblings.

    Subtrees with the same labels all the way down have one shape, and sizes are kept by pairs of shapes."""

    def __init__(self, cells: int = 4_000_000):
        self.cells = cells  # of a table that is held whole
        self.known: dict[tuple[str, tuple[int, ...]], int] = {}
        self.below: list[tuple[int, ...]] = []
        self.label: list[str] = []
        self.nodes: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}
        self.of: dict[int, int] = {}

    def shape(self, tree: Node) -> int:
        order = [(tree, tree.nodes())]
        for _, below in order:
            order.extend([(c, c.nodes()) for c in below])
        for n, below in reversed(order):
            key = (n.label, tuple([self.of[id(c)] for c in below]))
            if key not in self.known:
                self.known[key] = len(self.label)
                self.label.append(n.label)
                self.below.append(key[1])
                self.nodes.append(1 + sum(self.nodes[c] for c in key[1]))
            self.of[id(n)] = self.known[key]
        return self.of[id(tree)]

    def size(self, a: int, b: int) -> int:
        """Nodes of the largest alignment of two shapes."""
        todo = [(a, b)]
        while todo:
            a, b = key = todo[-1]
            if key in self.sizes:
                todo.pop()
            elif self.label[a] != self.label[b] or a == b:
                self.sizes[key] = self.nodes[a] if a == b else 0
            elif need := [(x, y) for x in set(self.below[a]) for y in set(self.below[b]) if (x, y) not in self.sizes]:
                todo += need
            else:
                self.sizes[key] = 1 + int(self.row(self.below[a], self.below[b])[-1])
        return self.sizes[key]

    def weights(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> Iterator[np.ndarray]:
        kinds, of = np.unique(np.array(ys, np.int64), return_inverse=True)
        rows: dict[int, np.ndarray] = {}
        for x in xs:
            if x not in rows:
                rows[x] = np.array([self.size(x, int(y)) for y in kinds])[of]
            yield rows[x]

    def small(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[list[int]]:
        """The best totals of the beginnings of two short lists."""
        table = [[0] * (len(ys) + 1)]
        for x in xs:
            above, row = table[-1], [0]
            for j, y in enumerate(ys):
                size = self.sizes.get((x, y))
                row.append(max(above[j + 1], row[j], above[j] + (self.size(x, y) if size is None else size)))
            table.append(row)
        return table

    def row(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> np.ndarray | list[int]:
        """The best total of all of xs with each beginning of ys."""
        if len(xs) * len(ys) <= SMALL:
            return self.small(xs, ys)[-1]
        best = np.zeros(len(ys) + 1, np.int64)
        if xs and ys:
            for w in self.weights(xs, ys):
                best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + w))
        return best

    def siblings(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """A best alignment of two lists of shapes. Tables over ``cells`` are halved by Hirschberg's rule, so that memory stays linear."""
        head = same_ends(xs, ys)
        tail = same_ends(xs[head:][::-1], ys[head:][::-1])
        if head or tail:  # no alignment has more of equal shapes
            n, m = len(xs) - tail, len(ys) - tail
            return [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in self.siblings(xs[head:n], ys[head:m])] + [(n + i, m + i) for i in range(tail)]
        if not xs or not ys:
            return []
        if len(xs) > 1 and len(xs) * len(ys) > self.cells:
            h = len(xs) // 2
            k = int(np.argmax(np.asarray(self.row(xs[:h], ys)) + np.asarray(self.row(xs[:h - 1 : -1], ys[::-1]))[::-1]))
            return self.siblings(xs[:h], ys[:k]) + [(i + h, j + k) for i, j in self.siblings(xs[h:], ys[k:])]
        if len(xs) * len(ys) <= SMALL:
            table = self.small(xs, ys)
        else:
            table = np.zeros((len(xs) + 1, len(ys) + 1), np.int64)
            for i, w in enumerate(self.weights(xs, ys)):
                table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + w))
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def align(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """The pairs of a best alignment of two trees with equal roots."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            yield a, b
            xs, ys = a.nodes(), b.nodes()
            todo += [(xs[i], ys[j]) for i, j in self.siblings(tuple(self.of[id(x)] for x in xs), tuple(self.of[id(y)] for y in ys))]


def same_ends(xs: tuple[int, ...], ys: tuple[int, ...]) -> int:
    n = 0
    while n < len(xs) and n < len(ys) and xs[n] == ys[n]:
        n += 1
    return n


TEXT_LEVEL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table br hr".split())
HEADINGS = frozenset("h1 h2 h3".split())


def induce(pages: list[str], least_pages: int = 3) -> tuple[list[str], list[str]]:
    """The wrapper of some pages of a host: marks of constant nodes, and the slots of its layouts, the commonest first."""
    trees = {t.text(): t for t in map(parse, sorted(p for p in pages if p))}  # copies count once
    layouts: dict[str, list[Node]] = {}
    for tree in trees.values():
        layouts.setdefault(layout(tree), []).append(tree)
    common = sorted((own for own in layouts.values() if len(own) >= least_pages), key=len, reverse=True)
    if not common and len(trees) >= least_pages:  # no layout is common
        common = [list(trees.values())]
    constant: set[str] = set()
    slots: list[str] = []
    for own in common:
        marks = constant_marks(own)
        constant |= marks
        found, aligned = Sizes(), Aligned(own[0])
        for tree in own:
            found.add(varying(tree, frozenset(marks), aligned.equal(tree)))
        slots += [place for place in found.slots(least_pages) if place not in slots]
    return sorted(constant), slots


class Aligned:
    """A layout's reference and what is known of the shapes that were matched with its own."""

    def __init__(self, tree: Node, most: int = 200_000):
        self.tree, self.most = tree, most
        self.begin()

    def begin(self) -> None:
        self.matcher = Matcher()
        self.matcher.shape(self.tree)
        self.of = dict(self.matcher.of)

    def equal(self, tree: Node) -> set[int]:
        """The topmost kept nodes whose text is that of the reference's node that they are aligned with."""
        if len(self.matcher.sizes) + len(self.matcher.known) > self.most:
            self.begin()
        self.matcher.of = dict(self.of)
        self.matcher.shape(tree)
        of, found, todo = self.matcher.of, set(), [(self.tree, tree)]
        while todo:
            a, b = todo.pop()
            if b.drop:
                continue
            if a.text() == b.text():
                found.add(id(b))
                continue
            xs, ys = a.nodes(), b.nodes()
            todo += [(xs[i], ys[j]) for i, j in self.matcher.siblings(tuple(of[id(x)] for x in xs), tuple(of[id(y)] for y in ys))]
        return found


#: The parent of the bodies.
TOP = 0


def varying(tree: Node, constant: frozenset[str], equal: set[int]) -> list[tuple[int, int | None, str, int, int]]:
    """The sizes of a page's varying text by path, as rows (parent, path, label, size, headed).

    A row without a path has what is right in the parent, with text-level elements, and whether a heading is; the others have all that is in
    a path below the parent, and whether a heading is right in it.  The body's label is its whole path."""
    where, body = body_of(tree)
    start = f"{where}/{body.label}"
    entries = [(TOP, number(start), start, body)]
    rest, headed, up = [0], [False], [0]
    todo: list[tuple[Node | str, str, int, bool]] = [(c, start, 0, False) for c in reversed(body.children)] if id(body) not in equal and id(tree) not in equal else []
    while todo:
        n, where, e, within = todo.pop()
        if isinstance(n, str):
            rest[e] += len(n.strip())
            continue
        here = f"{where}/{n.label}"
        if n.drop or id(n) in equal or (constant and mark(here, n) in constant):
            continue
        if not within and n.tag in HEADINGS:
            headed[e] = True
        if not within and n.tag not in TEXT_LEVEL:
            entries.append((entries[e][1], number(f"{entries[e][1]}/{n.label}"), n.label, n))
            rest.append(0), headed.append(False), up.append(e)
            e = len(up) - 1
            within = n.tag in ("article", "main")
        else:
            within = True
        todo.extend((c, here, e, within) for c in reversed(n.children))
    sizes = list(rest)
    for e in range(len(up) - 1, 0, -1):
        sizes[up[e]] += sizes[e]
    rows: dict[tuple[int, int | None], list] = {}
    for (parent, path, label, n), size, own, head in zip(entries, sizes, rest, headed, strict=True):
        row = rows.setdefault((parent, path), [label, 0, False])
        row[1] += size
        row[2] |= any(c.tag in HEADINGS for c in n.nodes())
        if n.tag not in ("article", "main"):
            row = rows.setdefault((path, None), ["", 0, False])
            row[1] += own
            row[2] |= head
    return [(parent, path, label, size, int(head)) for (parent, path), (label, size, head) in rows.items()]


def descend(starts: list[tuple[int, int, str]], below: dict[int, tuple[int, str]]) -> list[str]:
    """The slots: from each body (size, path, label), the largest first, down as long as a path leads on."""
    found = []
    for _, at, place in sorted(starts, reverse=True):
        start = place
        while at in below:
            at, label = below[at]
            place = f"{place}/{label}"
        if place != start and place not in found:
            found.append(place)
    return found


#: A path leads on to the one below it that holds this share of the varying text, if that leaves headings out on no more pages than the rest.
NEARLY = 0.9


class Sizes:
    """Sums of the rows of ``varying`` in memory."""

    def __init__(self):
        self.label: dict[int, str] = {}
        self.sums: dict[int, dict[int | None, list[int]]] = defaultdict(dict)

    def add(self, rows: list[tuple[int, int | None, str, int, int]]) -> None:
        for parent, path, label, size, head in rows:
            own = self.sums[parent].setdefault(path, [0, 0, 0])
            own[:] = own[0] + size, own[1] + head, own[2] + 1
            if path is not None:
                self.label[path] = label

    def slots(self, least_pages: int) -> list[str]:
        below = {}
        for parent, own in self.sums.items():
            inner = {p: x for p, x in own.items() if p is not None}
            if parent == TOP or not inner:
                continue
            best = max(inner, key=lambda p: (inner[p][0], p))
            few = own[None][2] * (1 - NEARLY)
            if inner[best][0] > 0 and inner[best][0] >= NEARLY * sum(x[0] for x in own.values()) and own[None][1] <= few and sum(x[1] for p, x in inner.items() if p != best) <= few:
                below[parent] = best, self.label[best]
        return descend([(x[0], p, self.label[p]) for p, x in self.sums[TOP].items() if x[2] >= least_pages], below)


def constant_marks(trees: list[Node]) -> set[str]:
    """Marks of the first tree's nodes whose text is the same in all trees that are aligned with it."""
    matcher, same, paths = Matcher(), Counter(), {}
    for tree in trees:
        matcher.shape(tree)
    for other in trees[1:]:
        for x, y in matcher.align(trees[0], other):
            same[id(x)] += x.text() == y.text()
    todo, found = [(trees[0], "")], set()
    while todo:
        n, where = todo.pop()
        here = f"{where}/{n.label}"
        if same[id(n)] == len(trees) - 1 and n.text():
            found.add(mark(here, n))
        else:
            todo.extend((c, here) for c in n.nodes())
    return found


def layout(tree: Node) -> str:
    """The labels right below the body, each once."""
    _, body = body_of(tree)
    return " ".join(sorted({n.label for n in body.nodes()}))


def number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


def body_of(tree: Node) -> tuple[str, Node]:
    """The body, or all of a page without one, with the path above it."""
    return next(iter(find(tree, lambda n, p: n.tag == "body")), ("", tree))


MARKS = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("path", pa.int64()), ("mark", pa.int64()), ("page", pa.int64()), ("html", pa.string())])


def mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html -> for each page its nodes that could be kept (path and mark) and their paths alone (no mark); TOP stands for the page.

    Rows without a path have the page with the least hash of each layout among those read."""
    least: dict[tuple[str, int], tuple[int, str]] = {}

    def references() -> pa.RecordBatch:
        rows = [(host, own, None, None, page, html) for (host, own), (page, html) in least.items()]
        least.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(MARKS)], schema=MARKS)

    for b in batches:
        out: dict[str, list] = {name: [] for name in MARKS.names}
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            tree = parse(html)
            if not tree.text():
                continue
            where, body = body_of(tree)
            own, page, of_layout = {(TOP, None)}, number(tree.text()), number(layout(tree))
            least[host, of_layout] = min(least.get((host, of_layout), (page, html)), (page, html))
            todo = [(c, f"{where}/{body.label}") for c in body.nodes()]
            while todo:
                n, where = todo.pop()
                if n.drop or not n.text():
                    continue
                here = f"{where}/{n.label}"
                path = number(here)
                own |= {(path, None), (path, int.from_bytes(bytes.fromhex(mark(here, n)), "big", signed=True))}
                todo.extend((c, here) for c in n.nodes())
            for name, x in (("host", host), ("layout", of_layout), ("page", page), ("html", None)):
                out[name] += [x] * len(own)
            out["path"] += [path for path, _ in own]
            out["mark"] += [m for _, m in own]
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in MARKS], schema=MARKS)
        if sum(len(html) for _, html in least.values()) > 16 << 20:
            yield references()
    yield references()


def counted_marks(marks: DataFrame) -> DataFrame:
    """host, layout, path, mark, n: on how many of the host's different pages."""
    different = marks.where("path IS NOT NULL").select("host", "layout", "path", "mark", "page").distinct()
    return keep(different.groupBy("host", "layout", "path", "mark").agg(F.count(F.lit(1)).alias("n")))


def template_nodes(counts: DataFrame, share: float, least_pages: int) -> DataFrame:
    """host, constant: the marks that are on enough of the host's different pages.

    Only marks of ``least_pages`` pages meet the counts of their paths, so the many nodes of one page never do."""
    found = None
    for own in (["host", "layout", "path"], ["host", "path"]):
        sums = counts.groupBy(*own, "mark").agg(F.sum("n").alias("n"))
        common = sums.where((F.col("n") >= least_pages) & F.col("mark").isNotNull())
        pages = sums.where("mark IS NULL").select(*own, F.col("n").alias("pages"))
        part = common.join(pages, own).where(F.col("n") >= F.col("pages") * share).select("host", "mark")
        found = part if found is None else found.union(part)
    return found.groupBy("host").agg(F.sort_array(F.collect_set(F.lower(F.lpad(F.hex("mark"), 16, "0")))).alias("constant"))


def references(marks: DataFrame, counts: DataFrame, least_pages: int) -> DataFrame:
    """host, layouts: layout, pages and reference of each common layout; without one, of all pages (layout null)."""
    first = marks.where("path IS NULL").groupBy("host", "layout").agg(F.min(F.struct("page", "html")).alias("first"))
    pages = counts.where((F.col("path") == TOP) & F.col("mark").isNull()).select("host", "layout", F.col("n").alias("pages"))
    rows = keep(pages.join(first, ["host", "layout"]))
    common = rows.where(F.col("pages") >= least_pages).select("host", "layout", "pages", "first.html")
    other = rows.groupBy("host").agg(F.max("pages").alias("most"), F.sum("pages").alias("pages"), F.min("first").alias("first"))
    other = other.where((F.col("most") < least_pages) & (F.col("pages") >= least_pages)).select("host", F.lit(None).cast("long").alias("layout"), "pages", "first.html")
    return common.union(other).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("layout", "pages", "html"))).alias("layouts"))


VARYING = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("page", pa.int64()), ("parent", pa.int64()), ("path", pa.int64()), ("label", pa.string()), ("size", pa.int64()), ("headed", pa.int64())])


def varying_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html, wrapper (constant, layouts) -> the rows of ``varying`` of each page of a layout that has a reference."""
    known: dict[str, tuple[frozenset[str], dict[int | None, str]]] = {}
    aligned: dict[tuple[str, int | None], Aligned] = {}
    for b in batches:
        rows = []
        for host, html, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if w not in known:
                if len(known) > 200:
                    known.clear(), aligned.clear()
                found = json.loads(w)
                known[w] = frozenset(found.get("constant", ())), {x.get("layout"): x["html"] for x in found["layouts"]}
            constant, own = known[w]
            tree = parse(html)
            of_layout = None if None in own else number(layout(tree))
            if of_layout not in own or not tree.text():
                continue
            if (host, of_layout) not in aligned:
                if len(aligned) > 200:
                    aligned.clear()
                aligned[host, of_layout] = Aligned(parse(own[of_layout]))
            page = number(tree.text())
            rows += [(host, of_layout, page, *row) for row in varying(tree, constant, aligned[host, of_layout].equal(tree))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(VARYING)], schema=VARYING)


def slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, layouts (pages, starts, edges) -> host, slots, those of the commonest layout first."""
    for b in batches:
        slots = []
        for own in b.column(1).to_pylist():
            found: list[str] = []
            for x in sorted(own, key=lambda x: (-x["pages"], x["layout"] or 0)):
                below = {e["parent"]: (e["path"], e["label"]) for e in x["edges"] if e["parent"] != TOP}
                found += [p for p in descend([(e["size"], e["path"], e["label"]) for e in x["edges"] if e["parent"] == TOP], below) if p not in found]
            slots.append(found)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(slots, pa.list_(pa.string()))], names=["host", "slots"])


def host_slots(full: DataFrame, wrappers: DataFrame, least_pages: int) -> DataFrame:
    """host, slots: the sums of all pages' varying text, of which only the paths that lead on are brought together."""
    sent = wrappers.where("layouts IS NOT NULL").select("host", F.to_json(F.struct("constant", "layouts")).alias("wrapper"))
    rows = full.join(sent, "host").select("host", "html", "wrapper").mapInArrow(varying_rows, "host string, layout long, page long, parent long, path long, label string, size long, headed long").distinct()
    paths = rows.groupBy("host", "layout", "parent", "path", "label").agg(F.sum("size").alias("size"), F.sum("headed").alias("headed"), F.count(F.lit(1)).alias("pages"))
    paths = keep(paths)
    inner, right = F.col("path").isNotNull(), F.col("path").isNull()
    best = F.max(F.when(inner, F.struct("size", "path", "label", "headed")))
    parents = paths.where(F.col("parent") != TOP).groupBy("host", "layout", "parent").agg(best.alias("best"), F.sum("size").alias("size"), F.sum(F.when(inner, F.col("headed"))).alias("others"), F.max(F.when(right, F.col("headed"))).alias("headed"), F.max(F.when(right, F.col("pages"))).alias("pages"))
    few = F.col("pages") * (1 - NEARLY)
    edges = parents.where((F.col("best.size") > 0) & (F.col("best.size") >= F.col("size") * NEARLY) & (F.col("headed") <= few) & (F.col("others") - F.col("best.headed") <= few))
    edges = edges.select("host", "layout", "parent", "best.path", "best.label", "best.size")
    starts = paths.where((F.col("parent") == TOP) & (F.col("pages") >= least_pages)).select("host", "layout", "parent", "path", "label", "size")
    each = starts.union(edges).groupBy("host", "layout").agg(F.collect_list(F.struct("parent", "path", "label", "size")).alias("edges"))
    number_of = wrappers.select("host", F.explode("layouts").alias("x")).select("host", F.col("x.layout").alias("layout"), F.col("x.pages").alias("pages"))
    each = each.alias("e").join(number_of.alias("n"), F.expr("e.host = n.host AND e.layout <=> n.layout")).select("e.host", "e.layout", "n.pages", "e.edges")
    return each.groupBy("host").agg(F.collect_list(F.struct("layout", "pages", "edges")).alias("layouts")).mapInArrow(slot_rows, "host string, slots array<string>")


def extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html, wrapper -> page_id, url, text."""
    known: dict[str | None, tuple[frozenset[str], tuple[str, ...]]] = {None: (frozenset(), ())}
    for b in batches:
        texts = []
        for page, wrapper in zip(b.column(2), b.column(3), strict=True):
            w = wrapper.as_py()
            if w not in known:
                if len(known) > 1000:
                    known = {None: (frozenset(), ())}
                found = json.loads(w)
                known[w] = (frozenset(found.get("constant", ())), tuple(found.get("slots", ())))
            texts.append(extract(page.as_py(), *known[w]))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, share: float = 0.8, least_pages: int = 3) -> DataFrame:
    """page_id, url and the page's main text."""
    ship(__name__)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    full = rows.where(F.col("html").rlike(r"\S")).select("host", "html")
    marks = keep(full.mapInArrow(mark_rows, "host string, layout long, path long, mark long, page long, html string"))
    counts = counted_marks(marks)
    wrappers = keep(template_nodes(counts, share, least_pages).join(references(marks, counts, least_pages), "host", "full"))
    found = wrappers.select("host", "constant").join(host_slots(full, wrappers, least_pages), "host", "left")
    found = keep(found.select("host", F.to_json(F.struct("constant", "slots")).alias("wrapper")))
    return rows.join(found, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(extract_rows, "page_id long, url string, text string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
