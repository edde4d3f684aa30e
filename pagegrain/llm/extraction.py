"""Operator 2: main text of pages by wrapper induction.

Pages of a host are aligned with a reference page of that host by simple tree matching, which finds
the largest order-preserving mapping of two DOM trees that keeps parents. Every text of a page is
counted at the node of the reference that it or its nearest mapped ancestor is mapped to, over all
different pages of the host (``MIN_PAGES`` or more). From these counts comes the host's wrapper:

- A text met unchanged in at least ``SHARE`` of the pages is constant, all other text varies.
- Content are the articles (``article``, ``main``) whose text varies; an article that is the same on all
  pages is template. Where articles hold under ``ARTICLE_SHARE`` of what varies, or a host has none, it is
  the deepest block that holds ``CONTENT_SHARE`` of the varying text outside of links.
- What is in an article stays, also where all pages share it. In other content, blocks of constant texts are template; headings belong to
  what follows them and stay. Where over half of such content is constant, the pages are copies and nothing in it is template.

A page's main text is what is mapped to the content, without template blocks and without parts that are
no content by their element, their role, or the words of their class or id: menus, page headers,
footers, sidebars, notices, adverts, forms, reader comments, scripts. Words are held against the structure (``_settle``): they say
nothing of what holds an article, of a part of a sentence, of most of a page, nor, in an article, those of menus of
what is not made of links. Runs of like-shaped siblings that share a link's text ("Reply") and have no heading are records of
comments or cards by structure alone (``_records``). Pages without a wrapper (hosts of
few pages), or with nothing mapped to the content, fall back to their articles, else to their body.

Each page is parsed and aligned once, in one narrow step; per host only counts at reference nodes are
gathered (pre-aggregated), so a hot host is no larger a group than any other. Reference pages and wrappers
of up to ``BROADCAST_BYTES``, by a checked size, are broadcast. Beyond it pages are dealt by host and a
salt (``SALTS``) and meet their host's reference as the first row of its group.

Lists of children with over ``TABLE_CELLS`` pairs are aligned as exactly, but row by row and split in halves
(Hirschberg), in memory of the lists' length; their equal heads and tails are paired at once, which loses
nothing. Nothing recurses by depth. Of several largest matchings any one may be taken.

White space in a block becomes one space, blocks are joined by one space, character references are
decoded. Cases: a null or empty html has an empty text. A null url has no host, hence no wrapper.
Pages of a host with equal texts count once. Of equal least ids the least page hash gives the reference.
Repeated rows have equal results; an empty table gives no rows. ``text``, ``n_chars`` and ``n_template``
take the place of columns of that name, html is left out, all other columns pass through under any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.functions.html import HEADINGS, Node, parse
from pagegrain.llm.columns import pack, unpack
from pagegrain.sources.pages import spread
from pagegrain.storage import stash

MIN_PAGES = 4
SHARE = 0.8
ARTICLE_SHARE = 0.3
CONTENT_SHARE = 0.8
BROADCAST_BYTES = 32 << 20
SALTS = 64
TABLE_CELLS = 1_000_000
HOT = 16
MANY_TEXTS = 64
_CACHE = 256

_NEVER = frozenset(
    "script style noscript template head title nav footer aside form button select textarea input option menu dialog iframe svg math canvas"
    " object embed audio video map datalist progress meter".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
#: Words of a class or id (parted at hyphens, underscores and capitals) that name a part which is no content: adverts, notices, side bars; reader comments; menus.
_MARKED = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsored promo sidebar masthead cookie cookies gdpr consent notice alert newsletter popup modal".split())
_COMMENTS = frozenset("comment comments disqus respond".split())
_MENUS = frozenset("menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar share social skip".split())
#: Whole names of a class or id.
_NAMED = frozenset("side-bar site-header page-header site-footer page-footer".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
_BLOCKS = frozenset("body div main article section td center table tbody tr details dd li ul ol dl".split())
_PARTS, _CAMEL = re.compile(r"[-_]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What a node is: a text, no content anywhere, no content outside of an article, an article or main element, part of a line, a heading, a block,
#: a link, a line break, a main element.
TEXT, NEVER, OUTSIDE, ARTICLE, INLINE, HEADING, BLOCK, LINK, BREAK, MAIN, MARK, TALK, MENU = (1 << i for i in range(13))
#: What class words say is held against the page: a menu is made of links, and no mark is on most of the text.
LINK_SHARE, MOST, ALL = 0.5, 0.5, 0.9
#: So many like-shaped siblings with a link of the same text, and no heading, are records (comments, cards).
RECORDS = 3


class Tree:
    """A node of the matching tree: an element from body down, or a text (label ``#``) with white space turned into single spaces."""

    __slots__ = ("label", "text", "children", "number", "kind")

    def __init__(self, label: str, text: str, number: int):
        self.label, self.text, self.number = label, text, number
        self.children: list[Tree] = []
        self.kind = -1


def _words(value: str) -> set[str]:
    return {w for name in value.split() for w in _PARTS.split(_CAMEL.sub("-", name).lower())}


def _bits(node: Node) -> int:
    """What an element is by its name, role, class and id; what class words say is not settled yet."""
    out = (INLINE * (node.name in _INLINE)) | (HEADING * (node.name in HEADINGS)) | (BLOCK * (node.name in _BLOCKS)) | (LINK * (node.name == "a")) | (BREAK * (node.name == "br"))
    article, main, never = node.name in ("article", "main"), node.name == "main", node.name in _NEVER
    outside = node.name == "header"
    for key, value in node.attrs:
        if key in ("class", "id"):
            names, words = set(value.lower().split()), _words(value)
            if node.name not in ("article", "main", "body"):
                never |= bool(names & _NAMED)
                outside |= "header" in names
                out |= (MARK * bool(words & _MARKED)) | (TALK * bool(words & _COMMENTS)) | (MENU * bool(words & _MENUS))
            elif node.name == "article":
                never |= "comment" in names or "comments" in names
        elif key == "role":
            main |= value.strip().lower() == "main"
            never |= value.strip().lower() in _ROLES
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _HIDDEN.search(value):
            never = True
    article = (article or main) and not never
    return out | (NEVER * never) | (OUTSIDE * (never or outside)) | (ARTICLE * article) | (MAIN * (article and main))


def _settle(up: list[int], bits: list[int], texts: list[str | None]) -> None:
    """Settles what class words say by the page's structure.

    They say nothing of what holds an article, of a part of a sentence, or of most of the page's text; those of menus nothing, within an article,
    of what is not made of links.
    """
    size, linked, line, holds = [0] * len(up), [0] * len(up), [0] * len(up), [False] * len(up)
    for i in range(len(up) - 1, 0, -1):
        if bits[i] & TEXT:
            size[i] = len(texts[i].strip())
        if bits[i] & LINK:
            linked[i] = size[i]
        above = up[i]
        size[above] += size[i]
        linked[above] += linked[i]
        line[above] += size[i] if bits[i] & (TEXT | INLINE) else 0
        holds[above] = holds[above] or holds[i] or bool(bits[i] & ARTICLE)
    any_article = holds[0]
    for i, b in enumerate(bits):
        if not b & (MARK | TALK | MENU) or holds[i] or b & INLINE and line[up[i]] > size[i]:
            continue
        if size[i] > (2 if any_article else ALL if b & TALK else MOST) * max(size[0], 1):
            continue
        if b & (MARK | TALK) or linked[i] >= LINK_SHARE * size[i]:
            bits[i] |= NEVER | OUTSIDE
        else:
            bits[i] |= OUTSIDE


def _records(trees: list[Tree], bits: list[int]) -> None:
    """Marks records as no content: runs of like-shaped siblings that share the text of a link, have text of their own besides, and no heading."""
    for parent in trees:
        kids = [c for c in parent.children if c.label != "#"]
        at = 0
        while at + RECORDS <= len(kids):
            shape, to = _shape(kids[at]), at + 1
            while to < len(kids) and _shape(kids[to]) == shape:
                to += 1
            if to - at >= RECORDS and len(shape[1]) > 1:
                shared, each = None, []
                for k in kids[at:to]:
                    below, links = _preorder(k), set()
                    for t in below:
                        if bits[t.number] & LINK:
                            links.add(" ".join(x.text for x in _preorder(t) if x.label == "#"))
                    shared = links if shared is None else shared & links
                    each.append("\0" if any(bits[t.number] & (HEADING | ARTICLE) for t in below) else " ".join(t.text for t in below if t.label == "#"))
                if shared and any(shared) and "\0" not in each and len(set(each)) == len(each):
                    for k in kids[at:to]:
                        bits[k.number] |= NEVER | OUTSIDE
            at = to


def _shape(tree: Tree) -> tuple:
    return tree.label, tuple([c.label for c in tree.children if c.label != "#"])


class PageTree:
    """A page from its body down, in preorder: parents, what each node is, texts (null for elements); ``top`` leaves out white space."""

    def __init__(self, html: str | None):
        document = parse(html)
        root = next((n for n in document.children if n.kind == "element"), document)
        body = next((n for n in reversed(root.children) if n.name == "body"), root)
        self.top = Tree("body", "", 0)
        self.up, self.bits, self.texts, self.trees = [-1], [_bits(body) & ~(NEVER | OUTSIDE) | BLOCK], [None], [self.top]
        stack: list[tuple[Node, Tree]] = [(c, self.top) for c in reversed(body.children)]
        while stack:
            node, above = stack.pop()
            number = len(self.up)
            if node.kind == "text":
                words = node.text.split()
                tree = Tree("#", " ".join(words), number)
                if words:
                    above.children.append(tree)
                self.bits.append(TEXT)
                self.texts.append(node.text if words else " ")
            elif node.kind == "element" and node.name not in ("script", "style", "noscript"):
                tree = Tree(node.name, "", number)
                above.children.append(tree)
                self.bits.append(_bits(node))
                self.texts.append(None)
                stack += [(c, tree) for c in reversed(node.children)]
            else:
                continue
            self.up.append(above.number)
            self.trees.append(tree)
        _settle(self.up, self.bits, self.texts)
        _records(self.trees, self.bits)


def _texts(trees: list[Tree]) -> set[str]:
    return {t.text for t in trees if t.label == "#"}


def _preorder(top: Tree) -> list[Tree]:
    out, stack = [], [top]
    while stack:
        out.append(t := stack.pop())
        stack += t.children
    return out


class Kinds:
    """Numbers for subtrees that no matching can tell apart: texts that only one of two pages has are alike.

    A subtree's number is over the numbers of its parts, so pairs are weighed from the leaves up without recursion.
    """

    def __init__(self, common: set[str]):
        self.common, self.ids = common, {}
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.examples: list[Tree] = []
        self.known: dict[tuple[int, int], int] = {}
        # A kind's shape is its tree without texts; two kinds without a text in common weigh as their shapes do.
        self.shape: list[int] = []
        self.has: list[frozenset[str] | None] = []
        self.shapes: dict[tuple, int] = {}
        self.shape_kids: list[tuple[str, tuple[int, ...]]] = []
        self.shape_known: dict[tuple[int, int], int] = {}

    def number(self, trees: list[Tree]) -> None:
        """Numbers ``trees``, which come with every part behind its whole."""
        for t in reversed(trees):
            key = (t.label, t.text if t.text in self.common else None, tuple([c.kind for c in t.children]))
            t.kind = self.ids.setdefault(key, len(self.ids))
            if t.kind == len(self.labels):
                self.labels.append(t.label)
                self.kids.append(key[2])
                self.examples.append(t)
                bare = (t.label, tuple([self.shape[c.kind] for c in t.children]))
                self.shape.append(self.shapes.setdefault(bare, len(self.shapes)))
                if self.shape[-1] == len(self.shape_kids):
                    self.shape_kids.append(bare)
                own = [self.has[c.kind] for c in t.children]
                texts = None if None in own else frozenset().union(*own, () if key[1] is None else (t.text,))
                self.has.append(texts if texts is not None and len(texts) <= MANY_TEXTS else None)

    def _apart(self, a: int, b: int) -> int | None:
        """The weight of two kinds of which it is known that they have no text in common, from their shapes; None of others."""
        x, y = self.has[a], self.has[b]
        if x is None or y is None or not x.isdisjoint(y):
            return None
        return self._shape_weight(self.shape[a], self.shape[b])

    def _shape_weight(self, a: int, b: int) -> int | None:
        if (a, b) in self.shape_known:
            return self.shape_known[a, b]
        need, stack = {(a, b)}, [(a, b)]
        while stack:
            (_, x), (_, y) = (self.shape_kids[k] for k in stack.pop())
            if len(x) * len(y) > TABLE_CELLS:
                return None
            for i in set(x):
                for j in set(y):
                    if self.shape_kids[i][0] == self.shape_kids[j][0] and (i, j) not in need and (i, j) not in self.shape_known:
                        need.add((i, j))
                        stack.append((i, j))
        for i, j in sorted(need):
            (p, x), (q, y) = self.shape_kids[i], self.shape_kids[j]
            self.shape_known[i, j] = 0 if p != q else 1 if not x or not y else 1 + self.table(x, y, self.shape_known)[-1][-1]
        return self.shape_known[a, b]

    def _try_apart(self, a: int, b: int) -> bool:
        found = self._apart(a, b)
        if found is not None:
            self.known[a, b] = found
        return found is not None

    def weight(self, a: int, b: int) -> int:
        """The size of the largest matching of two subtrees; equal texts count double."""
        if (a, b) in self.known:
            return self.known[a, b]
        need, stack = {(a, b)}, [(a, b)]
        while stack:
            x, y = (self.kids[k] for k in stack.pop())
            if len(x) * len(y) <= TABLE_CELLS:
                for i in set(x):
                    for j in set(y):
                        if self.labels[i] == self.labels[j] and (i, j) not in need and (i, j) not in self.known and not self._try_apart(i, j):
                            need.add((i, j))
                            stack.append((i, j))
        for i, j in sorted(need):
            self.known[i, j] = self._weigh(i, j)
        return self.known[a, b]

    def fill(self, x: set[int], y: set[int]) -> None:
        """Weighs all pairs of these kinds."""
        for i in x:
            for j in y:
                if self.labels[i] == self.labels[j] and (i, j) not in self.known and not self._try_apart(i, j):
                    self.weight(i, j)

    def _weigh(self, a: int, b: int) -> int:
        if self.labels[a] != self.labels[b]:
            return 0
        x, y = self.kids[a], self.kids[b]
        if not x or not y:
            return 1 + (self.labels[a] == "#" and a == b and self.examples[a].text in self.common)
        if len(x) * len(y) > TABLE_CELLS:
            return 1 + _Long(self.examples[a].children, self.examples[b].children, self).best()
        return 1 + self.table(x, y)[-1][-1]

    def table(self, x: tuple[int, ...], y: tuple[int, ...], known: dict[tuple[int, int], int] | None = None) -> list[list[int]]:
        """The best weight of the first i of x with the first j of y."""
        rows = [[0] * (len(y) + 1)]
        known = self.known if known is None else known
        for i in x:
            last, row, left = rows[-1], [0], 0
            weights = {j: known.get((i, j), 0) for j in set(y)}
            for k, j in enumerate(y):
                both = last[k] + weights[j]
                left = max(last[k + 1], left, both)
                row.append(left)
            rows.append(row)
        return rows


def weight(a: Tree, b: Tree) -> int:
    """The size of the largest matching of two trees; equal texts count double."""
    x, y = _preorder(a), _preorder(b)
    kinds = Kinds(_texts(x) & _texts(y))
    kinds.number(x)
    kinds.number(y)
    return kinds.weight(a.kind, b.kind)


class _Long:
    """Two long lists of children: the weights of a row of pairs at a time, and the alignment in linear memory.

    Texts that only one of the lists has equal none of the other's, so trees that differ in such texts alone
    are one kind. Kinds weigh as their shapes do, which keep only the texts of over ``HOT`` trees, unless they
    have another text in common; these few are weighed one by one.
    """

    def __init__(self, x: list[Tree], y: list[Tree], kinds: Kinds):
        self.x, self.y, self.kinds = x, y, kinds
        times = [Counter(t for tree in trees for t in set(self._texts(tree))) for trees in (x, y)]
        common = times[0].keys() & times[1].keys() & kinds.common
        hot = {t for t in common if max(n[t] for n in times) > HOT}
        self.names: dict = {}
        (self.kind_x, self.shape_x, has_x), (kind_y, shape_y, has_y) = (self._numbers(trees, common, hot) for trees in (x, y))
        places: dict[str, list[int]] = {}
        for j, has in enumerate(has_y):
            for text in has:
                places.setdefault(text, []).append(j)
        self.near = {k: sorted({j for t in has for j in places[t]}) for k, has in zip(self.kind_x, has_x, strict=True)}
        self.kind_y, self.special = kind_y, {}
        _, first, self.at_y = np.unique(np.array(shape_y), return_index=True, return_inverse=True)
        self.hot, self.by_shape = hot, {}
        self.shapes_y = [self._bare(y[j], hot, "\0y") for j in first.tolist()]

    @staticmethod
    def _texts(tree: Tree) -> Iterator[str]:
        stack = [tree]
        while stack:
            t = stack.pop()
            if t.label == "#":
                yield t.text
            stack += t.children

    def _numbers(self, trees: list[Tree], common: set[str], hot: set[str]) -> tuple[list[int], list[int], list[set[str]]]:
        """Numbers of each tree's kind and of its shape, and its common texts that are not hot."""
        name = lambda *key: self.names.setdefault(key, len(self.names))
        out: tuple = ([], [], [])
        for t in trees:
            done: dict[int, tuple[int, int]] = {}
            stack, has = [(t, False)], set()
            while stack:
                n, below = stack.pop()
                if not below and n.children:
                    stack.append((n, True))
                    stack += [(c, False) for c in n.children]
                    continue
                if n.label == "#" and n.text in common and n.text not in hot:
                    has.add(n.text)
                kids = [done[id(c)] for c in n.children]
                texts = (n.text if n.text in common else None, n.text if n.text in hot else None)
                done[id(n)] = tuple(name(n.label, texts[k], *(c[k] for c in kids)) for k in range(2))
            for found, value in zip(out, (*done[id(t)], has), strict=True):
                found.append(value)
        return out

    @staticmethod
    def _bare(tree: Tree, hot: set[str], other: str) -> Tree:
        """A copy whose texts that are not hot are ``other``."""
        top = Tree(tree.label, "", -1)
        stack = [(tree, top)]
        while stack:
            t, copy = stack.pop()
            if t.label == "#":
                copy.text = t.text if t.text in hot else other
            for child in t.children:
                copy.children.append(Tree(child.label, "", -1))
                stack.append((child, copy.children[-1]))
        return top

    def row(self, i: int) -> np.ndarray:
        """The weights of x[i] with all of y."""
        kind, shape = self.kind_x[i], self.shape_x[i]
        if shape not in self.by_shape:
            if len(self.by_shape) >= max(1, TABLE_CELLS // len(self.shapes_y)):
                self.by_shape.clear()
            # A representative's own texts must not count: only shapes are compared.
            bare = self._bare(self.x[i], hot=self.hot, other="\0x")
            self.by_shape[shape] = np.array([weight(bare, t) for t in self.shapes_y], np.int64)
        if kind not in self.special:
            found: dict[int, int] = {}
            for j in self.near[kind]:
                if self.kind_y[j] not in found:
                    found[self.kind_y[j]] = self.kinds.weight(self.x[i].kind, self.y[j].kind)
            self.special[kind] = np.array(self.near[kind], np.int64), np.array([found[self.kind_y[j]] for j in self.near[kind]], np.int64)
        weights = self.by_shape[shape][self.at_y]
        at, values = self.special[kind]
        weights[at] = values
        return weights

    def scores(self, rows: range, a: int, b: int, back: bool = False) -> np.ndarray:
        """The best weight of these rows with y[a:a + k], or with y[b - k:b] if ``back``, for each k."""
        last = np.zeros(b - a + 1, np.int64)
        for i in rows:
            w = self.row(i)[a:b]
            # A pair of different labels weighs 0, so taking it is taking none.
            last[1:] = np.maximum.accumulate(np.maximum(last[1:], last[:-1] + (w[::-1] if back else w)))
        return last

    def ends(self) -> tuple[int, int]:
        """How many trees are of equal kinds at the start and then at the end. No tree weighs more with another than with one of its kind."""
        n, head, tail = min(len(self.x), len(self.y)), 0, 0
        while head < n and self.x[head].kind == self.y[head].kind:
            head += 1
        while tail < n - head and self.x[-1 - tail].kind == self.y[-1 - tail].kind:
            tail += 1
        return head, tail

    def best(self) -> int:
        head, tail = self.ends()
        same = [*range(head), *range(len(self.x) - tail, len(self.x))]
        total = sum(2 if t.label == "#" and t.text in self.kinds.common else 1 for i in same for t in _preorder(self.x[i]))
        return total + int(self.scores(range(head, len(self.x) - tail), head, len(self.y) - tail)[-1])

    def pairs(self) -> list[tuple[Tree, Tree]]:
        head, tail = self.ends()
        nx, ny = len(self.x), len(self.y)
        out = [(self.x[i], self.y[i]) for i in range(head)] + [(self.x[nx - k], self.y[ny - k]) for k in range(tail, 0, -1)]
        stack = [(head, nx - tail, head, ny - tail)]
        while stack:
            i, j, a, b = stack.pop()
            if i == j or a == b:
                continue
            if j - i == 1:
                w = self.row(i)[a:b]
                if w.max():
                    out.append((self.x[i], self.y[a + int(w.argmax())]))
                continue
            mid = (i + j) // 2
            both = self.scores(range(i, mid), a, b) + self.scores(range(j - 1, mid - 1, -1), a, b, True)[::-1]
            cut = a + int(both.argmax())
            stack += [(i, mid, a, cut), (mid, j, cut, b)]
        return out


def align(a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
    """The pairs of nodes of two trees under a largest matching; the trees' own labels are equal."""
    x, y = _preorder(a), _preorder(b)
    kinds = Kinds(_texts(x) & _texts(y))
    kinds.number(x)
    kinds.number(y)
    out, stack = [], [(a, b)]
    while stack:
        out.append(pair := stack.pop())
        kinds.weight(pair[0].kind, pair[1].kind)  # equal ends of long lists were not weighed yet
        x, y = pair[0].children, pair[1].children
        if not x or not y:
            continue
        if len(x) * len(y) > TABLE_CELLS:
            stack += _Long(x, y, kinds).pairs()
            continue
        kinds.fill({c.kind for c in x}, {c.kind for c in y})  # a pair weighed by its shape has no weights of its parts yet
        rows = kinds.table([c.kind for c in x], [c.kind for c in y])
        i, j = len(x), len(y)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                stack.append((x[i], y[j]))
    return out


def _articles(up: list[int], bits: list[int], texts: list[str | None]) -> list[int]:
    """The outermost main elements or the outermost articles, whichever hold more text, outside of what is no content."""
    shut, root = [False] * len(up), [-1] * len(up)
    size: dict[int, int] = {}
    for i, b in enumerate(bits):
        if i:
            shut[i], root[i] = shut[up[i]] or bool(b & NEVER), root[up[i]]
        if b & ARTICLE and root[i] < 0 and not (i and shut[up[i]]):
            root[i], size[i] = i, 0
        if b & TEXT and root[i] >= 0 and not shut[i]:
            size[root[i]] += len(texts[i].strip())
    mains, others = ([i for i in size if bool(bits[i] & MAIN) == main] for main in (True, False))
    return mains if mains and sum(size[i] for i in mains) >= sum(size[i] for i in others) else others


class Wrapper:
    """What a host's pages have in common: the reference nodes that are content, and the constant texts within."""

    def __init__(self, content: list[int], template: list[int]):
        self.content, self.template = frozenset(content), frozenset(template)


def decide(page: PageTree, n: int, counts: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The content and the template texts of a reference page, from (node, varying or constant characters, times unchanged) over n pages."""
    up, bits = page.up, page.bits
    chars, times = [0] * len(up), [0] * len(up)
    for node, size, same in counts:
        chars[node], times[node] = size, same
    constant = [bool(b & TEXT) and times[i] >= SHARE * n for i, b in enumerate(bits)]
    held, all_chars = [0 if c else x for c, x in zip(constant, chars, strict=True)], list(chars)
    for i in range(len(up) - 1, 0, -1):
        held[up[i]] += held[i]
        all_chars[up[i]] += all_chars[i]
    content = [i for i in _articles(up, bits, page.texts) if held[i]]
    if not held[0] or sum(held[i] for i in content) < ARTICLE_SHARE * held[0]:
        content = [max((i for i, b in enumerate(bits) if b & BLOCK and held[i] >= CONTENT_SHARE * held[0]), default=0)] if held[0] else []
    if sum(held[i] for i in content) * 2 < sum(all_chars[i] for i in content):
        return content, []
    if all(bits[i] & ARTICLE for i in content):
        return content, []
    # The block of a text is its nearest ancestor that is not part of a line.
    block = list(range(len(up)))
    for i in range(1, len(up)):
        block[i] = block[up[i]] if bits[i] & (TEXT | INLINE | BREAK) else i
    varies = {block[i] for i, b in enumerate(bits) if b & TEXT and page.texts[i] != " " and not constant[i]} | {block[i] for i, x in enumerate(held) if chars[i] and not bits[i] & TEXT}
    return content, [i for i, c in enumerate(constant) if c and block[i] not in varies and not bits[block[i]] & HEADING and block[i] not in content]


def main_text(up: list[int], bits: list[int], texts: list[str | None], ref: list[int] | None, wrapper: Wrapper | None) -> tuple[str, int]:
    """The main text of a page, and how many template texts it leaves out."""
    roots: set[int] = set()
    if wrapper is not None and ref:
        roots = {i for i, r in enumerate(ref) if r in wrapper.content}
        if any(bits[i] & ARTICLE for i in roots):
            roots |= {i for i in _articles(up, bits, texts) if ref[i] < 0}
    template = wrapper.template if roots else frozenset()
    roots = roots or set(_articles(up, bits, texts)) or {0}
    no_content = NEVER if all(bits[i] & ARTICLE for i in roots) else NEVER | OUTSIDE
    parts: list[str] = []
    state = [0] * len(up)  # 0 outside of the content, 1 within, 2 left out
    opened: list[int] = []
    n_template = 0
    for i, b in enumerate(bits):
        while opened and opened[-1] != up[i]:
            if not bits[opened.pop()] & INLINE:
                parts.append(" ")
        above = state[up[i]] if i else 0
        state[i] = 1 if i in roots and above != 2 else 2 if above == 1 and b & no_content else above
        if b & TEXT:
            if state[i] == 1:
                if ref and ref[i] in template:
                    n_template += 1
                    parts.append(" ")
                else:
                    parts.append(texts[i])
        else:
            opened.append(i)
            if not b & INLINE:
                parts.append(" ")
    return " ".join("".join(parts).split()), n_template


def _counts(page: PageTree, ref: list[int]) -> dict[int, list[int]]:
    """For each reference node the page's characters outside of links that are counted there, and 1 if it is an unchanged text."""
    out: dict[int, list[int]] = {}
    at, shut = list(ref), [False] * len(ref)
    for i, b in enumerate(page.bits):
        above = page.up[i]
        if i:
            shut[i] = shut[above] or bool(b & (NEVER | LINK))
            at[i] = ref[i] if ref[i] >= 0 else at[above]
        if b & TEXT and page.texts[i] != " ":
            found = out.setdefault(at[i], [0, 0])
            if not shut[i]:
                found[0] += len(page.trees[i].text)
    return out


_ALIGNED = "hash long, up array<int>, bits array<int>, texts array<string>, ref array<int>, counts array<struct<node:int,chars:int,same:int>>"
_COUNTS = pa.list_(pa.struct([("node", pa.int32()), ("chars", pa.int32()), ("same", pa.int32())]))


class _References:
    """Parsed reference pages by host, the last few of them."""

    def __init__(self):
        self.known: dict[str, PageTree] = {}

    def __call__(self, host: str, html: str) -> PageTree:
        if host not in self.known:
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[host] = PageTree(html)
        return self.known[host]


def _aligned(batch: pa.RecordBatch, rows: list[int], reference: Callable[[str | None], PageTree | None]) -> pa.RecordBatch:
    """The pages of these rows as trees, each node with the reference node it is mapped to."""
    out: dict[str, list] = {c: [] for c in ("up", "bits", "texts", "ref", "counts")}
    hosts, pages = batch.column("host").to_pylist(), batch.column("html").to_pylist()
    for k in rows:
        page, against = PageTree(pages[k]), reference(hosts[k])
        ref, counts = [], []
        if against is not None:
            ref, same = [-1] * len(page.up), []
            for r, p in align(against.top, page.top):
                ref[p.number] = r.number
                if r.label == "#" and r.text == p.text:
                    same.append(r.number)
            told = _counts(page, ref)
            for number in same:
                told.setdefault(number, [0, 0])[1] = 1
            counts = [{"node": node, "chars": chars, "same": n} for node, (chars, n) in told.items()]
        for name, value in zip(out, (page.up, page.bits, page.texts, ref, counts), strict=True):
            out[name].append(value)
    kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), _COUNTS)
    made = [pa.array(out[name], kind) for name, kind in zip(out, kinds, strict=True)]
    keep = ["own", "page_id", "url", "host", "hash"]
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in keep), *made], [*keep, *out])


def _align_known(sent):
    """References are known to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = sent.value, _References()
        for batch in batches:
            yield _aligned(batch, list(range(batch.num_rows)), lambda host: cache(host, known[host]) if host in known else None)

    return run


def _align_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References come as the first row of their group."""
    group, reference = None, None
    for batch in batches:
        hosts, firsts, salts = (batch.column(c).to_pylist() for c in ("host", "first", "salt"))
        at = 0
        while at < batch.num_rows:
            if (hosts[at], salts[at]) != group:
                group, reference = (hosts[at], salts[at]), None
            if firsts[at]:
                reference, at = PageTree(batch.column("html")[at].as_py()), at + 1
                continue
            to = at + 1
            while to < batch.num_rows and not firsts[to] and (hosts[to], salts[to]) == group:
                to += 1
            yield _aligned(batch, list(range(at, to)), lambda _, known=reference: known)
            at = to


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def references(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, html): a reference page of each host with enough different pages."""
    rows = pages.select(_host("url").alias("host"), F.col("page_id").cast("long").alias("id"), F.xxhash64("html").alias("hash"), "html").filter((F.length("html") > 0) & (F.length("host") > 0))
    hosts = rows.groupBy("host", "hash").agg(F.min("id").alias("id")).groupBy("host").agg(F.count("*").alias("n"), F.min(F.struct("id", "hash")).alias("x"))
    hosts = stash(hosts.filter(F.col("n") >= min_pages).select("host", F.col("x.hash").alias("hash")), "hosts")
    chosen = rows.join(F.broadcast(hosts) if hosts.count() <= BROADCAST_BYTES // 64 else hosts, ["host", "hash"], "left_semi")
    return stash(chosen.dropDuplicates(["host"]).select("host", "html"), "references")


def align_pages(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Packed ``pages`` as trees, each node with the number of the reference node of its host that it is mapped to."""
    packed = pack(pages, "page_id", "url", "html").withColumns({"host": _host("url"), "hash": F.xxhash64("html")})
    schema = T.StructType([*packed.schema.fields[:3], T.StructField("host", T.StringType()), *T._parse_datatype_string(_ALIGNED).fields])
    if (refs.agg(F.sum(F.octet_length("html") + F.octet_length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: r.html for r in refs.collect()})
        return packed.mapInArrow(_align_known(sent), schema)
    salted = packed.withColumns({"salt": F.pmod("hash", F.lit(SALTS)).cast("int"), "first": F.lit(False)})
    firsts = refs.withColumns({"salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))), "first": F.lit(True)})
    met = firsts.unionByName(salted, allowMissingColumns=True).repartition("host", "salt").sortWithinPartitions("host", "salt", F.desc("first"))
    return met.mapInArrow(_align_met, schema)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, template = [], []
        for html, n, counts in zip(*(batch.column(c).to_pylist() for c in ("html", "n", "counts")), strict=True):
            for out, found in zip((content, template), decide(PageTree(html), n, [(c["node"], c["chars"], c["same"]) for c in counts]), strict=True):
                out.append(found)
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("n"), *(pa.array(x, pa.list_(pa.int32())) for x in (content, template))], ["host", "n_pages", "content", "template"])


def induce_wrappers(aligned: DataFrame, refs: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, n_pages, content, template): for each host the reference nodes that are content, and the constant texts that are not."""
    different = aligned.filter(F.size("ref") > 0).groupBy("host", F.xxhash64("texts").alias("page")).agg(F.min("counts").alias("counts"))
    different = stash(different, "counts")
    n = different.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    node = different.select("host", F.explode("counts").alias("c")).groupBy("host", "c.node").agg(F.sum("c.chars").alias("chars"), F.sum("c.same").alias("same"))
    per_host = node.groupBy("host").agg(F.collect_list(F.struct("node", "chars", "same")).alias("counts"))
    return refs.join(n, "host").join(per_host, "host").mapInArrow(_decide, "host string, n_pages long, content array<int>, template array<int>")


def _extract(broadcast=None):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = broadcast.value if broadcast is not None else None
        wrappers: dict[str, Wrapper] = {}
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("host", "up", "bits", "texts", "ref")]
            joined = zip(batch.column("content").to_pylist(), batch.column("template").to_pylist(), strict=True) if told is None else [told.get(h) for h in columns[0]]
            for (host, *page), wrapper in zip(zip(*columns, strict=True), joined, strict=True):
                if told is None:
                    made = Wrapper(*wrapper) if wrapper[0] else None
                else:
                    if wrapper and wrapper[0] and host not in wrappers:
                        wrappers[host] = Wrapper(*wrapper)
                    made = wrappers.get(host)
                found.append(main_text(*page, made))
            keep = ["own", "page_id", "url"]
            new = [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, "text", "n_chars", "n_template"])

    return extract


def extract(aligned: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(own, page_id, url, text, n_chars, n_template): the main text of each aligned page, and how many template texts it left out."""
    schema = T.StructType([*aligned.schema.fields[:3], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_template", T.LongType())])
    size = wrappers.agg(F.sum(F.octet_length("host") + 4 * F.size("content") + 4 * F.size("template"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        sent = aligned.sparkSession.sparkContext.broadcast({r.host: (r.content, r.template) for r in wrappers.collect()})
        return aligned.mapInArrow(_extract(sent), schema)
    return aligned.join(wrappers.select("host", "content", "template"), "host", "left").mapInArrow(_extract(), schema)


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` without html, and with text, n_chars and n_template."""
    refs = references(pages, min_pages)
    aligned = stash(align_pages(pages, refs), "aligned")
    wrappers = stash(induce_wrappers(aligned, refs, min_pages), "wrappers")
    made = extract(aligned, wrappers)
    columns = [c for c in pages.columns if c.lower() != "html"]
    return unpack(made, columns, "page_id", "url", text=F.col("text"), n_chars=F.col("n_chars"), n_template=F.col("n_template"))


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return main_texts(pages).select("page_id", "url", "text", "n_chars")


SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(?:p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS h FROM a)
SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text,
       length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')))::BIGINT AS n_chars
FROM b
"""
