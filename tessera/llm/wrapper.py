"""Main text of web pages by wrapper induction.

All pages of a host are parsed into DOM trees and folded into one, its wrapper:
simple tree matching finds the largest order-preserving match of two trees, and
what a tree has beyond it is added to the wrapper, so that every layout of the
host is in it. Then each page is matched to the whole wrapper, and Spark counts
for each node its texts and their length. A node with the same text in most of
three or more pages is constant: template. The other nodes are slots, each with
the mean length of the text that it holds outside links. Pages of a host with
the same main text, and so copies, count once.

A page is matched to its host's wrapper. Its nodes that fall on constant nodes
with the same text are dropped. Its content is found by the slots: from the root
down, as long as one child holds ``SHARE`` of what the slots of a node hold on
average, and is no block of text itself. If that place lies in an article or main
element, this is the content; else headings that stand before it count with it.
Pages of hosts without a wrapper (fewer than three different pages, null urls)
go by markup: an article or main element where there is one, else the body.

Readers' comments go by structure. Articles inside an article are what others wrote
about it; of several articles beside each other the one with most text is the
content (by the wrapper's slots, if there is one), and others join it only if the
wrapper gives them half as much. An element whose entries, two or more of one tag,
each hold two or more short pieces (a name, a date, a picture, links) and a block of
text, and begin with no heading, is a list of comments or teasers if text of the
content stands before it: a single comment is not told apart from a paragraph.

Whatever the host, markup drops what it names as no part of an article: menus,
headers, footers, asides, forms, scripts, styles, hidden elements, and elements
with a class or id that is, as a whole word, one for adverts, notices, reader
comments and the like (an article too, unless it is the content); outside an article also those for bars, banners and
searches. Each block's text makes a line.

The trees of a host are folded in groups of about ``GROUP`` pages, dealt by the
hash of their main text, and the groups' trees are folded ``FAN`` at a time until
one is left. That holds shapes only, no texts. Wrappers of up to
``BROADCAST_BYTES`` in all, as measured, are broadcast to the
pages; beyond that, pages meet their host's wrapper in a join by host and salt, so
that a hot host is many groups.

Defined results: null and empty html give an empty text; unclosed, misnested
and cut-off markup is read as far as it goes; a br is white space inside its
block; elements may nest to any depth; repeated rows stay; further columns of the
input are not returned; an empty table gives an empty table.
"""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices

#: Pages of a host whose trees are folded in one task, and folded trees that are folded into one.
GROUP, FAN = 128, 16
#: Characters of wrappers, and matched pairs of shapes, that a task keeps at hand.
KEPT, KEPT_PAIRS = 4_000_000, 50_000
#: Groups that the pages of a host are dealt to when they meet its wrapper.
SALTS = 32
#: Up to which size of all wrappers together the pages stay where they are.
BROADCAST_BYTES = 8 << 20
#: Cells of a table of two child lists held at a time; longer lists are halved first.
CELLS = 2_000_000
#: What one child must hold of the slots below a node for the content to lie in it.
SHARE = 0.8
#: Characters of a short piece of a comment (a name, a date) at most.
SHORT = 40
# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form iframe object svg canvas audio video button select textarea dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
_LISTS, _ENTRIES = frozenset("div section ul ol main article".split()), frozenset("div li section article blockquote".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table tbody thead article section div body".split())
_WHOLE = frozenset("html body article main".split())
# Whole words of class and id: anywhere, and outside an article.
_NEVER = re.compile(
    r"(?<!\S)(?:ads?|advert\w*|(?:ad|ads|advert)[_-](?:\w|-)+|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?(?:[_-](?:\w|-)+)?|consent|notices?|popup|modal|newsletter(?:[_-](?:\w|-)+)?|subscribe|"
    r"comments?|comments?[_-](?:list|section|thread|area|form|box|body)|disqus(?:[_-](?:\w|-)+)?|respond|replies|share[_-]?(?:bar|buttons?|links?)|social[_-](?:share|links?|bar|buttons?)|"
    r"related[_-](?:posts?|articles?|links?|stories)|breadcrumbs?|pagination|pager)(?!\S)",
    re.IGNORECASE,
)
_OUTSIDE = re.compile(r"(?<!\S)(?:(?:main|site|page|top|left|right|side|global)[_-]?)?(?:banner|sidebar|widgets?|related|share|sharing|social|menu|nav|navbar|navigation|footer|header|masthead|toolbar|login|search)(?!\S)", re.IGNORECASE)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Comments, whole raw elements, tags (whether it ends, name, attributes), and other markup.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?i:(?P<raw>script|style|xmp|iframe|noembed|noframes))(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+>.*?(?:</(?i:(?P=raw))(?=[\s/>])[^>]*+>?|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)>|<[!?/][^>]*+>""",
    re.DOTALL,
)
_CUT_TAG = re.compile(r"<[A-Za-z/!?][^>]*\Z")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_ASKED = re.compile(r"class|id|role|hidden", re.IGNORECASE)


class Node:
    """An element: its tag, its children in order (elements and texts), the elements alone, whether markup drops it; what a wrapper says of it."""

    template, words, own, seen, mass, kind, named = False, 0, 0.0, 0, None, -1, False

    def __init__(self, tag: str, dropped: bool = False):
        self.tag, self.dropped, self.children, self.kids = tag, dropped, [], []

    def add(self, child: Node) -> None:
        self.children.append(child)
        self.kids.append(child)

    def own_text(self) -> str:
        return " ".join(" ".join([c for c in self.children if c.__class__ is str]).split())


def _hash(text: str) -> int:
    """A signed 64-bit hash of a text; 0 of none."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63) if text else 0


class _Builder:
    """The tree of a page: takes its tags and texts in their order."""

    def __init__(self):
        self.root = Node("#root")
        self.open, self.inside = [self.root], Counter()

    def close(self, tags, stops=frozenset()) -> None:
        """Ends the last open element of these tags, and what is open inside it, unless one of the stops is met before."""
        if any([self.inside[t] for t in tags]):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in tags:
                    for node in self.open[k:]:
                        self.inside[node.tag] -= 1
                    del self.open[k:]
                    return
                if self.open[k].tag in stops:
                    return

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self.close(("p",), _STOPS)
        elif tag in _CLOSED_BY:
            self.close(_CLOSED_BY[tag], _STOPS)
        dropped, beside = tag in DROPPED, False
        if dropped and tag == "header" and (self.inside["article"] or self.inside["main"]):
            dropped = False  # an article has a heading of its own
        if not dropped and attributes and _ASKED.search(attributes):
            a: dict[str, str] = {}
            for name, value in _ATTRIBUTE.findall(attributes):
                a.setdefault(name.lower(), references.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
            dropped = a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true"
            named = f"{a.get('class', '')} {a.get('id', '')}"
            if tag == "article":
                beside = bool(_NEVER.search(named))
            elif not dropped and tag not in _WHOLE and ("class" in a or "id" in a):
                dropped = bool(_NEVER.search(named)) or not (self.inside["article"] or self.inside["main"]) and bool(_OUTSIDE.search(named))
        node = Node(tag, dropped)
        if beside:
            node.named = True
        self.open[-1].add(node)
        if tag not in VOID and attributes[-1:] != "/":
            self.open.append(node)
            self.inside[tag] += 1


def parse(html: str) -> Node:
    builder, refers = _Builder(), "&" in html
    found = _TAG.split(html)
    found[-1] = _CUT_TAG.sub("", found[-1])  # a tag that the page ends within
    for at in range(0, len(found), 5):
        if text := found[at]:
            builder.open[-1].children.append(references.unescape(text) if refers and "&" in text else text)
        if at + 3 < len(found) and (tag := found[at + 3]):
            tag = tag.lower()
            if found[at + 2]:
                builder.close((tag,))
            else:
                builder.start(tag, found[at + 4].rstrip())
    return builder.root


def preorder(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        out.append(top := todo.pop())
        if top.kids:
            todo += top.kids[::-1]
    return out


class Kinds:
    """Numbers of trees by shape (tag and the shapes of the child elements), and the largest matchings of shapes, each found once."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.fixed: Node | None = None
        self.numbers: dict[tuple, int] = {}
        self.shapes: list[tuple] = []
        self.full: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def of(self, node: Node) -> int:
        for n in reversed(preorder(node)):  # children before their parents
            shape = (n.tag, *[c.kind for c in n.kids])
            n.kind = self.numbers.get(shape, -1)
            if n.kind < 0:
                n.kind = self.numbers[shape] = len(self.shapes)
                self.shapes.append(shape)
                self.full.append(1 + sum([self.full[k] for k in shape[1:]]))
        return node.kind

    def size(self, a: int, b: int) -> int:
        """Pairs of the largest matching of two shapes, whose sizes are found."""
        if a == b:
            return self.full[a]
        return self.sizes[a, b] if self.shapes[a][0] == self.shapes[b][0] else 0

    def aligned(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of the children of two shapes that the largest matching pairs; smaller shapes are matched before those that need them."""
        if a == b:
            return [(i, i) for i in range(len(self.shapes[a]) - 1)]
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.pairs:
                todo.pop()
                continue
            p, q = self.shapes[x][1:], self.shapes[y][1:]
            start, end = self._ends(p, q)
            p, q = set(p[start : len(p) - end]), set(q[start : len(q) - end])
            open_ = [(s, t) for s in p for t in q if s != t and (s, t) not in self.sizes and self.shapes[s][0] == self.shapes[t][0]]
            if open_:
                todo += open_
                continue
            todo.pop()
            p, q = self.shapes[x], self.shapes[y]
            self.pairs[x, y] = self._align(p[1:], q[1:])
            self.sizes[x, y] = 1 + sum([self.size(p[i + 1], q[j + 1]) for i, j in self.pairs[x, y]])
        return self.pairs[a, b]

    def _ends(self, p: tuple, q: tuple) -> tuple[int, int]:
        """Numbers of equal shapes at both starts and both ends, which are pairs of some largest matching."""
        start, end, most = 0, 0, min(len(p), len(q))
        while start < most and p[start] == q[start]:
            start += 1
        while end < most - start and p[-1 - end] == q[-1 - end]:
            end += 1
        return start, end

    def _align(self, p: tuple, q: tuple) -> list[tuple[int, int]]:
        start, end = self._ends(p, q)
        middle = self._order(p[start : len(p) - end], q[start : len(q) - end])
        return [*((k, k) for k in range(start)), *((start + i, start + j) for i, j in middle), *((len(p) - k, len(q) - k) for k in range(end, 0, -1))]

    def _order(self, p: tuple, q: tuple) -> list[tuple[int, int]]:
        if not p or not q:
            return []
        if len(p) > 1 and len(p) * len(q) > CELLS:
            half = len(p) // 2
            cut = int(np.argmax(np.add(self._rows(p[:half], q)[-1], self._rows(p[half:][::-1], q[::-1])[-1][::-1])))
            return [*self._order(p[:half], q[:cut]), *((half + i, cut + j) for i, j in self._order(p[half:], q[cut:]))]
        best, i, j, out = self._rows(p, q, keep=True), len(p), len(q), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def _rows(self, p: tuple, q: tuple, keep: bool = False) -> list:
        """The sizes of the largest matchings of the starts of p and q: all rows, or the last."""
        if len(p) * len(q) <= 64:
            rows = [[0] * (len(q) + 1)]
            for s in p:
                row, above = [0], rows[-1]
                for j, t in enumerate(q):
                    row.append(max(row[j], above[j + 1], above[j] + self.size(s, t)))
                rows.append(row)
            return rows
        kinds, at = np.unique(q, return_inverse=True)
        weights: dict[int, np.ndarray] = {}
        row = np.zeros(len(q) + 1, np.int64)
        rows = [row]
        for s in p:
            if s not in weights:
                if len(weights) * len(q) > CELLS:
                    weights.clear()
                weights[s] = np.array([self.size(s, int(t)) for t in kinds])[at]
            made = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[s]), out=made[1:])
            row = made
            if keep:
                rows.append(row)
        return rows if keep else [row]


def match(a: Node, b: Node, kinds: Kinds | None = None, fixed: bool = False) -> list[tuple[Node, Node]]:
    """Pairs of matched nodes of the largest simple tree matching: equal roots, children matched in order, at any length of the lists and any depth.

    Work is shared by shape: trees of one shape are compared once, as far as
    ``kinds`` reaches (``fixed``: b is the same, unchanged tree in all its calls); lists meet row by row in memory of ``CELLS`` cells.
    """
    kinds = kinds or Kinds()
    if len(kinds.pairs) > KEPT_PAIRS:
        kinds.clear()
    kinds.of(a)
    if not fixed or kinds.fixed is not b:
        kinds.of(b)
        kinds.fixed = b
    out, todo = [], [(a, b)] if a.tag == b.tag else []
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.kids and y.kids:
            p, q = x.kids, y.kids
            todo += zip(p, q) if x.kind == y.kind else [(p[i], q[j]) for i, j in kinds.aligned(x.kind, y.kind)]
    return out


def fold(wrapper: Node, tree: Node, kinds: Kinds | None = None) -> None:
    """Adds to the wrapper the nodes of a tree, which it takes over, that match none of its own."""
    kinds = kinds or Kinds()
    pairs = match(tree, wrapper, kinds, fixed=True)
    met = {id(y): x for y, x in pairs}
    if len(met) == len(preorder(tree)):
        return
    kinds.fixed = None  # the wrapper changes
    for y, x in pairs:
        fresh = y.kids
        if all([id(c) in met for c in fresh]):
            continue
        places, made, at = {id(c): k for k, c in enumerate(x.kids)}, [], 0
        for c in fresh:
            if id(c) in met:
                k = places[id(met[id(c)])] + 1
                made += x.kids[at:k]
                at = k
            else:
                made.append(c)
        x.kids = made + x.kids[at:]


def _dump(node: Node) -> str:
    """A tree without its texts: of each node, in preorder, the number of its child elements, tag, words, length of its text, and how often it was seen."""
    nodes = preorder(node)
    return json.dumps([[len(n.kids) for n in nodes], [n.tag for n in nodes], [n.words for n in nodes], [n.own for n in nodes], [n.seen for n in nodes]], separators=(",", ":"))


def _load(dumped: str) -> Node:
    counts, tags, *rest = json.loads(dumped)
    root, open_ = None, []
    for many, tag, words, own, seen in zip(counts, tags, *rest, strict=True):
        node = Node(tag)
        node.words, node.own, node.seen = words, own, seen
        if open_:
            open_[-1][0].kids.append(node)
            open_[-1][1] -= 1
        else:
            root = node
        open_.append([node, many])
        while open_ and not open_[-1][1]:
            open_.pop()
    return root


def measure(tree: Node) -> None:
    """Sets the hash of each node's own text, and its length as far as it can be content: outside links and what markup drops."""
    todo = [(tree, False)]
    while todo:
        node, out = todo.pop()
        out = out or node.dropped or node.tag == "a"
        if len(node.children) > len(node.kids):
            text = node.own_text()
            node.words, node.own = _hash(text), 0 if out else len(text)
        if node.kids:
            todo += [(c, out) for c in node.kids]


def weigh(tree: Node) -> None:
    """Sets what the slots of each subtree hold on average: own texts unless constant, and children as often as they were seen."""
    for node in reversed(preorder(tree)):
        many = max(1, node.seen)
        node.mass = (0.0 if node.words else node.own) + sum([c.mass * min(1.0, max(1, c.seen) / many) for c in node.kids])


class _Wrappers:
    """Loaded wrappers of a task, each with the shapes that were matched to it."""

    def __init__(self):
        self.known: dict[str, tuple[Node, Kinds, dict[int, int]]] = {}
        self.held = 0

    def __getitem__(self, made: str) -> tuple[Node, Kinds, dict[int, int]]:
        if made not in self.known:
            if self.held + len(made) > KEPT:
                self.known.clear()
                self.held = 0
            node = _load(made)
            weigh(node)
            self.known[made] = node, Kinds(), {id(n): k for k, n in enumerate(preorder(node))}
            self.held += len(made)
        return self.known[made]


def apply(tree: Node, wrapper: Node, kinds: Kinds | None = None) -> None:
    """Marks the nodes of a page that fall on constant nodes of its host's wrapper with the same text, and sets what each node's slots hold, by the wrapper where it has the node."""
    measure(tree)
    means = {id(x): y for x, y in match(tree, wrapper, kinds, fixed=True)}
    for node in reversed(preorder(tree)):
        if y := means.get(id(node)):
            node.template = y.words != 0 and y.words == node.words
            node.mass, node.own = y.mass, 0.0 if y.words else y.own
        else:
            node.mass = node.own + sum([c.mass for c in node.kids])


def _articles(tree: Node) -> list[Node]:
    """The outermost articles and main elements below a node."""
    found, todo = [], list(reversed([c for c in tree.kids if not c.dropped]))
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            found.append(node)
        else:
            todo += [c for c in reversed(node.kids) if not c.dropped]
    return found


def _length(tree: Node) -> int:
    """Characters of text outside links and what markup drops."""
    total, todo = 0, [tree]
    while todo:
        node = todo.pop()
        total += len(node.own_text())
        todo += [c for c in node.kids if not c.dropped and c.tag != "a"]
    return total


def _best(articles: list[Node], weighed: bool) -> list[Node]:
    """Of articles beside each other the one with most text; by a wrapper also those to which it gives half as much."""
    free = [a for a in articles if not a.named] or articles
    if len(free) < 2:
        return free
    if weighed and (most := max(a.mass for a in free)):
        return [a for a in free if a.mass >= most / 2]
    return [max(free, key=_length)]


def _entry(node: Node) -> bool:
    """Whether an element reads as a comment: two short pieces or more, no heading first, and a block of text."""
    pieces, blocks, todo = 0, bool(node.own_text()), list(reversed(node.kids))
    while todo:
        c = todo.pop()
        text = c.own_text()
        if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "dt", "th", "figcaption") and not pieces:
            return False
        if c.tag in ("p", "pre", "blockquote") or text and c.tag not in INLINE and len(text) > SHORT:
            blocks = True
        elif c.tag == "img" or text and len(text) <= SHORT:
            pieces += 1
        else:
            todo += reversed(c.kids)
    return pieces > 1 and blocks


def _without_comments(root: Node) -> None:
    """Drops lists of entries that text of the content stands before."""
    before, todo = False, [root]
    while todo:
        node = todo.pop()
        if node.dropped and node is not root:
            continue
        if node is not root and before and len(node.kids) > 1 and node.tag in _LISTS and not node.own_text():
            entries = [c for c in node.kids if not c.dropped and c.tag not in ("br", "hr", "p", "h1", "h2", "h3", "h4", "h5", "h6")]
            if len(entries) > 1 and entries[0].tag in _ENTRIES and all(c.tag == entries[0].tag for c in entries) and all(_entry(c) for c in entries):
                node.dropped = True
                continue
        before = before or node.tag not in INLINE and node.tag not in HEADINGS and bool(node.own_text())
        todo += reversed(node.kids)


def content(tree: Node) -> list[Node]:
    """Where the content of a page lies: by its slots if a wrapper was applied, else by markup; what it names or shows to be readers' comments is dropped."""
    roots, weighed = _places(tree), tree.mass is not None
    for root in roots:
        inner = _articles(root)
        for a in inner if root.tag == "article" else set(inner).difference(_best(inner, weighed)) if inner else ():
            a.dropped = True
        _without_comments(root)
    return roots


def _places(tree: Node) -> list[Node]:
    articles = _articles(tree)
    if not tree.mass:
        return _best(articles, False) or [tree]
    node, headings = tree, []
    while node.tag not in ("article", "main"):
        inside = [c for c in node.kids if not c.dropped and c.tag not in INLINE and c.mass]
        best = max(inside, key=lambda c: c.mass, default=None)
        if best is None or best.mass < SHARE * node.mass or best.own > best.mass / 2:
            break
        headings += [c for c in node.kids[: node.kids.index(best)] if c.tag in HEADINGS]
        node = best
    if node.tag in ("article", "main"):
        return [node]
    # Articles beside each other, none of which has nearly all.
    held = [a for a in _articles(node) if a.mass]
    if len(held) > 1 and sum(a.mass for a in held) >= SHARE * node.mass:
        return _best(held, True)
    return [*headings, node]


def main_text(tree: Node) -> str:
    """The lines of the blocks of the content."""
    lines, line = [], []

    def end() -> None:
        if line:
            if text := " ".join("".join(line).split()):
                lines.append(text)
            line.clear()

    for root in content(tree):
        todo: list[tuple[Node | str | None, bool]] = [(root, False)]
        while todo:
            node, template = todo.pop()
            if node is None:
                end()
            elif node.__class__ is str:
                if not template:
                    line.append(node)
            elif node.tag == "br":
                line.append(" ")
            elif not node.dropped or node is root:
                if node.tag not in INLINE:
                    end()
                    todo.append((None, False))
                if len(node.children) == 1 and node.children[0].__class__ is str:
                    if not node.template:
                        line.append(node.children[0])
                else:
                    todo += [(c, node.template) for c in reversed(node.children)]
    end()
    return "\n".join(lines)


def _meet(rows: DataFrame, made: DataFrame, turn: list[str], broadcast_bytes: int) -> DataFrame:
    """Rows with the wrapper of their host, null without one."""
    if (made.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0) <= broadcast_bytes:
        return rows.join(F.broadcast(made), "host", "left")
    spread = made.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*turn), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left").drop("salt")


def _folded(trees: DataFrame) -> DataFrame:
    """(host, wrapper) of rows (host, turn, wrapper): all trees of a host in one."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("turn", "ascending"), ("wrapper", "ascending")])
        kinds, made = Kinds(), None
        for dumped in rows.column("wrapper"):
            tree = _load(dumped.as_py())
            if made is None:
                made = tree
            else:
                fold(made, tree, kinds)
        for node in preorder(made):
            node.words = node.own = 0
        return pa.table({"host": rows.column("host")[:1].cast(pa.string()), "turn": rows.column("part")[:1], "wrapper": pa.array([_dump(made)], pa.string())})

    parts = max(1, -(-(trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0) // GROUP))
    part = F.pmod("turn", F.lit(parts))
    while True:
        trees = trees.withColumn("part", part.cast("long")).groupBy("host", "part").applyInArrow(run, "host string, turn long, wrapper string")
        if parts == 1:
            return trees.select("host", "wrapper")
        parts = -(-parts // FAN)
        part = F.floor(F.col("turn") / FAN)


def wrappers(pages: DataFrame, share: float = 0.8, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, wrapper) of the hosts with three or more different pages, from all their pages; pages has host and html."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            trees = [parse(t) for t in part.column("html").to_pylist()]
            turns = [_hash(main_text(t)) for t in trees]
            for t in trees:
                measure(t)
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(turns, pa.int64()), pa.array([_dump(t) for t in trees], pa.string())], ["host", "turn", "wrapper"])

    found = pages.filter("host IS NOT NULL AND html IS NOT NULL").select("host", "html").mapInArrow(shapes, "host string, turn long, wrapper string")
    # Pages with the same main text count once.
    trees = materialize(found.groupBy("host", "turn").agg(F.min("wrapper").alias("wrapper")))
    made = materialize(_folded(trees))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Wrappers()
        for part in slices(batches, "tree"):
            hosts, at, words, own = [], [], [], []
            for host, tree, wrapper in zip(part.column("host").to_pylist(), part.column("tree").to_pylist(), part.column("wrapper").to_pylist(), strict=True):
                node, kinds, number = known[wrapper]
                pairs = match(_load(tree), node, kinds, fixed=True)
                hosts += [host] * len(pairs)
                at += [number[id(y)] for _, y in pairs]
                words += [x.words for x, _ in pairs]
                own += [x.own for x, _ in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(at, pa.int32()), pa.array(words, pa.int64()), pa.array(own, pa.int64())], ["host", "at", "words", "own"])

    met = _meet(trees.withColumnRenamed("wrapper", "tree"), made, ["turn"], broadcast_bytes).select("host", "tree", "wrapper")
    counted = met.mapInArrow(places, "host string, at int, words long, own long").groupBy("host", "at", "words").agg(F.count("*").alias("n"), F.sum("own").alias("own"))
    nodes = counted.groupBy("host", "at").agg(F.sum("n").alias("seen"), F.sum("own").alias("own"), F.max(F.struct("n", "words")).alias("top"))
    constant = (F.col("seen") >= 3) & (F.col("top.n") >= share * F.col("seen"))
    node = F.struct("at", "seen", (F.col("own") / F.col("seen")).alias("own"), F.when(constant, F.col("top.words")).otherwise(F.lit(0)).alias("words"))
    # The root is the first node; a host of fewer than three different pages has no wrapper.
    told = nodes.groupBy("host").agg(F.collect_list(node).alias("nodes"), F.max("seen").alias("pages")).filter("pages >= 3")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wrapper, told in zip(batch.column("wrapper").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                tree = _load(wrapper)
                order = preorder(tree)
                for n in told:
                    x = order[n["at"]]
                    x.words, x.seen, x.own = n["words"], n["seen"], round(n["own"], 1)
                out.append(_dump(tree))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "wrapper"])

    return made.join(told, "host").select("host", "wrapper", "nodes").mapInArrow(filled, "host string, wrapper string")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html."""
    host = F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), F.nullif(host, F.lit("")).alias("host"))
    made = materialize(wrappers(rows, broadcast_bytes=broadcast_bytes))
    met = _meet(rows, made, ["page_id", "url"], broadcast_bytes).select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Wrappers()
        for part in slices(batches, "html"):
            texts = []
            for html, made in zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist(), strict=True):
                tree = parse(html or "")
                if made:
                    apply(tree, *known[made][:2])
                texts.append(main_text(tree))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")
