"""Main text of web pages by wrapper induction.

1. Each page becomes a DOM tree of the elements above its text blocks. A block is a leaf: its text, with whether
   all of it is link text or stands in inline elements marked as noise.
2. The trees of a host are aligned by simple tree matching (the order-preserving match of child lists that pairs
   most nodes) and merged: first within each task, then the tasks' trees of a host. Children with equal subtrees
   are paired first; between them, runs of one label fold into one repeated slot, and what is left is matched by
   the tables of simple tree matching. A merged node counts its pages, and those that agree on its text.
3. The wrapper of a host: nodes on ``SHARE`` of its pages with the same text are template; varying slots are
   content, but for slots of link text alone. Marks are evidence: a node inside a marked article is template only
   by ``MARKED_PAGES`` distinct pages and ``MARKED_SHARE``; labels of navigation, notices, adverts, forms and
   comments are template that may vary; where a page marks an article, its other slots are none of it.
4. Each page's blocks in content slots give its text, in page order.

Constancy shows nothing where pages are copies: a host of fewer than two distinct pages, or one whose constant text
outweighs half of its text, is judged by link slots and labels alone.

Scale: trees are merged before the shuffle, so a host of a third of all pages sends one small tree for each
task; nodes on fewer than a quarter of a tree's pages leave it, so a tree stays within four times a page's size.
Wrappers are broadcast while there are at most ``BROADCAST_HOSTS``, joined by host beyond; pages are never shuffled or
grouped. Nothing recurses, and parsing takes time in proportion to a page, however deep it is nested; child lists
whose table would pass ``TABLE`` cells are paired by label in order.

Defined cases: a null page is an empty one and gives empty text; tags need not be closed, and a tag cut off
by the page's end is dropped; an unknown or null url is the host ''; repeated rows are one distinct page; very long
pages are read whole.
"""

from __future__ import annotations

import bisect
import functools
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import Workspace

BROADCAST_HOSTS = 100_000
SHARE, MARKED_SHARE, LEAST_PAGES, MARKED_PAGES = 0.8, 0.95, 2, 10
KNOWN = 16  # digests of distinct pages that a tree remembers
TABLE = 4096  # cells of the largest matching table
SALTS = 64  # first groups of a host's trees, one tree from each task

#: Fixed values of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav",
    "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br",
}
CLOSES_P = BLOCK - {"br", "caption", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"} | {"li", "dd", "dt"}
SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ENDS = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
NOISE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "head", "svg", "object", "menu", "dialog"} | RAW
NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side|footer|header|masthead|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|"
    r"comments?|replies|disqus|share|sharing|social|related|recommend\w*|breadcrumbs?|newsletter|subscribe|popup|modal|widget|login|search|pagination)(?=$|[\s_-])"
)
CONTENT = {"article", "main"}
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|main|post-body|article-body|entry-content|post-content)(?=$|[\s_-])")

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z](?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*\Z",
    re.S,
)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")


def label(tag: str, attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return tag
    found = sorted((k.lower(), a or b or c) for k, a, b, c in ATTR.findall(attributes))
    return " ".join([tag, *(f"{k}={DIGITS.sub('#', v.strip().lower())}" for k, v in found)])


@functools.lru_cache(10_000)
def noise(name: str) -> bool:
    tag, _, rest = name.partition(" ")
    return tag in NOISE_TAGS or bool(rest) and any(NOISE_WORDS.search(x.partition("=")[2]) for x in rest.split(" ") if x)


@functools.lru_cache(10_000)
def content(name: str) -> bool:
    tag, _, rest = name.partition(" ")
    return tag in CONTENT or bool(rest) and any(CONTENT_WORDS.search(x.partition("=")[2]) for x in rest.split(" ") if x)


class Node:
    """Of a page or of merged pages. ``same`` pages of ``n`` have the subtree digest ``sig`` (0: none)."""

    __slots__ = ("chars", "kids", "label", "link", "n", "same", "sig")

    def __init__(self, label: str, n: int = 1, same: int = 1, sig: int = 0, chars: int = 0, link: int = 0) -> None:
        self.label, self.n, self.same, self.sig, self.chars, self.link = label, n, same, sig, chars, link
        self.kids: list[Node] = []

    def constant(self) -> bool:
        return self.n > 1 and self.sig != 0 and self.same >= SHARE * self.n


def _slot(above: int, name: str) -> int:
    """The path of labels from the root as a number."""
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), above)


def _digest(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) >> 1 or 1


class Page:
    """A parsed page: its text blocks in order and, if asked for, its tree.

    blocks: (text, slot, marked, noisy): the number of the leaf's path, whether it lies in a marked article, and
    whether a label on its path marks noise.
    """

    def __init__(self, page: str, with_tree: bool = False) -> None:
        self.blocks: list[tuple[str, int, bool, bool]] = []
        self.root = Node("")
        self.order = [self.root]  # nodes, parents first
        self.with_tree = with_tree
        # of each open element: tag, label, slot or -1, node, links, noise and marks so far
        self.tags: list[str] = []
        self.open: list[list] = []
        self.places: dict[str, list[int]] = {}  # of each tag among the open elements
        self.solid: list[int] = []  # places of block elements
        self.pieces: list[tuple[str, bool, bool]] = []  # text, in a link, in inline noise
        self._parse(page)

    def _flush(self) -> None:
        if not self.pieces:
            return
        said = [x for x in self.pieces if not x[0].isspace()]
        text = SPACE.sub(" ", html.unescape("".join(x[0] for x in self.pieces))).strip()
        self.pieces = []
        if not text:
            return
        link, odd = all(x[1] for x in said), all(x[2] for x in said)
        depth = self.solid[-1] + 1 if self.solid else 0
        slot, node = self._reach(depth)
        marked, noisy = (self.open[depth - 1][6] > 0, self.open[depth - 1][5] > 0) if depth else (False, False)
        kind = "#noise" if odd else "#link" if link else "#text"
        self.blocks.append((text, _slot(slot, kind), marked, noisy or odd))
        if self.with_tree:
            leaf = Node(kind, sig=_digest(text), chars=len(text), link=len(text) if link else 0)
            node.kids.append(leaf)
            self.order.append(leaf)

    def _reach(self, depth: int) -> tuple[int, Node]:
        """The slot and the node of the open element at ``depth``; elements get both when a block first needs them."""
        at = depth
        while at and self.open[at - 1][2] == -1:
            at -= 1
        slot, node = (self.open[at - 1][2], self.open[at - 1][3]) if at else (0, self.root)
        for e in self.open[at:depth]:
            slot = _slot(slot, e[1])
            if self.with_tree:
                below = Node(e[1])
                node.kids.append(below)
                self.order.append(below)
                node = below
            e[2], e[3] = slot, node
        return slot, node

    def _push(self, tag: str, attributes: str) -> None:
        name = label(tag, attributes)
        links, odd, marks = self.open[-1][4:] if self.open else (0, 0, 0)
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCK:
            self.solid.append(len(self.tags))
        self.tags.append(tag)
        self.open.append([tag, name, -1, None, links + (tag == "a"), odd + noise(name), marks + content(name)])

    def _cut(self, n: int) -> None:
        """Close all elements from place ``n`` on."""
        for tag in self.tags[n:]:
            self.places[tag].pop()
        while self.solid and self.solid[-1] >= n:
            self.solid.pop()
        del self.tags[n:], self.open[n:]

    def _pop(self, n: int) -> None:
        self._flush()
        self._cut(n)

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _parse(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = MARKUP.search(page, at)
            stop = m.start() if m else end
            if stop > at:
                top = self.open[-1] if self.open else None
                outer = self.open[self.solid[-1]][5] if self.solid else 0
                self.pieces.append((page[at:stop], bool(top and top[4]), bool(top and top[5] > outer)))
            if not m:
                break
            at = m.end()
            closing, name, attributes = m.groups()
            if name is None:
                continue
            tag = name.lower()
            if closing:
                if (n := self._last((tag,))) >= 0:
                    if (self.solid and self.solid[-1] >= n) or tag in RAW:
                        self._pop(n)
                    else:
                        self._cut(n)
                continue
            if tag in BLOCK:
                self._flush()
                if tag in CLOSES_P and (n := self._last(("p",))) >= 0:
                    self._pop(n)
                if tag in SAME:
                    n = self._last(ENDS.get(tag, (tag,)))
                    if n > self._last(SAME[tag]):
                        self._pop(n)
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                close = _closing(tag).search(page, at)
                at = close.end() if close else end
                continue
            self._push(tag, attributes)
        self._flush()

    def tree(self) -> Node:
        for node in reversed(self.order):  # children before parents
            if node.kids:
                node.sig = _digest("|".join(f"{k.label}:{k.sig}" for k in node.kids))
                node.chars, node.link = sum(k.chars for k in node.kids), sum(k.link for k in node.kids)
        return self.root


@functools.lru_cache(64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def weights(a: Node, b: Node) -> dict[tuple[int, int], int]:
    """Simple tree matching by (id, id) of every pair of nodes it needs: the number of pairs of nodes in the best
    order-preserving match of the two subtrees, whose roots have one label."""
    known: dict[tuple[int, int], int] = {}
    stack = [(a, b, False)]
    while stack:
        u, v, ready = stack.pop()
        if (id(u), id(v)) in known:
            continue
        x, y = u.kids, v.kids
        if len(x) * len(y) > TABLE:  # labels that both have, in number
            left: dict[str, int] = {}
            for k in x:
                left[k.label] = left.get(k.label, 0) + 1
            both = 0
            for k in y:
                if left.get(k.label, 0):
                    left[k.label] -= 1
                    both += 1
            known[id(u), id(v)] = 1 + both
        elif ready:
            known[id(u), id(v)] = 1 + _table(x, y, known)[-1][-1]
        else:
            stack.append((u, v, True))
            stack += [(p, q, False) for p in x for q in y if p.label == q.label]
    return known


def _table(x: list[Node], y: list[Node], known: dict) -> list[list[int]]:
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, u in enumerate(x, 1):
        for j, v in enumerate(y, 1):
            t[i][j] = max(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1] + known[id(u), id(v)] if u.label == v.label else 0)
    return t


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the pairs, ordered by the first, in which the second increases too."""
    ends: list[int] = []
    chain: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(ends, j)
        back[k] = chain[at - 1] if at else -1
        if at == len(ends):
            ends.append(j)
            chain.append(k)
        else:
            ends[at], chain[at] = j, k
    out, k = [], chain[-1] if chain else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _once(kids: list[Node], key) -> dict:
    out: dict = {}
    for i, k in enumerate(kids):
        if (w := key(k)) is not None:
            out[w] = -1 if w in out else i
    return out


def _folded(kids: list[Node], tasks: list) -> list[Node]:
    """Neighbours of one label as one slot, but for nodes that have been constant so far."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].label == k.label and not k.constant() and not out[-1].constant():
            tasks.append((out[-1], k, True))
        else:
            out.append(k)
    return out


def _matched(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: pairs of places, in order."""
    if [k.label for k in x] == [k.label for k in y]:
        return [(i, i) for i in range(len(x))]
    if len(x) * len(y) > TABLE:
        nth: dict[str, int] = {}
        places: dict[tuple[str, int], int] = {}
        for j, k in enumerate(y):
            places[k.label, nth.setdefault(k.label, 0)] = j
            nth[k.label] += 1
        nth, pairs = {}, []
        for i, k in enumerate(x):
            if (j := places.get((k.label, nth.setdefault(k.label, 0)))) is not None:
                pairs.append((i, j))
            nth[k.label] += 1
        return _increasing(pairs)
    known: dict = {}
    for u in x:
        for v in y:
            if u.label == v.label:
                # of equal matches, a slot that varies is preferred to a constant node of another text
                known[id(u), id(v)] = 2 * weights(u, v)[id(u), id(v)] - (u.sig != v.sig and (u.constant() or v.constant()))
    t, i, j, out = _table(x, y, known), len(x), len(y), []
    while i and j:
        u, v = x[i - 1], y[j - 1]
        if u.label == v.label and t[i][j] == t[i - 1][j - 1] + known[id(u), id(v)]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif t[i][j] == t[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _joined(x: list[Node], y: list[Node], fold: bool, tasks: list) -> list[Node]:
    """The aligned children of two nodes; those without a partner stay, in order. tasks: merges to be done, in order."""
    if not x or not y:
        return x or y
    if len(x) == len(y) == 1 and x[0].label == y[0].label:
        tasks.append((x[0], y[0], fold))
        return x
    key = lambda k: (k.label, k.sig) if k.sig else None
    first, second = _once(x, key), _once(y, key)
    equal = _increasing(sorted((i, second[w]) for w, i in first.items() if i >= 0 and second.get(w, -1) >= 0))
    out: list[Node] = []
    at = (0, 0)
    for i, j in [*equal, (len(x), len(y))]:
        left, right = _folded(x[at[0] : i], tasks), _folded(y[at[1] : j], tasks)
        a = b = 0
        for p, q in [*(_matched(left, right) if left and right else ()), (len(left), len(right))]:
            out += left[a:p] + right[b:q]
            if p < len(left):
                out.append(left[p])
                tasks.append((left[p], right[q], fold))
            a, b = p + 1, q + 1
        if i < len(x):
            out.append(x[i])
            tasks.append((x[i], y[j], fold))
        at = i + 1, j + 1
    return out


def merge(a: Node, b: Node) -> Node:
    """The aligned tree of both, made of their nodes. A merge that folds joins slots of one page."""
    stack = [(a, b, False)]
    while stack:
        u, v, fold = stack.pop()
        u.chars += v.chars
        u.link += v.link
        if fold:
            u.n = max(u.n, v.n)
            u.same = max(u.same, v.same)
            if u.sig != v.sig:
                u.sig = 0
        else:
            u.n += v.n
            if u.sig == v.sig:
                u.same += v.same
            elif v.same > u.same:
                u.sig, u.same = v.sig, v.same
        tasks: list = []
        u.kids = _joined(u.kids, v.kids, fold, tasks)
        stack += reversed(tasks)
    return a


def prune(root: Node, share: float = 0.25) -> None:
    """Nodes on too few of the pages leave the tree."""
    if root.n < 8:
        return
    stack = [root]
    while stack:
        node = stack.pop()
        node.kids = [k for k in node.kids if k.n >= share * root.n]
        stack += node.kids


class Tree:
    """The merged tree of a host's pages, and digests of distinct ones."""

    def __init__(self) -> None:
        self.root: Node | None = None
        self.pages: list[int] = []

    def add(self, root: Node, pages: list[int]) -> None:
        self.root = root if self.root is None else merge(self.root, root)
        self.pages = sorted({*self.pages, *pages})[:KNOWN]
        if self.root.n % 64 == 0 or len(pages) > 1:
            prune(self.root)

    def dumps(self) -> str:
        prune(self.root)
        flat, stack = [], [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            flat.append([depth, node.label, node.n, node.same, node.sig, node.chars, node.link])
            stack += [(k, depth + 1) for k in reversed(node.kids)]
        return json.dumps([self.pages, flat])

    @staticmethod
    def loads(text: str) -> tuple[Node, list[int]]:
        pages, flat = json.loads(text)
        path: list[Node] = []
        for depth, *values in flat:
            node = Node(*values)
            del path[depth:]
            if path:
                path[-1].kids.append(node)
            path.append(node)
        return path[0], pages

    def template(self) -> list[int]:
        """Slots and texts that are no content: (slot, text) of constant leaves, slots of link text alone, labelled slots."""
        out, constant, text, total = [], [], 0, self.root.n
        if len(self.pages) < LEAST_PAGES:
            return out
        stack = [(self.root, 0, False, False)]
        mass = 0
        while stack:
            node, slot, marked, noisy = stack.pop()
            for k in node.kids:
                here = _slot(slot, k.label)
                if k.label[:1] != "#":
                    stack.append((k, here, marked or content(k.label), noisy or noise(k.label)))
                    continue
                if noisy or k.label == "#noise":
                    out.append(_signed(here))
                    continue
                mass += k.chars
                if k.label == "#link" and not marked:
                    out.append(_signed(here))
                elif k.sig and k.same >= (MARKED_SHARE if marked else SHARE) * total and (not marked or len(self.pages) >= MARKED_PAGES):
                    constant.append(_signed(_digest(str(k.sig), here)))
                    text += k.chars * k.same // k.n
        return out + constant if 2 * text <= mass else out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def main_text(page: str, template: set[int]) -> str:
    """template: as of ``Tree.template``."""
    found = Page(page).blocks
    kept, marks = [], False
    for text, slot, marked, noisy in found:
        # labels alone decide where the host's wrapper does not know the slot
        if noisy or template and (_signed(slot) in template or _signed(_digest(str(_digest(text)), slot)) in template):
            continue
        marks |= marked
        kept.append((text, marked))
    return "\n".join(text for text, marked in kept if marked or not marks)


def host(column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(column, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> host, template (numbers of what is left out)."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Tree] = {}
        seen: set[tuple[str, int]] = set()  # 8 bytes of each distinct page of the task

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([t.dumps() for t in by.values()], pa.string())], names=["host", "tree"])
            by.clear()
            return batch

        for batch in batches:
            for name, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                root = Page(page or "", with_tree=True).tree()
                if (name, root.sig) not in seen:
                    seen.add((name, root.sig))
                    by.setdefault(name, Tree()).add(root, [root.sig])
                if len(by) >= 20_000:
                    yield emit()
        yield emit()

    def fold(table: pa.Table) -> Tree:
        whole = Tree()
        for row in table["tree"].to_pylist():
            whole.add(*Tree.loads(row))
        return whole

    def some(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "tree": pa.array([fold(table).dumps()], pa.string())})

    def last(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "template": pa.array([fold(table).template()], pa.list_(pa.int64()))})

    trees = pages.mapInArrow(induce, "host string, tree string")
    parts = trees.groupBy("host", F.pmod(F.xxhash64("tree"), F.lit(SALTS)).alias("salt")).applyInArrow(some, "host string, tree string")
    return parts.groupBy("host").applyInArrow(last, "host string, template array<long>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    work = Workspace(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    learned = work.cut(wrappers(source.select("host", "html")).where(F.size("template") > 0))
    few = learned.count() <= BROADCAST_HOSTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                text = [main_text(p or "", {*(t or ())}) for p, t in zip(part["html"].to_pylist(), part["template"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    kind = source.schema["page_id"].dataType.simpleString()
    joined = source.join(F.broadcast(learned) if few else learned, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op5_extract(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._common import read

    return extract(read(spark, sf_dir, "pages"))
