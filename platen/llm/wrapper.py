"""Main text of web pages by wrapper induction over the pages of a host.

Pages become DOM trees (implied end tags, void and raw-text elements, broken
nesting). Elements whose tag or role is that of a menu, header, footer, sidebar, notice,
advert, form or comment go first, and so do those that a class or id names as such, unless they
hold a first or second heading or the article itself.

Each page's tree is folded: inline elements are text of their block, and neighbours of one label
(tag, class and id) are one node, whose children are aligned. The trees of a host, each
distinct one once with the number of its pages, are then merged by simple tree matching:
of two nodes of equal label the children are paired in order so that most nodes match, and
what has no partner stands beside the others. Merging goes in rounds of at most GROUP trees,
so a hot host is no hot task. Every page of the host is aligned with the merged tree by the
same matching, and Spark counts, over all pages with distinct texts, how many show a text
at a node. A text is template where at least SUPPORT of the pages that have the node show
it, and MIN_PAGES at least; the rest of a node is a slot. On every page the template's texts
go, inside `article` and `main` too, and what the slots hold is content. Texts are
compared by 128 bits of BLAKE2b.

`article` and `main` are a hint among the slots: where they hold at least half of what is
left, they alone are content.

Defined cases: null and empty html give an empty text, and so does a page that shows
nothing but its template; a null url counts as one host of its own; a host with fewer than MIN_PAGES
distinct pages has no wrapper; repeated rows
give repeated rows; a null page_id stays null; an empty table gives no rows; a column named like
an output is read only under its own meaning. `br` is white space in its block.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import sys
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.tables import dropped, salted, spread, stored

SUPPORT = 0.8  # a text is template where this share of a host's pages that have its node show it there,
MIN_PAGES = 3  # and so many pages at least
GROUP = 64  # trees that a task merges in a round
TABLE_CELLS = 1 << 22  # of a matching that is kept whole; longer lists are halved first, with the same result
BROADCAST_BYTES = 32 << 20  # wrappers that are joined by broadcast

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"]),
    "tbody": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), "thead": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), "tfoot": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]),
}
SCOPES = frozenset("ul ol dl table body html article section div main aside nav header footer form blockquote td th".split())
CUT_TAGS = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg dialog menu object canvas audio video noframes title".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
CUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related recommended replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split())
#: Words that say what kind of box it is, not what stands in it: "related-posts" is named by "related".
BOX_WORDS = frozenset("area articles bar block body bottom box button buttons col column container content count feed form group head icons inner item items left link links list main outer page panel post posts right row section site slot stories text thread title top unit wrap wrapper".split())
SLOT_TAGS = frozenset(["article", "main"])

#: A tag ends outside its quotes, or at the first bracket if they don't close.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>", re.S)
_OPEN = re.compile(r"<[/!?A-Za-z]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "name", "children", "cut")

    def __init__(self, tag: str, name: str = "", cut: int = 0) -> None:
        self.tag, self.name, self.cut = tag, name, cut
        self.children: list[Node | str] = []


def _names_a_cut(token: str) -> bool:
    """Whether the word that a class or id is about, its last one but for box words, is a cut word."""
    words = [w.lower() for w in _WORDS.findall(token)]
    while len(words) > 1 and words[-1] in BOX_WORDS:
        words.pop()
    return bool(words) and words[-1] in CUT_WORDS


@lru_cache(maxsize=4096)
def _attributes(tag: str, source: str) -> tuple[str, int]:
    """The label's attribute part, and whether the element is no content: 2, or 1 by its name alone."""
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}
    role = values.get("role", "").lower()
    cut = 2 * (tag in CUT_TAGS or role in CUT_ROLES or "hidden" in values or values.get("aria-hidden") == "true")
    if not cut and tag not in ("html", "body"):
        cut = int(any(_names_a_cut(t) for k in ("class", "id") for t in values.get(k, "").split()))
    name = re.sub(r"\d+", "", values.get("class", "") + "#" + values.get("id", ""))
    return ("main" if role == "main" else "") + re.sub(r"\s+", "_", name), cut


def parse(source: str) -> Node:
    """The DOM tree; text is decoded, white space is as written."""
    root = Node("#root")
    stack = [root]
    at, end = 0, len(source)
    last = source.rfind(">") + 1
    while at < end:
        m = _TOKEN.search(source, at, last) if at < last else None
        text = source[at : m.start()] if m else source[at:]
        if not m and (broken := _OPEN.search(text)):  # a tag that never ends
            text = text[: broken.start()]
        if text:
            stack[-1].children.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break
        if m[1]:
            stack[-1].children.append(m[1])
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "body", "main", "table") and tag in INLINE:
                    break
            continue
        if tag in CLOSES or tag not in INLINE:
            closes = CLOSES.get(tag, frozenset(["p"]))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        name, cut = _attributes(tag, m[4])
        if tag == "header":  # of a page; the title of an article stays
            cut = cut if any(n.tag in SLOT_TAGS for n in stack) else 2
        node = Node(tag, name, cut)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            node.children.append(source[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            stack.append(node)
    return root


def _holds_content(node: Node) -> bool:
    pending = [c for c in node.children if not isinstance(c, str)]
    while pending:
        x = pending.pop()
        if x.cut < 2:
            if x.tag in ("h1", "h2", "article", "main"):
                return True
            pending += [c for c in x.children if not isinstance(c, str)]
    return False


def _pruned(root: Node) -> Node:
    pending = [root]
    while pending:
        node = pending.pop()
        # An article that is named a comment or an advert is one, whatever it holds.
        node.children = [c for c in node.children if isinstance(c, str) or not c.cut or (c.cut == 1 and c.tag not in SLOT_TAGS and _holds_content(c))]
        pending += [c for c in node.children if not isinstance(c, str)]
    return root


def slots(root: Node) -> list[Node]:
    """The outermost article and main elements, in page order."""
    out, pending = [], [root]
    while pending:
        node = pending.pop()
        if node.tag in SLOT_TAGS or node.name.startswith("main"):
            out.append(node)
        else:
            pending += [c for c in reversed(node.children) if not isinstance(c, str)]
    if any(n.tag == "main" or n.name.startswith("main") for n in out):
        inner = [a for n in out for a in ([n] if n.tag == "article" else _articles(n))]
        return inner or out
    return out


def _articles(node: Node) -> list[Node]:
    out, pending = [], [c for c in reversed(node.children) if not isinstance(c, str)]
    while pending:
        x = pending.pop()
        if x.tag == "article":
            out.append(x)
        else:
            pending += [c for c in reversed(x.children) if not isinstance(c, str)]
    return out


class Tree:
    """A node of a folded page or of merged pages; leaves are places of texts of the page."""

    __slots__ = ("label", "kids", "pages", "leaves")

    def __init__(self, label: str, pages: int = 1) -> None:
        self.label, self.pages = label, pages
        self.kids: list[Tree] = []
        self.leaves: list[int] = []


class Matching:
    """Simple tree matching. Equal subtrees have one number, so equal pairs are matched once."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.known: dict[tuple, list[tuple[int, int]]] = {}

    def number(self, tree: Tree) -> int:
        kids = tuple([self.number(k) for k in tree.kids])
        n = self.numbers.setdefault((tree.label, kids), len(self.labels))
        if n == len(self.labels):
            self.labels.append(tree.label)
            self.kids.append(kids)
        return n

    def weight(self, a: int, b: int) -> int:
        """Nodes that match in two subtrees whose roots do; 0 if these differ."""
        if self.labels[a] != self.labels[b]:
            return 0
        if (a, b) not in self.weights:
            self.weights[a, b] = 1 + (self._scores(self.kids[a], self.kids[b])[-1][-1] if self.kids[a] and self.kids[b] else 0)
        return self.weights[a, b]

    def _scores(self, xs: tuple[int, ...], ys: tuple[int, ...], whole: bool = False) -> list:
        """The best weights of beginnings of xs and ys: the last row, or all of them."""
        kinds, place = np.unique(np.array(ys), return_inverse=True)
        kinds = kinds.tolist()
        rows = [np.zeros(len(ys) + 1, np.int64)]
        of_kind: dict[int, np.ndarray] = {}
        for x in xs:
            if x not in of_kind:
                of_kind[x] = np.array([self.weight(x, y) for y in kinds], np.int64)[place]
            row = np.zeros(len(ys) + 1, np.int64)
            # Without a partner the weight is 0: nothing is won by such a pair.
            np.maximum.accumulate(np.maximum(rows[-1][1:], rows[-1][:-1] + of_kind[x]), out=row[1:])
            if not whole:
                rows.clear()
            rows.append(row)
        return rows

    def pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The places of the ordered pairs of greatest weight."""
        if xs == ys:
            return [(i, i) for i in range(len(xs))]
        if not xs or not ys:
            return []
        if (xs, ys) not in self.known:
            self.known[xs, ys] = self._halved(xs, ys) if len(xs) > 1 and len(xs) * len(ys) > TABLE_CELLS else self._traced(xs, ys)
        return self.known[xs, ys]

    def _traced(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        rows, out, i, j = self._scores(xs, ys, whole=True), [], len(xs), len(ys)
        while i and j:
            won = self.weight(xs[i - 1], ys[j - 1])
            if won and rows[i][j] == rows[i - 1][j - 1] + won:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    def _halved(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        mid = len(xs) // 2
        first, second = self._scores(xs[:mid], ys)[-1], self._scores(xs[:mid - 1 : -1], ys[::-1])[-1]
        cut = int((first + second[::-1]).argmax())
        return self.pairs(xs[:mid], ys[:cut]) + [(i + mid, j + cut) for i, j in self.pairs(xs[mid:], ys[cut:])]

    def merge(self, a: Tree, b: Tree, pages: int) -> None:
        """Put b, of the same label, into a. pages: what b adds to the pages of a node that both have."""
        a.pages += pages and b.pages
        a.leaves += b.leaves
        pairs = self.pairs(tuple([self.number(k) for k in a.kids]), tuple([self.number(k) for k in b.kids]))
        kids, at, other = [], 0, 0
        for i, j in [*pairs, (len(a.kids), len(b.kids))]:
            kids += [*a.kids[at:i], *b.kids[other:j]]
            if i < len(a.kids):
                self.merge(a.kids[i], b.kids[j], pages)
                kids.append(a.kids[i])
            at, other = i + 1, j + 1
        a.kids = kids

    def align(self, a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
        """All pairs of matched nodes of two trees of one label."""
        out, pending = [], [(a, b)]
        while pending:
            x, y = pending.pop()
            out.append((x, y))
            pairs = self.pairs(tuple([self.number(k) for k in x.kids]), tuple([self.number(k) for k in y.kids]))
            pending += [(x.kids[i], y.kids[j]) for i, j in pairs]
        return out


def _deep() -> None:
    """Trees may be as deep as a page has tags; calls of Python functions take no C stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 20))


def folded(root: Node) -> tuple[Tree, list[tuple[str, bool]]]:
    """The folded tree, and the block texts in page order, each with whether it lies in an article or main."""
    _deep()
    texts: list[tuple[str, bool]] = []
    inner = {id(n) for n in slots(root)}
    matching = Matching()

    def close(held: list[str], inside: bool, out: list[Tree]) -> None:
        if text := " ".join("".join(held).split()):
            add(Tree("#text"), out)
            out[-1].leaves.append(len(texts))
            texts.append((text, inside))
        held.clear()

    def add(tree: Tree, out: list[Tree]) -> None:
        if out and out[-1].label == tree.label:
            matching.merge(out[-1], tree, 0)
        else:
            out.append(tree)

    def read(node: Node, inside: bool, held: list[str], out: list[Tree]) -> None:
        for c in node.children:
            if isinstance(c, str):
                held.append(c)
            elif c.tag == "br":
                held.append(" ")
            elif c.tag in INLINE:
                read(c, inside, held, out)
            else:
                close(held, inside, out)
                tree, of_c = Tree(f"{c.tag}.{c.name}"), inside or id(c) in inner
                read(c, of_c, held, tree.kids)
                close(held, of_c, tree.kids)
                if tree.kids:
                    add(tree, out)

    top, held = Tree("#root"), []
    read(root, id(root) in inner, held, top.kids)
    close(held, id(root) in inner, top.kids)
    return top, texts


def _nodes(tree: Tree) -> list[tuple[int, Tree]]:
    """(depth, node), parents first."""
    out, pending = [], [(0, tree)]
    while pending:
        depth, node = pending.pop()
        out.append((depth, node))
        pending += [(depth + 1, k) for k in reversed(node.kids)]
    return out


def written(tree: Tree) -> str:
    return "\n".join(f"{depth} {node.pages} {node.label}" for depth, node in _nodes(tree))


def read_tree(source: str) -> Tree:
    stack: list[Tree] = []
    for line in source.split("\n"):
        depth, pages, label = line.split(" ", 2)
        node = Tree(label, int(pages))
        del stack[int(depth) :]
        if stack:
            stack[-1].kids.append(node)
        stack.append(node)
    return stack[0]


def merged(trees: list[tuple[str, int]]) -> str:
    """One tree of (written tree, times): those of most pages first."""
    _deep()
    matching, out = Matching(), None
    for source, times in sorted(trees, key=lambda t: (-t[1], t[0])):
        tree = read_tree(source)
        for _, node in _nodes(tree):
            node.pages *= times
        if out is None:
            out = tree
        else:
            matching.merge(out, tree, 1)
    return written(out)


@lru_cache(maxsize=512)
def frequent(source: str) -> str:
    """The tree without nodes of fewer than MIN_PAGES pages."""
    tree = read_tree(source)
    for _, node in _nodes(tree):
        node.kids = [k for k in node.kids if k.pages >= MIN_PAGES]
    return written(tree)


@lru_cache(maxsize=4096)
def _aligned(template: str, skeleton: str) -> dict[int, int]:
    """Numbers of a template's nodes by those of a page's nodes."""
    _deep()
    a, b = read_tree(template), read_tree(skeleton)
    of_a = {id(n): k for k, (_, n) in enumerate(_nodes(a))}
    of_b = {id(n): k for k, (_, n) in enumerate(_nodes(b))}
    return {of_b[id(y)]: of_a[id(x)] for x, y in Matching().align(a, b)}


def _items(tree: Tree, texts: list[tuple[str, bool]]) -> list[tuple[int, bytes, int]]:
    """(node, print, place) of the texts: a print is of the text and its number among equal ones of the node."""
    out = []
    for k, (_, node) in enumerate(_nodes(tree)):
        times: Counter = Counter()
        for place in node.leaves:
            text = texts[place][0]
            out.append((k, hashlib.blake2b(f"{times[text]} {text}".encode(), digest_size=16).digest(), place))
            times[text] += 1
    return out


def page_items(source: str) -> tuple[str, list[int], list[bytes], bytes]:
    """The written tree of a page, the nodes and prints of its texts, and a print of all of them."""
    tree, texts = folded(_pruned(parse(source)))
    items = _items(tree, texts)
    whole = hashlib.blake2b("\n".join(t for t, _ in texts).encode(), digest_size=16).digest()
    return written(tree), [k for k, _, _ in items], [p for _, p, _ in items], whole


def induce(pages: list[str]) -> tuple[str, frozenset] | None:
    """The wrapper of pages of one host: its tree and the (node, print) pairs of its texts. wrappers() does the same in Spark."""
    read = {whole: (tree, nodes, prints) for tree, nodes, prints, whole in map(page_items, pages) if nodes}
    if len(read) < MIN_PAGES:
        return None
    template = frequent(merged(list(Counter(tree for tree, _, _ in read.values()).items())))
    seen: Counter = Counter()
    having: Counter = Counter()
    for tree, nodes, prints in read.values():
        at = _aligned(template, tree)
        pairs = {(at[k], p) for k, p in zip(nodes, prints, strict=True) if k in at}
        seen.update(pairs)
        having.update({k for k, _ in pairs})
    return template, frozenset(k for k, n in seen.items() if n >= MIN_PAGES and n >= SUPPORT * having[k[0]])


def main_text(source: str | None, wrapper: tuple[str, frozenset] | None = None) -> str:
    if not source:
        return ""
    tree, texts = folded(_pruned(parse(source)))
    gone = set()
    if wrapper:
        at = _aligned(wrapper[0], written(tree))
        gone = {place for k, p, place in _items(tree, texts) if k in at and (at[k], p) in wrapper[1]}
    left = [t for place, t in enumerate(texts) if place not in gone]
    inner = [t for t, inside in left if inside]
    return "\n".join(inner if 2 * sum(map(len, inner)) >= sum(len(t) for t, _ in left) else [t for t, _ in left])


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def _templates(pages: DataFrame) -> DataFrame:
    """(host, template) from (host, tree) of distinct pages."""
    spark = pages.sparkSession
    trees = pages.groupBy("host", "tree").agg(F.count("*").alias("times"))

    def merge(key, table):
        tree = merged(list(zip(table.column("tree").to_pylist(), table.column("times").to_pylist(), strict=True)))
        return pa.table({"host": [key[0].as_py()], "tree": [tree], "times": pa.array([1], pa.int64())})

    old = None
    while True:
        sized = trees.join(F.broadcast(sizes) if (sizes := trees.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("groups"))).count() <= 100_000 else sizes, "host")
        dealt = sized.withColumn("part", F.pmod(F.xxhash64("tree"), F.col("groups")))
        trees, path = stored(dealt.groupBy("host", "part").applyInArrow(merge, "host string, tree string, times long"), "trees")
        if old:
            dropped(spark, old)
        old = path
        if trees.groupBy("host").count().filter("count > 1").isEmpty():
            return trees.select("host", F.col("tree").alias("template"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, texts) of each host with enough distinct pages; texts holds a node number and a print for each."""

    def read(batches):
        for batch in batches:
            found = [page_items(h) for h in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["host", "tree", "nodes", "prints", "whole"])

    full = pages.filter("length(html) > 0").select(_host(F.col("url")).alias("host"), "html")
    parsed = full.mapInArrow(read, "host string, tree string, nodes array<int>, prints array<binary>, whole binary").filter("size(nodes) > 0")
    # Of pages with equal texts one counts.
    distinct, path = stored(parsed.dropDuplicates(["host", "whole"]), "page-items")
    enough = distinct.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= MIN_PAGES).select("host")
    known, known_path = stored(_templates(distinct.join(enough, "host", "left_semi").select("host", "tree")), "templates")

    def place(batches):
        for batch in batches:
            rows = [([], [])]
            for tree, nodes, prints, template in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                at = _aligned(frequent(template), tree)
                pairs = {(at[k], p) for k, p in zip(nodes, prints, strict=True) if k in at}
                rows.append(([k for k, _ in pairs], [p for _, p in pairs]))
            columns = [pa.array([r[k] for r in rows[1:]], kind) for k, kind in enumerate((pa.list_(pa.int32()), pa.list_(pa.binary())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["host", "nodes", "prints"])

    placed, placed_path = stored(_with_host(distinct, known, "whole").filter("template is not null").select("host", "tree", "nodes", "prints", "template").mapInArrow(place, "host string, nodes array<int>, prints array<binary>"), "placed")
    # Both counts are made in the tasks first, so a hot host is no hot task.
    having = placed.select("host", F.explode(F.array_distinct("nodes")).alias("node")).groupBy("host", "node").agg(F.count("*").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    items = placed.select("host", F.explode(F.arrays_zip("nodes", "prints")).alias("n")).select("host", F.col("n.nodes").alias("node"), F.col("n.prints").alias("print"))
    counted = items.groupBy("host", "node", "print").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_PAGES)
    constant = counted.join(having, ["host", "node"]).filter(F.col("n") >= SUPPORT * F.col("pages"))
    texts = constant.groupBy("host").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "node", F.hex("print")))).alias("texts"))
    out, _ = stored(known.join(texts, "host").select("host", "template", "texts"), "wrappers")
    dropped(pages.sparkSession, path, known_path, placed_path)
    return out


def _with_host(rows: DataFrame, of_host: DataFrame, column: str) -> DataFrame:
    """rows with their host's row of of_host, or nulls: by broadcast if a sum shows that it is small, else by a salted join."""
    sizes = [F.sum(F.length(F.concat_ws(" ", c))) for c in of_host.columns]
    total = sum(x or 0 for x in of_host.agg(*sizes).first())
    if total <= BROADCAST_BYTES:
        return rows.join(F.broadcast(of_host), "host", "left")
    return salted(rows, column).join(spread(of_host), ["host", "_salt"], "left").drop("_salt")


@lru_cache(maxsize=512)
def _loaded(template: str, texts: tuple[str, ...]) -> tuple[str, frozenset]:
    pairs = (t.split(" ") for t in texts)
    return frequent(template), frozenset((int(k), bytes.fromhex(p)) for k, p in pairs)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = wrappers(pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(h, _loaded(w, tuple(t)) if w else None) for h, w, t in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = _with_host(pages.withColumn("host", _host(F.col("url"))), found, "html").select("page_id", "url", "html", "template", "texts")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
