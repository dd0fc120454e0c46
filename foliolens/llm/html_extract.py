"""Main text of web pages by wrapper induction.

Template text is counted over all different pages of a host: a text is template if it stands at the same
path in LEAST_PAGES pages or more, and in SHARE or more of the pages that have text at that path, among all
pages of the host or among those of one layout (the same blocks on the upper levels). What simple tree matching
of all pages would add, nodes that hold the same text in all of them, is among these: matched nodes have the same path.
Every different page of a host then votes for the smallest node that holds its varying prose; the one with most votes is the
host's content node. No page is left out of the counts or of the vote. Every page is then read through its host's wrapper: the blocks of
the nodes at the content node's path, or of their common parent, without template text and without what its
tag, class or role marks as menu, header, footer, sidebar, notice, advert, form or reader comment. Headings that the articles of a host
share stay where varying text follows them. A class marks by its whole name, and a list of links only where links are most of it. Classes mark
nothing that holds the article, nor a header inside the article that holds a heading, and nothing at all on a
page that would have no prose left. A page with prose elsewhere, or without the content node, chooses its own; one whose text is all linked gives that of its article, or else all of it.
Wrappers are small and joined by host. Pages vote by the paths and lengths of their texts, kept from the pass that counts, so they
are not parsed again for it; votes and counts are added up before they are shuffled.

Rows: a null or empty page has empty text; so has a page without prose. A null url counts as one
host of its own. Repeated rows and null ids are extracted one by one; equal votes for the content node are broken by the smaller path hash. Pages of any depth and length are read in
time linear in their length. Two trees are aligned exactly where their unequal parts take up to CELLS cells, and to DEPTH levels; what is left is
paired by equal tags in order. Further columns are ignored; an empty table gives an empty result. Character
references are decoded, white space inside a block becomes one blank, blocks are joined by an empty line.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored, texts_of

#: Pages of a host that make constant text template.
LEAST_PAGES = 4
#: Share of the pages with text at a path that make one text there template, and levels that make the layout.
SHARE, LAYOUT = 0.8, 3
#: Cells that the alignment of two trees fills; what is left then, or lies below so many levels, is paired in order.
CELLS, DEPTH = 500_000, 200

# Kinds of tags, and words of classes, ids and roles that mark what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("head script style noscript template nav header footer aside form button select textarea input iframe svg object dialog menu canvas audio video".split())
MARKS = set(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs header "
    "footer sidebar aside widget related share sharing social comment comments reply replies discussion disqus newsletter subscribe popup modal overlay login signup search pagination pager "
    "toolbar masthead copyright disclaimer contentinfo complementary dialog".split()
)
#: Words that may stand beside a mark in one name: they say where a thing is, or of what kind its box is, not what it tells.
PLACING = set(
    "site page main top bottom left right inner outer box bar block list section wrapper wrap container area slot unit item items link links icon icons button buttons col row panel global primary secondary sticky fixed floating "
    "inline mobile desktop js wp mt lt the my is has no with in on of and to for post article content entry story body text widget module group zone holder region wide narrow small large dark light show hide visible active".split()
)
#: Marks of lists of links: one that tells more than it links is text of the article.
LINKED = set("related share social menu pagination pager search".split())
#: Words that tell the article's own header from the page's.
OF_ARTICLE = set("article content post entry story page".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# A tag whose quotes don't close ends at the next '>'.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+(?=>|\Z)|[^<>]*+)(>|\Z|(?=<))|<(?![a-zA-Z/!?])|</""", re.S)
_NAMED = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(\bhidden\b)""")


class Node:
    """An element: its tag, name with classes, the hash of its path, children (elements and texts in order), and whether its tag or its classes drop it, the latter perhaps as a list of links only."""

    __slots__ = ("children", "dropped", "key", "level", "linked", "marked", "name", "parent", "tag")

    def __init__(self, tag: str, name: str, dropped: bool, marked: bool, parent: Node | None, linked: bool = False):
        self.tag, self.name, self.dropped, self.marked, self.parent, self.linked, self.children = tag, name, dropped, marked, parent, linked, []
        self.level = parent.level + 1 if parent else 0
        self.key = _hash(name, parent.key if parent else 0)

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]

    def own_text(self) -> str:
        return " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())

    def told(self, hashed: bool) -> tuple[int, int]:
        """Characters of the own text, and its hash with its path if that is asked for."""
        text = self.own_text()
        return len(text), _hash(text, self.key) if text and hashed else 0


class Outline(Node):
    """A node of which only its tag, its path and what its own text is told by are known."""

    __slots__ = ("own",)

    def __init__(self, tag: str, key: int, own: tuple[int, int], parent: Node | None):
        self.tag, self.key, self.own, self.parent, self.children, self.dropped, self.marked = tag, key, own, parent, [], False, False
        if parent is not None:
            parent.children.append(self)

    def told(self, hashed: bool) -> tuple[int, int]:
        return self.own


def _hash(text: str, seed: int = 0) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def _opened(tag: str, raw: str, parent: Node) -> Node:
    marks, words, name, hidden = set(), set(), tag, False
    if raw.strip():
        for key, value, bare in _NAMED.findall(raw):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role"):
                for one in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
                    parts = {w for w in re.split(r"[^a-z]+", one) if len(w) > 1}
                    words |= parts
                    # A name marks as a whole: "cookie-notice" and "site-header" do, "share-price" doesn't.
                    marks |= parts & MARKS if parts <= MARKS | PLACING else set()
                if key == "class":
                    name = f"{tag}.{'.'.join(sorted(value.split()))}"
            hidden |= bool(bare) or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "")
    found = marks - PLACING if marks - PLACING else marks
    if found <= {"header"} and words & OF_ARTICLE:
        found = set()
    marked = tag not in ("html", "body", "article", "main") and bool(found)
    return Node(tag, name, tag in DROPPED or hidden, marked, parent, marked and found <= LINKED)


def _settle(root: Node) -> None:
    """Takes back marks that would drop the article, its headline, or all prose of the page."""
    order = list(_walk(root, every=True))
    if any(n.linked for n in order):
        _keep_told(order)
    holds: dict[int, set[str]] = {}
    inside: set[int] = set()
    for node in order:
        if node.tag in ("article", "main") or id(node.parent) in inside:
            inside.add(id(node))
    for node in reversed(order):
        kinds = holds.pop(id(node), set())
        header = node.tag == "header" or node.marked and not node.dropped
        if "article" in kinds and (node.marked or node.tag == "form"):
            node.marked = False
            node.dropped = node.dropped and node.tag != "form"
        elif header and id(node) in inside and "heading" in kinds and not kinds & {"other"} and node.tag not in ("article", "main"):
            node.marked = False
            node.dropped = node.dropped and node.tag != "header"
        if node.tag in ("article", "main"):
            kinds.add("article")
        elif node.tag in ("h1", "h2"):
            kinds.add("heading")
        elif node.tag in DROPPED and node.tag != "header" or node.tag in ("h3", "h4", "h5", "h6", "li", "blockquote"):
            kinds.add("other")
        if kinds and node.parent is not None:
            holds.setdefault(id(node.parent), set()).update(kinds)
    marked = [n for n in order if n.marked or n.tag == "form"]
    if marked and not _prose(root, set(), True).get(id(root)):
        for node in marked:
            node.marked = False
            node.dropped = node.dropped and node.tag != "form"


def _keep_told(order: list[Node]) -> None:
    """Takes back marks of lists of links from nodes in whose paragraphs stands more than in their links."""
    told: dict[int, list[int]] = {}  # characters of paragraphs outside links, and of links
    kinds: dict[int, str] = {}
    for node in order:
        kinds[id(node)] = "a" if node.tag == "a" else "p" if node.tag == "p" and kinds.get(id(node.parent)) != "a" else kinds.get(id(node.parent), "")
    for node in reversed(order):
        mine = told.setdefault(id(node), [0, 0])
        if not node.dropped and (kind := kinds[id(node)]):
            mine[kind == "a"] += len(node.own_text())
        if node.linked and mine[0] > mine[1]:
            node.marked = False
        if node.parent is not None:
            up = told.setdefault(id(node.parent), [0, 0])
            up[0], up[1] = up[0] + mine[0], up[1] + mine[1]


def parse(page: str) -> Node:
    """The page's tree. Unclosed elements end where HTML ends them: a paragraph at the next block, an item at the next item."""
    root = at = Node("", "", False, False, None)
    seen, length = 0, len(page)
    open_: Counter[str] = Counter()  # open elements by tag, so that no walk up the tree looks for what isn't there

    def leave(node: Node, up: Node) -> None:
        while node is not up:
            open_[node.tag] -= 1
            node = node.parent

    while seen < length:
        token = _TOKEN.search(page, seen)
        if token is None:
            at.children.append(page[seen:])
            break
        if token.start() > seen:
            at.children.append(page[seen : token.start()])
        seen = token.end()
        tag = (token.group(2) or "").lower()
        if not tag:
            if token.group() in ("<", "</"):
                at.children.append(token.group())
            continue
        if token.group(1):
            if open_[tag]:
                up = at
                while up.tag != tag:
                    up = up.parent
                leave(at, up.parent)
                at = up.parent
            continue
        if not token.group(4) and seen == length:
            break  # the page ends inside a tag
        if tag not in INLINE and open_["p"]:
            up = at
            while up is not root and up.tag != "p" and up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                leave(at, up.parent)
                at = up.parent
        if tag in CLOSED_BY and any(open_[t] for t in CLOSED_BY[tag]):
            up = at
            while up is not root and up.tag not in CLOSED_BY[tag] and (up.tag in INLINE or up.tag == "p"):
                up = up.parent
            if up.tag in CLOSED_BY[tag]:
                up = up.parent
                if tag == "tr" and up.tag == "tr":
                    up = up.parent
                leave(at, up)
                at = up
        node = _opened(tag, token.group(3), at)
        at.children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, seen)
            node.children.append(page[seen : stop.start() if stop else length])
            seen = stop.end() if stop else length
        elif tag not in VOID and not token.group(3).endswith("/"):
            at = node
            open_[tag] += 1
    _settle(root)
    return root


def _walk(node: Node, every: bool = False) -> Iterator[Node]:
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(c for c in reversed(at.children) if not isinstance(c, str) and (every or not (c.dropped or c.marked)))


def _shown(node: Node) -> list[Node]:
    return [c for c in node.elements() if not (c.dropped or c.marked)]


def _in_order(left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of two lists of children and of all below them, equal names paired in order."""
    pairs, stack = [], [(left, right)]
    while stack:
        a, b = stack.pop()
        at = 0
        for x in a:
            found = next((j for j in range(at, min(len(b), at + 8)) if b[j].name == x.name), None)
            if found is not None:
                pairs.append((x, b[found]))
                stack.append((_shown(x), _shown(b[found])))
                at = found + 1
    return pairs


class Shapes:
    """By node of the trees seen so far: a number that nodes share if all names in and below them are the same, and how many nodes that are."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.shape: dict[int, int] = {}
        self.size: dict[int, int] = {}

    def add(self, tree: Node) -> None:
        if id(tree) in self.shape:
            return
        for node in reversed(list(_walk(tree))):
            name, size = [node.name], 1
            for c in node.children:
                if not isinstance(c, str) and not (c.dropped or c.marked):
                    name.append(self.shape[id(c)])
                    size += self.size[id(c)]
            self.shape[id(node)] = self.numbers.setdefault(tuple(name), len(self.numbers))
            self.size[id(node)] = size


class _Match:
    """Simple tree matching of two trees. Equal subtrees match whole; of two lists of children the equal ones at both ends do,
    which is always among the best ways; the rest is aligned cell by cell, once for each two kinds of subtrees."""

    def __init__(self, a: Node, b: Node, shapes: Shapes):
        shapes.add(a)
        shapes.add(b)
        self.shape, self.size = shapes.shape, shapes.size
        self.known: dict[tuple[int, int], int] = {}
        self.left = CELLS

    def ends(self, left: list[Node], right: list[Node]) -> tuple[int, int]:
        """How many children at the beginning and at the end are equal."""
        same = lambda x, y: self.shape[id(x)] == self.shape[id(y)]
        most, first = min(len(left), len(right)), 0
        while first < most and same(left[first], right[first]):
            first += 1
        last = 0
        while last < most - first and same(left[-1 - last], right[-1 - last]):
            last += 1
        return first, last

    def table(self, left: list[Node], right: list[Node], depth: int) -> list[list[int]]:
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, x in enumerate(left):
            above, row = best[i], best[i + 1]
            for j, y in enumerate(right):
                row[j + 1] = max(above[j + 1], row[j], above[j] + self.count(x, y, depth + 1))
        return best

    def count(self, a: Node, b: Node, depth: int) -> int:
        if a.name != b.name:
            return 0
        key = (self.shape[id(a)], self.shape[id(b)])
        if key[0] == key[1]:
            return self.size[id(a)]
        if key not in self.known:
            left, right = _shown(a), _shown(b)
            first, last = self.ends(left, right)
            whole = sum(self.size[id(c)] for c in left[:first] + left[len(left) - last :])
            left, right = left[first : len(left) - last], right[first : len(right) - last]
            self.left -= len(left) * len(right)
            if depth < DEPTH and self.left >= 0:
                inner = self.table(left, right, depth)[-1][-1]
            else:  # beyond twice the cells only what is equal counts
                inner = len(_in_order(left, right)) if self.left >= -CELLS else 0
            self.known[key] = 1 + whole + inner
        return self.known[key]

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        found, waiting = [], [(a, b, 0)]
        while waiting:
            a, b, depth = waiting.pop()
            if self.shape[id(a)] == self.shape[id(b)]:
                found += zip(_walk(a), _walk(b), strict=True)
                continue
            found.append((a, b))
            left, right = _shown(a), _shown(b)
            first, last = self.ends(left, right)
            waiting += [(x, y, depth + 1) for x, y in zip(left[:first] + left[len(left) - last :], right[:first] + right[len(right) - last :], strict=True)]
            left, right = left[first : len(left) - last], right[first : len(right) - last]
            if not left or not right:
                continue
            if depth >= DEPTH or self.left < 0:
                found += _in_order(left, right)
                continue
            best = self.table(left, right, depth)
            i, j = len(left), len(right)
            while i and j:
                n = self.count(left[i - 1], right[j - 1], depth + 1)
                if n and best[i][j] == best[i - 1][j - 1] + n:
                    waiting.append((left[i - 1], right[j - 1], depth + 1))
                    i, j = i - 1, j - 1
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return found


def tree_match(a: Node, b: Node, shapes: Shapes | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the number of matched nodes and the pairs. `shapes` is kept from match to match; its trees must live as long."""
    if a.name != b.name:
        return 0, []
    match = _Match(a, b, shapes or Shapes())
    n = match.count(a, b, 0)
    pairs = match.pairs(a, b)
    return (n if match.left >= 0 else len(pairs)), pairs


def _prose(node: Node, constant: set[int], links: bool = False) -> dict[int, int]:
    """Characters of varying text outside links (or of all varying text), by node, over the subtree of each."""
    mass: dict[int, int] = {}
    for at in reversed(list(_walk(node))):
        chars, text = at.told(bool(constant)) if links or at.tag != "a" else (0, 0)
        total = mass.get(id(at), 0) + (chars if chars and not (constant and text in constant) else 0)
        if total:
            mass[id(at)] = total
            if at is not node:
                mass[id(at.parent)] = mass.get(id(at.parent), 0) + total
    return mass


def content_node(root: Node, constant: set[int]) -> Node | None:
    """The deepest block that holds all prose of the page; where all its text is linked, that of its article, or of the page, counts."""
    mass, linked = _prose(root, constant), False
    if not mass.get(id(root), 0):
        mass, linked = _prose(root, constant, True), True
    if linked and (articles := [n for n in _walk(root) if n.tag in ("article", "main") and mass.get(id(n), 0)]):
        return _common([n for n in articles if not any(a is not n and a.tag in ("article", "main") for a in _around(n))])
    total = mass.get(id(root), 0)
    at = root
    while total:
        inner = [c for c in _shown(at) if mass.get(id(c), 0) == total and c.tag not in INLINE and c.tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")]
        if not inner:
            return at
        at = inner[0]
    return None


def _around(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def induce(pages: list[str], counted: list[int] = ()) -> dict:
    """A wrapper from all pages of a host that are at hand, by simple tree matching: hashes of constant texts with their paths, with those counted before, and the path of the content node. wrappers() finds the same from tables."""
    trees = {tuple(n.own_text() for n in _walk(t)): t for t in map(parse, pages)}  # copies teach nothing
    trees = list(trees.values())
    constant: set[int] = set(counted)
    if len(trees) >= LEAST_PAGES:
        same: Counter[int] = Counter()
        shapes = Shapes()
        for other in trees[1:]:
            for x, y in tree_match(trees[0], other, shapes)[1]:
                same[id(x)] += x.own_text() == y.own_text()
        constant |= {_hash(t, n.key) for n in _walk(trees[0]) if (t := n.own_text()) and same[id(n)] == len(trees) - 1}
    votes = Counter(n.key for n in (content_node(t, constant) for t in trees) if n is not None)
    return {"constant": sorted(constant), "content": min(votes, key=lambda p: (-votes[p], p)) if votes else None}


HEADINGS = {f"h{i}": i for i in range(1, 7)}


def blocks(node: Node, constant: set[int]) -> list[str]:
    """The text blocks under a node in page order. A heading that is template text stays if text that isn't follows it before a heading of its level or a higher one."""
    out: list[str] = []
    open_: list[str] = []
    shared: list[tuple[int, str]] = []  # template headings that no text has followed yet

    def close() -> None:
        if text := " ".join(entities.unescape("".join(open_)).split()):
            out.extend(t for _, t in shared)
            shared.clear()
            out.append(text)
        open_.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        at, i = stack.pop()
        if i == len(at.children):
            if at.tag not in INLINE:
                close()
            continue
        stack.append((at, i + 1))
        child = at.children[i]
        if isinstance(child, str):
            open_.append(child)
        elif child.tag == "br":
            open_.append(" ")
        elif not (child.dropped or child.marked):
            template = constant and not child.elements() and _hash(child.own_text(), child.key) in constant
            if child.tag in HEADINGS:
                close()
                shared[:] = [s for s in shared if s[0] < HEADINGS[child.tag]]
                if template:
                    shared.append((HEADINGS[child.tag], " ".join(entities.unescape(child.own_text()).split())))
            if not template:
                if child.tag not in INLINE:
                    close()
                stack.append((child, 0))
    close()
    return out


def _common(nodes: list[Node]) -> Node | None:
    """The node itself, or the deepest one above all of several nodes of the same depth."""
    while len(nodes) > 1:
        nodes = list({id(n.parent): n.parent for n in nodes}.values())
    return nodes[0] if nodes else None


def extract(page: str, wrapper: dict | None) -> str:
    if not page:
        return ""
    root = parse(page)
    constant = set(wrapper["constant"]) if wrapper else set()
    found = None
    if wrapper and wrapper["content"] is not None:
        found = _common([n for n in _walk(root) if n.key == wrapper["content"]])
        mass = _prose(root, constant)
        if found and mass.get(id(found), 0) < mass.get(id(root), 0):
            found = None
    found = found or content_node(root, constant)
    return "\n\n".join(blocks(found, constant)) if found else ""


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


OUTLINE = ("parents", "tags", "keys", "texts", "chars")


def outlined(walked: list[Node], texts: dict[int, str]) -> tuple[list, ...]:
    """Parents (by number), tags, paths, hashes of own texts and their characters, of a page's nodes in order, without those that hold no text; `texts` by node."""
    holds: set[int] = set()
    for node in reversed(walked):
        if id(node) in texts or id(node) in holds:
            holds.add(id(node))
            holds.add(id(node.parent))
    number: dict[int, int] = {}
    rows = []
    for node in walked:
        if id(node) in holds or node is walked[0]:
            number[id(node)] = len(rows)
            text = texts.get(id(node), "")
            rows.append((number.get(id(node.parent), -1), node.tag, node.key, _hash(text, node.key) if text else 0, len(text)))
    return tuple(zip(*rows, strict=True))


def outline(parents: list[int], tags: list[str], keys: list[int], texts: list[int], chars: list[int]) -> Node:
    nodes: list[Node] = []
    for parent, tag, key, text, n in zip(parents, tags, keys, texts, chars, strict=True):
        nodes.append(Outline(tag, key, (n, text), nodes[parent] if parent >= 0 else None))
    return nodes[0]


def outlines(rows: DataFrame) -> DataFrame:
    """(host, layout, copy, OUTLINE), one row for all pages of a host with the same texts, from rows (host, page)."""

    def run(batches):
        for batch in batches:
            layouts, copies, made = [], [], []
            for page in texts_of(batch.column(1)):
                walked = list(_walk(parse(page)))
                texts = {id(n): t for n in walked if (t := n.own_text())}
                layouts.append(_hash(",".join(map(str, sorted({n.key for n in walked if n.level <= LAYOUT and n.tag not in INLINE})))))
                copies.append(_hash("\0".join(texts.values())))
                made.append(outlined(walked, texts))
            kinds = [pa.int64(), pa.int64(), *(pa.list_(t) for t in (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()))]
            columns = [layouts, copies, *([list(o[i]) for o in made] for i in range(len(OUTLINE)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["host", "layout", "copy", *OUTLINE])

    schema = "host string, layout long, copy long, parents array<int>, tags array<string>, keys array<long>, texts array<long>, chars array<int>"
    return rows.select("host", "page").mapInArrow(run, schema).dropDuplicates(["host", "copy"])  # copies teach nothing


def template_counts(seen: DataFrame) -> DataFrame:
    """(host, counted) from the outlines of pages: hashes of the template texts, counted over all different pages of the host."""
    told = F.array_distinct(F.filter(F.arrays_zip(F.col("keys").alias("path"), F.col("texts").alias("text"), F.col("chars").alias("chars")), lambda n: n["chars"] > 0))
    told = F.array_distinct(F.transform(told, lambda n: F.struct(n["path"].alias("path"), n["text"].alias("text"))))
    both = seen.select("host", F.explode(F.array(F.lit(None).cast("long"), "layout")).alias("layout"), told.alias("nodes")).withColumn("layout", F.coalesce("layout", F.lit(0)))
    paths = F.array_distinct(F.transform("nodes", lambda n: n["path"]))
    pages = both.select("host", "layout", F.explode(paths).alias("path")).groupBy("host", "layout", "path").agg(F.count(F.lit(1)).alias("pages"))
    texts = both.select("host", "layout", F.explode("nodes").alias("n")).select("host", "layout", "n.*").groupBy("host", "layout", "path", "text").agg(F.count(F.lit(1)).alias("n"))
    constant = texts.filter(F.col("n") >= LEAST_PAGES).join(pages, ["host", "layout", "path"]).filter(F.col("n") >= SHARE * F.col("pages"))
    return constant.groupBy("host").agg(F.array_sort(F.collect_set("text")).alias("counted"))


def wrappers(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper) for every host of pages."""
    rows = pages.select(host_of(url).alias("host"), F.col(page).alias("page")).filter(F.octet_length("page") > 0)
    seen = stored(outlines(rows), "outlines")
    counted = stored(template_counts(seen), "counted")

    def vote(batches):
        for batch in batches:
            votes = []
            last, constant = None, set()
            for now, *columns in zip(batch.column(1), *(batch.column(i).to_pylist() for i in range(2, 2 + len(OUTLINE))), strict=True):
                if last is None or now != last:
                    last, constant = now, set(now.as_py() or [])
                node = content_node(outline(*columns), constant)
                votes.append(None if node is None else node.key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.int64())], ["host", "content"])

    votes = seen.join(counted, "host", "left").select("host", "counted", *OUTLINE).mapInArrow(vote, "host string, content long")
    votes = votes.groupBy("host", "content").agg(F.count(F.lit(1)).alias("n"))
    order = F.when(F.col("content").isNotNull(), F.struct(-F.col("n"), "content"))
    chosen = votes.groupBy("host").agg(F.min_by("content", order).alias("content")).join(counted, "host", "left")
    wrapper = F.struct(F.coalesce("counted", F.array().cast("array<long>")).alias("constant"), "content")
    return stored(chosen.select("host", F.to_json(wrapper, {"ignoreNullFields": "false"}).alias("wrapper")), "wrappers")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row of pages: the key, the url, the main text and its length in code points."""
    learned = wrappers(pages, key, url, page)
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(page).alias("page")).withColumn("host", host_of("url"))

    def run(batches):
        kept: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for content, wrapper in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if wrapper is not None and wrapper not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[wrapper] = json.loads(wrapper)
                texts.append(extract(content, kept.get(wrapper)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, "url", "text", "n_chars"])

    joined = rows.join(learned, "host", "left").select("id", "url", "page", "wrapper")
    return joined.mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, url string, text string, n_chars long")
