"""A page as a tree that can be edited: what the steps of the compiler work on inside a task.

Pages are cut into the same tokens as pages.tokenize() cuts them, and read by the same forgiving stack rule. Texts keep their
source form; attribute values are decoded. Nothing here recurses, so depth is no limit.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

from foliolens.functions import selectors
from foliolens.operators import rules
from foliolens.operators.pages import ATTRIBUTE, TOKEN

_TOKEN, _ATTRIBUTE = re.compile(TOKEN.replace(r"\z", r"\Z")), re.compile(ATTRIBUTE)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_VOID, _DROPPED = frozenset(rules.VOID_TAGS), frozenset(rules.DROPPED_SUBTREES)


class Node:
    """An element (tag, attrs, children) or a text (tag None). An element with a text of its own is written as that."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str | None = None, attrs: dict[str, str] | None = None, text: str | None = None, children: list[Node] | None = None):
        self.tag, self.attrs, self.text, self.parent = tag, attrs if attrs is not None else {}, text, None
        self.children: list[Node] = []
        for child in children or []:
            self.append(child)

    def append(self, child: Node) -> None:
        child.remove()
        child.parent = self
        self.children.append(child)

    def remove(self) -> None:
        if self.parent:
            self.parent.children.remove(self)
            self.parent = None

    def replace(self, *others: Node) -> None:
        """Other nodes in this one's place."""
        parent, self.parent = self.parent, None
        if parent:
            at = parent.children.index(self)
            for other in others:
                other.remove()
                other.parent = parent
            parent.children[at : at + 1] = others

    def unwrap(self) -> None:
        held, self.children = self.children, []
        for child in held:
            child.parent = None
        self.replace(*held)

    def fill(self, *children: Node) -> None:
        """These children instead of the ones it has."""
        for child in self.children:
            child.parent = None
        self.children = []
        for child in children:
            self.append(child)

    def beside(self) -> Node | None:
        """The next element that the same parent holds."""
        held = self.parent.children if self.parent else [self]
        return next((c for c in held[held.index(self) + 1 :] if c.tag), None)

    def around(self) -> Iterator[Node]:
        """This node and those that hold it, from inside out."""
        at = self
        while at:
            yield at
            at = at.parent

    def within(self, *tags: str) -> bool:
        return any(n.tag in tags for n in self.around())

    def walk(self) -> Iterator[Node]:
        """All nodes below, in page order. Don't edit while walking."""
        waiting = self.children[::-1]
        while waiting:
            node = waiting.pop()
            yield node
            if node.children:
                waiting += node.children[::-1]

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def is_a(self, selector: str) -> bool:
        return any(_fits(self, chain) for chain in selectors.parse(selector))

    def all(self, selector: str) -> list[Node]:
        """The elements below that a selector list means, in page order."""
        return self._meant(selector, False)

    def first(self, selector: str) -> Node | None:
        return next(iter(self._meant(selector, True)), None)

    def _meant(self, selector: str, one: bool) -> list[Node]:
        tags, chains = _asked(selector)
        found, waiting = [], self.children[::-1]
        while waiting:
            node = waiting.pop()
            tag = node.tag
            if tag:
                if tag not in tags:
                    for own, bare, chain in chains:
                        if own in (None, tag) and (bare or node.attrs) and _fits(node, chain):
                            break
                    else:
                        tag = None
                if tag:
                    found.append(node)
                    if one:
                        break
            if node.children:
                waiting += node.children[::-1]
        return found

    def plain(self) -> str:
        """The text inside, decoded, white space collapsed."""
        return " ".join(html.unescape("".join(n.text for n in self.walk() if n.tag is None)).split())


@lru_cache(maxsize=1000)
def _asked(selector: str) -> tuple[frozenset[str], tuple]:
    """A selector list as the tags that it names alone, and its other chains, each with the tag of the element it means and whether that needs no attributes."""
    chains = selectors.parse(selector)
    plain = [c for c in chains if len(c) == 1 and c[0].tag and not c[0].classes and not c[0].attrs]
    return frozenset(c[0].tag for c in plain), tuple((c[-1].tag, not (c[-1].classes or c[-1].attrs), c) for c in chains if c not in plain)


def _fits(node: Node, chain: tuple[selectors.Compound, ...]) -> bool:
    if not node.tag or not chain[-1].matches(node.tag, node.attrs):
        return False
    left, at = len(chain) - 1, node.parent
    while left and at:
        left -= bool(at.tag and chain[left - 1].matches(at.tag, at.attrs))
        at = at.parent
    return not left


def _quoted(value: str) -> str:
    return html.escape(value, quote=False).replace('"', "&quot;")


def text(value: str) -> Node:
    return Node(text=html.escape(value, quote=False))


def _attrs(body: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(body):
        value = m[2] or ""
        if value[:1] in "\"'" and len(value) > 1:
            value = value[1:-1]
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return found


def parse(source: str) -> Node:
    """The page's body, or all of a fragment without its head."""
    top = at = Node("")
    held: dict[str, int] = {}
    for m in _TOKEN.finditer(source):
        raw = m[0]
        if raw[0] != "<" or raw == "<":
            at.append(Node(text=raw if raw != "<" else "&lt;"))
            continue
        if raw[1] in "!?":
            continue
        tag = _NAME.match(raw)[1].lower()
        if raw[1] == "/":
            if held.get(tag):
                ended = None
                while ended != tag:
                    ended, at = at.tag, at.parent
                    held[ended] -= 1
        elif tag in _DROPPED and "<" in raw[1:]:
            at.append(Node(tag, text=raw))
        else:
            body = raw[len(tag) + 1 : -1]
            closed = body.endswith("/")
            node = Node(tag, _attrs(body[:-1] if closed else body) if body else {})
            node.parent = at
            at.children.append(node)
            if tag not in _VOID and not closed:
                at = node
                held[tag] = held.get(tag, 0) + 1
    if body := top.first("body"):
        body.parent = None
        return body
    for head in top.all("head"):
        head.remove()
    for frame in top.all("html"):
        frame.unwrap()
    return top


def write(root: Node) -> str:
    """The source of what the root holds."""
    out: list[str] = []
    waiting: list[Node | str] = root.children[::-1]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.text is not None:
            out.append(node.text)
        else:
            out.append(f"<{node.tag}" + "".join(f' {n}="{_quoted(v)}"' for n, v in node.attrs.items()) + ">")
            if node.tag not in _VOID:
                waiting.append(f"</{node.tag}>")
                waiting += node.children[::-1]
    return "".join(out)
