"""Selectors of elements: tag, #id, .class, [name] and [name=value], joined to compounds, and compounds joined by descent.

One parser serves both users: compounds as conditions on token rows, and as tests on tree nodes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"""(?P<tag>[a-zA-Z][\w:-]*|\*)|\#(?P<id>[\w:.-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]""")
#: Compounds are apart by blanks, lists by commas, neither inside brackets.
_APART, _LISTED = re.compile(r"\s+(?![^\[]*\])"), re.compile(r",(?![^\[]*\])")


@dataclass(frozen=True)
class Compound:
    """What one element must be: its tag (None for any), its classes, and its attributes (value None: any value)."""

    tag: str | None
    classes: tuple[str, ...]
    attrs: tuple[tuple[str, str | None], ...]

    def matches(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag and self.tag != tag:
            return False
        if self.classes and not set(self.classes) <= set((attrs.get("class") or "").split()):
            return False
        return all(n in attrs and v in (None, attrs[n]) for n, v in self.attrs)

    def column(self, tag: str = "tag", attrs: str = "attrs") -> Column:
        """The same as a condition on a token that opens an element."""
        first = lambda n: F.get(F.filter(attrs, lambda a: a["name"] == n), 0)["value"]
        test = F.col(tag) == self.tag if self.tag else F.col(tag).isNotNull()
        for c in self.classes:
            test &= F.array_contains(F.split(F.coalesce(first("class"), F.lit("")), r"\s+"), c)
        for n, v in self.attrs:
            test &= first(n).isNotNull() if v is None else first(n) == v
        return F.coalesce(test, F.lit(False))


def _compound(text: str) -> Compound:
    tag, classes, attrs, at = None, [], [], 0
    for m in _PART.finditer(text):
        if m.start() != at or m["tag"] and at:
            break
        at = m.end()
        tag = m["tag"].lower() if m["tag"] and m["tag"] != "*" else tag
        classes += [m["cls"]] if m["cls"] else []
        attrs += [("id", m["id"])] if m["id"] else []
        if m["name"]:
            attrs.append((m["name"].lower(), next((m[g] for g in "abc" if m[g] is not None), None)))
    if at != len(text) or not text:
        raise ValueError(f"not a selector: {text!r}")
    return Compound(tag, tuple(classes), tuple(attrs))


@lru_cache(maxsize=None)
def parse(selector: str) -> tuple[tuple[Compound, ...], ...]:
    """The alternatives of a selector list; each is a chain of compounds from the outermost element to the one that is meant."""
    return tuple(tuple(_compound(c) for c in _APART.split(one.strip())) for one in _LISTED.split(selector))
