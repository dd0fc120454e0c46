"""The steps of the compiler, each an edit of one page's tree, in the order in which they must run.

Equations come first, so that their pictures are never queued; headings before anything that numbers them; ids of blocks once structure stands
still; edits after the source block, which they add to; the frame last. A step tells what it did as notes and what people must answer as queue items.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import unquote, urljoin, urlsplit

from foliolens.functions.color import AA_NORMAL, NAMES
from foliolens.operators import audits, rules
from foliolens.operators.tree import Node, parse, text, write

_NEVER = "(?!)"


@dataclass(frozen=True)
class Publisher:
    """How a publisher marks what the steps look for. Selectors and patterns."""

    name: str
    chrome: tuple[str, ...] = ("script", "style")
    caption: str = "figcaption"
    caption_beside: bool = False  # a caption may be the next element after its figure or table
    description: str = "figcaption"  # the part of a caption that describes
    wrapper: str = "figure"
    label_only: str = r"(?i)^(?:figure|table|example|exercise)\s*[\d.]*$"
    credit: str = r"(?i)\bcredits?:\s.*$"
    xref: str = _NEVER  # links inside a book: group 1 names the page, group 2 is the fragment
    content_hash: str = _NEVER  # group 1 of an address
    equation_images: bool = False
    tex: bool = False


# The publishers' markup.
PUBLISHERS = {
    p.name: p
    for p in (
        Publisher(
            "openstax", ("script", "style", "nav#toc"), ".os-caption-container", True, ".os-caption", 'span[data-type="media"]', xref=r"(?i)^\./[0-9a-f-]{36}@[^:]*:([0-9a-f-]{36})(?:\.xhtml)?(#.*)?$",
            content_hash=r"(?i)/([0-9a-f]{40})(?:\.\w+)?$",
        ),
        Publisher("libretexts", ("script", "style", "nav", ".mt-toc-container", ".mt-page-actions", ".mt-footer"), "figcaption, .lt-figure-caption, .caption", False, "figcaption, .lt-figure-caption, .caption", ".lt-image, .image, .image-container", tex=True),
        Publisher("pressbooks", ("script", "style", "nav", "header", "footer", ".site-header", ".site-footer"), "figcaption, .wp-caption-text", False, "figcaption, .wp-caption-text", ".wp-caption, .wp-block-image, figure", equation_images=True),
        Publisher("document", label_only=r"(?i)^(?:figure|table)\s*[\d.]*$", tex=True),
    )
}
# Attributes that hold addresses, those that a page loads, link texts that say nothing, elements that are a page's blocks.
ADDRESSES = {t: tuple(n for n in names if n != "srcset") for t, names in rules.URL_ATTRIBUTES.items()}
LOADED = ("src", "poster", "data")
GENERIC_LINK, RAW_LINK = re.compile(r"(?i)^(?:click here|here|read more|more info(?:rmation)?|learn more|this link|link|more)$"), re.compile(r"(?i)^(?:https?://|www\.)\S+$")
BLOCKS = ("p", "li", "dd", "dt", "td", "th", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption")
INK, WHITE = "#2d3b45", "#ffffff"
OWN_PARTS = ("source-and-license", "page-footer", "added-title")


@dataclass
class Page:
    """One section on its way: its tree, what is known about it, and what the steps tell."""

    root: Node
    publisher: Publisher
    facts: dict
    notes: list[tuple[str, str, int]] = field(default_factory=list)
    queue: list[dict] = field(default_factory=list)
    described: dict[int, str] = field(default_factory=dict)

    def note(self, step: str, message: str, n: int = 1) -> None:
        if n:
            self.notes.append((step, message, n))

    def by_id(self, name: str) -> Node | None:
        return next((n for n in self.root.walk() if n.tag and n.attrs.get("id") == name), None)

    def answer(self, content_hash: str | None, element: str) -> dict | None:
        return self.facts["answers"].get(content_hash or f"{self.facts['section']}::{element}")


def style_of(node: Node) -> dict[str, str]:
    style = node.attrs.get("style")
    if not style:
        return {}
    pairs = (d.split(":", 1) for d in style.split(";") if ":" in d)
    return {n.strip().lower(): v.strip() for n, v in pairs}


def restyle(node: Node, **values: str) -> None:
    node.attrs["style"] = "; ".join(f"{n}: {v}" for n, v in (style_of(node) | {n.replace("_", "-"): v for n, v in values.items()}).items())


def strip_chrome(page: Page) -> None:
    gone = [n for selector in page.publisher.chrome for n in page.root.all(selector) if _cut(n)]
    page.note("strip-chrome", "chrome removed", len(gone))


def _cut(node: Node) -> bool:
    node.remove()
    return True


def absolute_addresses(page: Page) -> None:
    """Against the section's base; fragments, links inside the book and packaged files stay, as do addresses that can't be read."""
    base = page.facts["base"]
    if not base:
        return
    home = urlsplit(base)
    if not (home.scheme and home.hostname):
        raise ValueError(f"not an absolute address: {base}")
    rewritten, upgraded, failed = 0, 0, []
    for node in [n for n in page.root.walk() if n.tag in ADDRESSES]:
        for name in ADDRESSES[node.tag]:
            raw = node.attrs.get(name)
            if not raw or raw[0] == "#" or raw.startswith(rules.FILEBASE) or re.search(page.publisher.xref, raw):
                continue
            try:
                full = urljoin(base, raw.strip())
                parts = urlsplit(full)
                if parts.scheme in ("http", "https") and (not parts.hostname or re.search(r"[\s<>^`{|}]", parts.netloc) or parts.port == 0):
                    raise ValueError("no host")
            except ValueError:
                failed.append(raw)
                continue
            if parts.scheme == "http" and (name in LOADED or parts.hostname == home.hostname):
                full = parts._replace(scheme="https").geturl()
                upgraded += 1
            if full != raw:
                node.attrs[name] = full
                rewritten += 1
    page.note("absolutize", "addresses made absolute", rewritten)
    page.note("absolutize", "addresses moved to https", upgraded)
    page.note("absolutize", "addresses left that can't be read: " + ", ".join(failed), len(failed))


_DELIMITED = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S)


def _equation(tex: str, display: bool) -> Node | None:
    """Mathematics that carries its TeX; none where braces don't match, so that the source stays."""
    depth = 0
    for m in re.finditer(r"\\.|[{}]", tex):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth < 0:
            return None
    if depth or not tex.strip():
        return None
    meaning = Node("semantics", children=[Node("mtext", children=[text(tex)]), Node("annotation", {"encoding": "application/x-tex"}, children=[text(tex)])])
    return Node("math", {"display": "block"} if display else {}, children=[meaning])


def recover_equations(page: Page) -> None:
    """Pictures of equations that carry TeX, and delimited TeX in texts outside code, as mathematics."""
    found = 0
    for image in page.root.all("img") if page.publisher.equation_images else []:
        raw, classes = (image.attrs.get("alt") or "").strip(), image.classes()
        if not (any(c.startswith("ql-img-") for c in classes) or "quicklatex.com" in (image.attrs.get("src") or "")) or not raw or raw.lower() == "rendered by quicklatex.com":
            continue
        bare = re.sub(r"^(?:\\\[|\\\(|\$\$|\$)\s*|\s*(?:\\\]|\\\)|\$\$|\$)$", "", raw).strip()
        if made := _equation(bare, raw.startswith(("\\[", "$$")) or any("displayed" in c for c in classes)):
            image.replace(made)
            found += 1
    for node in [n for n in page.root.walk() if n.tag is None and "\\" in n.text] if page.publisher.tex else []:
        if node.within("math", "pre", "code", "textarea", *rules.DROPPED_SUBTREES):
            continue
        parts, at = [], 0
        for m in _DELIMITED.finditer(node.text):
            if made := _equation(html.unescape(m[1] or m[2]), m[2] is not None):
                parts += [Node(text=node.text[at : m.start()]), made]
                at = m.end()
                found += 1
        if parts:
            node.replace(*[p for p in [*parts, Node(text=node.text[at:])] if p.tag or p.text])
    page.note("math", f"equations, {found} of them recovered from TeX", len(page.root.all("math")))


def relevel_headings(page: Page) -> None:
    found = page.root.all("h1, h2, h3, h4, h5, h6")
    least, last, changed = min((int(h.tag[1]) for h in found), default=2), 1, 0
    for h in found:
        last = min(6, max(2, int(h.tag[1]) + 2 - least), last + 1)
        changed += h.tag != f"h{last}"
        h.tag = f"h{last}"
    page.note("headings", "headings re-levelled so that none skips", changed)


def caption_of(page: Page, node: Node) -> Node | None:
    if inside := node.first(page.publisher.caption):
        return inside
    after = node.beside() if page.publisher.caption_beside else None
    return after if after and after.is_a(page.publisher.caption) else None


def restructure_figures(page: Page) -> None:
    """Figures as blocks that the page policy allows: own or made ids, media unwrapped, the caption as the block's last paragraph, tied to its first picture."""
    figures = page.root.all("figure")
    for number, figure in enumerate(figures):
        if not any(n is page.root for n in figure.around()):
            continue  # unwrapped with the figure around it
        caption, own = caption_of(page, figure), figure.attrs.get("id", f"fig-{number}")
        for wrapper in figure.all(page.publisher.wrapper):
            wrapper.unwrap()
        figure.tag, figure.attrs = "div", {"class": "figure-block", "id": own}
        if not caption:
            continue
        said, part = caption.plain(), caption.first(page.publisher.description)
        description = part.plain() if part else re.sub(page.publisher.credit, "", said).strip()
        caption.remove()
        if not said:
            continue
        figure.append(Node("p", {"class": "figure-caption", "id": f"cap-{own}"}, children=[text(said)]))
        if image := figure.first("img"):
            image.attrs["aria-describedby"] = f"cap-{own}"
            page.described[id(image)] = description
        if re.search(page.publisher.label_only, said):
            page.note("figures", f"caption of {own} is only a label: {said}")
    page.note("figures", "figures restructured", len(figures))


def references(root: Node) -> dict[int, str]:
    """By node: the text of the paragraph or heading that stands last before it beside it, or else beside what holds it."""
    out: dict[int, str] = {}
    waiting = [(root, "")]
    while waiting:
        node, last = waiting.pop()
        for child in node.children:
            if child.tag:
                out[id(child)] = last
                waiting.append((child, last))
                if child.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    last = child.plain() or last
    return out


_SHORTENED = re.compile(r"(?i)\b(?:e\.g|i\.e|cf|vs|etc|Fig|Eq|No|Ch|Sec|Vol|pp|Dr|Prof|approx)\.$")


def first_sentence(said: str) -> str:
    for m in re.finditer(r"[.!?](?=\s+[\"'“‘(\[]?[A-Z])", said):
        if m.end() >= 30 and not _SHORTENED.search(said[: m.end()]):
            return said[: m.end()]
    return said


def _span(cell: Node, name: str) -> int:
    m = re.match(r"\s*\+?(\d+)", cell.attrs.get(name) or "")
    return int(m[1]) or 1 if m else 1


def _rows(table: Node) -> list[Node]:
    """The table's own rows, those of inner tables left out, heads first and feet last."""
    rows, waiting = [], table.children[::-1]
    while waiting:
        node = waiting.pop()
        if node.tag == "tr":
            rows.append(node)
        elif node.tag and node.tag != "table":
            waiting += node.children[::-1]
    return sorted(rows, key=lambda r: (r.parent.tag == "tfoot") - (r.parent.tag == "thead"))


def _cells(row: Node) -> list[Node]:
    return [c for c in row.children if c.tag in ("td", "th")]


def refusal(table: Node, choice: str) -> str | None:
    """The first reason why a band of a table can't become headers."""
    grid = [_cells(r) for r in _rows(table)]
    if not grid:
        return "it has no rows"
    if table.first("table"):
        return "it contains another table"
    if any(_span(c, "rowspan") > 1 for cells in grid for c in cells):
        return "a cell spans rows"
    if len({sum(_span(c, "colspan") for c in cells) for cells in grid}) > 1:
        return "its rows differ in width"
    band = (grid[0] if choice != "column" else []) + ([cells[0] for cells in grid if cells] if choice != "row" else [])
    return "a cell of the band spans columns" if any(_span(c, "colspan") > 1 for c in band) else None


def _promote(table: Node, choice: str) -> None:
    for r, row in enumerate(_rows(table)):
        for c, cell in enumerate(_cells(row)):
            top, side = r == 0 and choice != "column", c == 0 and choice != "row"
            if top or side:
                cell.tag = "th"
                cell.attrs.pop("scope", None)
                if not (top and side):
                    cell.attrs["scope"] = "col" if top else "row"


def _present(table: Node) -> int:
    """Width, border, alignment and stripes where the page says nothing about them; how many were set."""
    changed, own = 0, style_of(table)
    for name, value in (("width", "100%"), ("border", "1")):
        if name not in table.attrs and not own.get(name):
            table.attrs[name] = value
            changed += 1
    for caption in (c for c in table.children if c.tag == "caption" and style_of(c).get("text-align") != "center"):
        restyle(caption, text_align="center")
        changed += 1
    rows = _rows(table)
    for cell in (c for row in rows for c in _cells(row)):
        if not ({"align", "data-align"} & cell.attrs.keys() or style_of(cell).get("text-align")):
            restyle(cell, text_align="left")
            changed += 1
    data = [r for r in rows if r.parent.tag not in ("thead", "tfoot") and any(c.tag == "td" for c in _cells(r))]
    for row in data[1::2]:
        if not {"background", "background-color"} & style_of(row).keys():
            restyle(row, background_color="#f2f2f2")
            changed += 1
    return changed


def fix_tables(page: Page) -> None:
    """Captions, looks and headers of tables. A table without header cells is a question, until an answer can be applied."""
    before, presented, captioned = references(page.root), 0, 0
    for number, table in enumerate(page.root.all("table")):
        source = caption_of(page, table)
        said = source.plain() if source else ""
        own = next((c for c in table.children if c.tag == "caption"), None)
        if source:
            if source is not own:
                source.remove()
            if said and not own:
                own = _caption(table, said)
        reference = before[id(table)]
        if not (own and own.plain()):
            fallback = next((v for v in ((table.attrs.get("summary") or "").strip(), (table.attrs.get("aria-label") or "").strip(), first_sentence(reference)) if v), "Data table")
            if own:
                own.fill(text(fallback))
            else:
                _caption(table, fallback)
            captioned += 1
        presented += _present(table)
        if (role := table.attrs.get("role")) in ("presentation", "none"):
            page.note("tables", f"table declared {role} left as it is")
            continue
        if table.first("th"):
            continue
        element = table.attrs.get("id") or table.attrs.setdefault("id", f"table-{number}")
        answer = page.answer(None, element)
        if answer and answer["type"] == "table-headers":
            if answer["choice"] == "presentation":
                table.attrs["role"] = "presentation"
                page.note("tables", "table confirmed as layout")
                continue
            if not (reason := refusal(table, answer["choice"])):
                _promote(table, answer["choice"])
                page.note("tables", f"table headers set: {answer['choice']}")
                continue
            page.note("tables", f"table headers refused: {reason}")
        opening = first_sentence(reference)
        shown = None if re.search(page.publisher.label_only, said) else said or None
        page.queue.append({"kind": "table-headers", "element_id": element, "caption": shown, "reference": (opening if opening == reference else opening + "…") or None})
    page.note("tables", "captions and looks of tables added", presented + captioned)


def _caption(table: Node, said: str) -> Node:
    made = Node("caption", children=[text(said)])
    made.parent = table
    table.children.insert(0, made)
    return made


def _label(page: Page, href: str) -> str | None:
    if href.startswith("#") and (target := page.by_id(href[1:])) and (said := target.plain()):
        return f"Go to {said[:96]}"
    if href.lower().startswith("mailto:"):
        address = href[7:].split("?")[0]
        return f"Email {address}" if address else None
    try:
        parts = urlsplit(href)
        last = ([s for s in unquote(parts.path, errors="strict").split("/") if s] or [""])[-1]
    except ValueError:
        return None
    words = " ".join(re.sub(r"[-_]+", " ", re.sub(r"(?i)\.(?:html?|pdf|php)$", "", last)).split())
    subject = words if words and words.lower() != "index" else parts.hostname
    return f"Read more about {subject}" if subject else None


def fix_links(page: Page) -> None:
    """Links inside the book lead to the pages' addresses, to the book where a page has none; link texts that say nothing say where they lead."""
    resolved, lost, labelled = 0, [], 0
    found = [a for a in page.root.all("a") if "href" in a.attrs]
    for a in found:
        if m := re.search(page.publisher.xref, a.attrs["href"]):
            a.attrs["data-xref"] = m[1]
            if target := page.facts["xrefs"].get(m[1].lower()):
                a.attrs["href"] = target + (m[2] or "")
                resolved += 1
                continue
            lost.append(m[1])
            if page.facts["book_url"]:
                a.attrs["href"] = page.facts["book_url"]
            else:
                del a.attrs["href"]
    for a in found:
        said = a.plain()
        if "href" in a.attrs and (GENERIC_LINK.search(said) or RAW_LINK.search(said)) and (better := _label(page, a.attrs["href"])) and better != said:
            a.fill(text(better))
            labelled += 1
    page.note("links", "links inside the book resolved", resolved)
    page.note("links", "links inside the book without a page: " + ", ".join(dict.fromkeys(lost)), len(lost))
    page.note("links", "link texts made to say where they lead", labelled)


def text_semantics(page: Page) -> None:
    """Bold and italic by meaning; underlines stay with links only."""
    emphasis = underlined = 0
    for node in [n for n in page.root.walk() if n.tag]:
        if node.tag in ("b", "i"):
            node.tag = "strong" if node.tag == "b" else "em"
            emphasis += 1
        elif node.tag == "u" and not node.within("a"):
            node.tag = "span"
            restyle(node, text_decoration="none")
            underlined += 1
        elif "style" in node.attrs and "underline" in style_of(node).get("text-decoration", "").lower() and not node.within("a"):
            restyle(node, text_decoration="none")
            underlined += 1
    page.note("text-semantics", "presentational tags replaced", emphasis)
    page.note("text-semantics", "underlines outside links removed", underlined)


def blocks(root: Node) -> list[Node]:
    """The outermost text blocks."""
    is_block = lambda n: n.tag in BLOCKS or n.tag and "class" in n.attrs and "figure-caption" in n.classes()
    if any(is_block(a) for a in root.around()):
        return []
    found, waiting = [], root.children[::-1]
    while waiting:
        node = waiting.pop()
        if is_block(node):
            found.append(node)
        elif node.children:
            waiting += node.children[::-1]
    return found


def ids_of_blocks(page: Page) -> None:
    """Ids by section and place for blocks without one; what the compiler itself adds doesn't count."""
    h = 2166136261
    for unit in memoryview(page.facts["section"].encode("utf-16-le", "surrogatepass")).cast("H"):
        h = (h ^ unit) * 16777619 % (1 << 32)
    digits = ""
    while h or not digits:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    own = [b for b in blocks(page.root) if not any(c in OWN_PARTS for a in b.around() if a.tag for c in a.classes())]
    for number, block in enumerate(own):
        if not block.attrs.get("id"):
            block.attrs["id"] = f"blk-{digits}-{number}"


def insert_images(page: Page) -> None:
    """Pictures that people added, each with its caption and credit, after or in place of the block that they name."""
    placed = lost = 0
    for image in page.facts["images"]:
        own = f"fig-added-{image['asset']}"
        if page.by_id(own):
            continue
        if not (target := page.by_id(image["target"])):
            lost += 1
            continue
        shown = Node("img", {"src": f"{rules.FILEBASE}/{rules.PACKAGED_FOLDER}/{image['asset']}", "alt": image["alt"], "width": str(image["width"]), "height": str(image["height"]), "aria-describedby": f"cap-{own}"})
        credit = [text(f"{image['caption'] + ' ' if image['caption'] else ''}{image['credit']} ("), Node("a", {"href": image["source_url"]}, children=[text("source")]), text(")")]
        figure = Node("div", {"class": "figure-block", "id": own}, children=[shown, Node("p", {"class": "figure-caption", "id": f"cap-{own}"}, children=credit)])
        if image["mode"] == "replace":
            target.replace(figure)
        else:
            _after(target, figure)
        placed += 1
    page.note("images", "pictures added", placed)
    page.note("images", "added pictures whose place is gone", lost)


def _after(node: Node, other: Node) -> None:
    held = node.parent.children
    other.parent = node.parent
    held.insert(held.index(node) + 1, other)


@lru_cache(maxsize=10_000)
def color(value: str) -> tuple[float, float, float, float] | None:
    """(r, g, b, a) of a CSS colour; None for what isn't one."""
    v = NAMES.get(value.strip().lower(), value.strip().lower())
    if m := re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", v):
        digits = m[1] if len(m[1]) > 4 else "".join(c * 2 for c in m[1])
        channels = [int(digits[i : i + 2], 16) for i in range(0, len(digits), 2)]
        return (*channels[:3], channels[3] / 255 if len(channels) > 3 else 1.0)
    number = r"([0-9]*\.?[0-9]+%?)"
    if m := re.fullmatch(rf"rgba?\(\s*{number}\s*[,\s]\s*{number}\s*[,\s]\s*{number}\s*(?:[,/]\s*{number}\s*)?\)", v):
        part = lambda p, of: min(of, float(p[:-1]) * of / 100 if p.endswith("%") else float(p))
        return (*[part(p, 255.0) for p in m.groups()[:3]], part(m[4], 1.0) if m[4] else 1.0)
    return None


def over(top: tuple, below: tuple) -> tuple:
    return (*[int(t * top[3] + b * (1 - top[3]) + 0.5) for t, b in zip(top[:3], below[:3], strict=True)], 1.0)


@lru_cache(maxsize=10_000)
def ratio(a: tuple, b: tuple) -> float:
    def luminance(c: tuple) -> float:
        linear = [x / 255 / 12.92 if x / 255 <= 0.03928 else ((x / 255 + 0.055) / 1.055) ** 2.4 for x in c[:3]]
        return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]

    high, low = sorted((luminance(a), luminance(b)), reverse=True)
    return (high + 0.05) / (low + 0.05)


def fix_contrast(page: Page) -> None:
    """Inline colours that fail on the declared backgrounds below them give way to the better of two inks."""
    changed, white, dark = 0, color(WHITE), color(INK)
    below: dict[int, tuple | None] = {id(page.root): white}  # None where a background can't be read
    for node in [n for n in page.root.walk() if n.tag]:
        own, ground = style_of(node) if "style" in node.attrs else {}, below[id(node.parent)]
        if own.get("background-color"):
            layer = color(own["background-color"])
            ground = over(layer, ground) if layer and ground else None
        below[id(node)] = ground
        paper = ground or white
        better = INK if ratio(dark, paper) >= ratio(white, paper) else WHITE
        fails = lambda c: (ink := color(c)) is not None and ratio(over(ink, paper), paper) < AA_NORMAL  # noqa: B023, E731
        if own.get("color"):
            if fails(own["color"].removesuffix("!important")):
                restyle(node, color=better)
                changed += 1
        elif node.attrs.get("color") and fails(node.attrs["color"]):
            node.attrs["color"] = better
            changed += 1
    page.note("contrast", "text colours of low contrast replaced", changed)


def _units(said: str) -> int:
    return len(said.encode("utf-16-le", "surrogatepass")) // 2


def fit_alt(said: str, most: int = rules.MOST_ALT) -> str:
    """As functions.text.fit_alt(): whole, or up to a sentence's end, or up to a word."""
    if _units(said) <= most:
        return said
    said = " ".join(said.split())
    if _units(said) <= most:
        return said
    head = lambda n: said.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "ignore")
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", head(most))]
    if ends and _units(said[: ends[-1]]) >= 20:
        return said[: ends[-1]]
    cut = head(most - 1)
    return (cut.rpartition(" ")[0] or cut).rstrip() + "…"


def alt_issue(alt: str) -> str | None:
    """As audits.alt_issue(), from the same patterns."""
    said = alt.strip()
    if not said:
        return None
    if _units(said) > rules.MOST_ALT:
        return "alt-text-too-long"
    for name, pattern in (("url", audits.URL_LIKE), ("filename", audits.FILE_NAME), ("placeholder", audits.PLACEHOLDER), ("redundant", audits.REDUNDANT)):
        if re.search(pattern, said):
            return f"alt-text-{name}"
    if re.search(audits.GENERATED_MARK, said) or re.search(audits.GENERATED_LIST, said) or re.search(audits.GENERATED_STEM, said) and _units(said) <= audits.STEM_MOST:
        return "alt-text-machine-generated"
    return "alt-text-too-short" if _units(said) < rules.LEAST_ALT else None


def resolve_alt(page: Page) -> None:
    """Pictures: declared decorative, trusted as they are, answered, or queued with what is known about them."""
    counts = dict.fromkeys(("declared decorative", "confirmed decorative", "described by people", "texts shortened to the limit", "trusted as described"), 0)
    before = references(page.root)
    for number, image in enumerate(page.root.all("img")):
        alt, src = image.attrs.get("alt"), image.attrs.get("src") or ""
        issue = alt_issue(alt or "")
        if alt is not None and (fitted := fit_alt(alt)) != alt:
            image.attrs["alt"] = alt = fitted
            counts["texts shortened to the limit"] += 1
        if image.attrs.get("role") in ("presentation", "none") or any(a.attrs.get("aria-hidden") == "true" for a in image.around()):
            counts["declared decorative"] += 1
            continue
        if issue in (None, "alt-text-too-long"):
            issue = alt_issue(alt or "")
        said = bool(alt and alt.strip())
        if said and not issue:
            counts["trusted as described"] += 1
            continue
        element = image.attrs.get("id") or image.attrs.setdefault("id", f"img-{number}")
        known = re.search(page.publisher.content_hash, src)
        content_hash = known[1].lower() if known else None
        answer = page.answer(content_hash, element)
        if answer and answer["type"] == "decorative":
            image.attrs["alt"] = ""
            counts["confirmed decorative"] += 1
            continue
        if answer and answer["type"] == "alt":
            image.attrs["alt"] = fit_alt(answer["text"])
            counts["texts shortened to the limit"] += image.attrs["alt"] != answer["text"]
            counts["described by people"] += 1
            continue
        block = next((a for a in image.around() if a.tag and "figure-block" in a.classes()), None)
        caption, description = block and block.first(".figure-caption"), page.described.get(id(image), "")
        soft = issue and issue not in ("alt-text-too-long", "alt-text-url", "alt-text-filename", "alt-text-placeholder")
        page.queue.append({
            "kind": "confirm-decorative" if alt is not None and not said else "alt", "element_id": element, "hash": content_hash, "src": src, "caption": caption.plain() if caption else None, "reference": before[id(image)] or None,
            "proposed": fit_alt(description) if description and not re.search(page.publisher.label_only, description) else None, "current": fit_alt(alt) if said and soft else None,
        })
    for message, n in counts.items():
        page.note("alt", message, n)


def append_source(page: Page) -> None:
    """The source and licence of a section, at its end; what isn't known is said not to be."""
    if page.root.first(".source-and-license"):
        return
    f = page.facts
    title = f["title"] or ""
    named = Node("a", {"href": f["canonical_url"]}, children=[text(title)]) if f["canonical_url"] else text(title)
    document = page.publisher.name == "document"
    where = f" — source: {f['publisher'] or ''}." if document else f" — from {f['book'] or ''}, published by {f['publisher'] or ''}."
    people = f"By {', '.join(f['authors'])}." if f["authors"] else "Authors not stated."
    terms = [text("License not stated.")]
    if f["license"]:
        terms = [text("Licensed under the "), Node("a", {"href": f["license_url"]}, children=[text(f["license"])]) if f["license_url"] else text(f["license"]), text(".")]
    parts = [Node("h2", children=[text("Source and license")]), Node("p", children=[named, text(where)]), Node("p", children=[text(people)]), Node("p", children=terms)]
    page.root.append(Node("div", {"class": "source-and-license"}, children=parts))
    page.note("source", "source and license added")


def apply_edits(page: Page) -> None:
    """Edits of words, each at the n-th place where its original stands inside one text of its block; then what changed is said in the source block."""
    applied = stale = 0
    for edit in page.facts["edits"]:
        if edit["kind"] != "replace" and edit["context"] is None:
            continue
        block, original, left = page.by_id(edit["element_id"]), edit["original"], edit["occurrence"]
        for node in [n for n in block.walk() if n.tag is None] if block and original else []:
            parts = html.unescape(node.text).split(original)
            if left < len(parts) - 1:
                new = in_manner(original, edit["replacement"]) if edit["kind"] == "replace" else f"{original} ({edit['context']})"
                node.text = text(original.join(parts[: left + 1]) + new + original.join(parts[left + 1 :])).text
                applied += 1
                break
            left -= len(parts) - 1
        else:
            stale += 1
    block = page.root.first(".source-and-license")
    for image in page.facts["images"] if block else []:
        if page.by_id(f"fig-added-{image['asset']}"):
            applied += 1
            if not any(p.attrs.get("data-asset") == image["asset"] for p in block.children):
                terms = Node("a", {"href": image["license_url"]}, children=[text(image["license"])]) if image["license_url"] else text(image["license"])
                more = " This image is licensed share-alike; adaptations of it must carry the same licence." if image["share_alike"] else ""
                said = [text(f"Additional image: {image['credit'].rpartition(', ')[0] or image['credit']}, "), terms, text(" ("), Node("a", {"href": image["source_url"]}, children=[text("source")]), text(")." + more)]
                block.append(Node("p", {"class": "image-credit", "data-asset": image["asset"]}, children=said))
    if applied and block and not block.first(".change-note"):
        block.append(Node("p", {"class": "change-note"}, children=[text("Modified from the original: wording updated for inclusive language.")]))
    page.note("edits", "edits applied", applied)
    page.note("edits", "edits whose words are gone", stale)


def in_manner(original: str, new: str) -> str:
    """new with the capitals of what it replaces."""
    if len(original) > 1 and original == original.upper() and re.search("[A-Z]", original):
        return new.upper()
    return new[:1].upper() + new[1:] if original[:1] != original[:1].lower() else new


def frame(page: Page, footer: str = "Continue to the next page.") -> None:
    """The page as published: its first second-level heading, or the section's title, as banner, the rest in a frame, and a footer."""
    if page.root.first(".page-frame"):
        return
    title, banner = page.root.first("h2"), []
    if not title and (page.facts["title"] or "").strip():
        title = Node("h2", {"class": "added-title"}, children=[text(page.facts["title"].strip())])
        page.root.append(title)
    if title:
        title.attrs["class"] = " ".join(dict.fromkeys([*title.classes(), "page-title"]))
        title.fill(Node("strong", children=title.children[:]))
        if title.parent is page.root:  # one inside another element stays where it is
            title.remove()
            banner = [title]
    strong = 0
    for heading in page.root.all("h3, h4"):
        if not heading.first("strong"):
            heading.fill(Node("strong", children=heading.children[:]))
        strong += 1
    body = Node("div", {"class": "page-body"}, children=page.root.children[:])
    page.root.append(Node("div", {"class": "page-frame"}, children=[*banner, body, Node("div", {"class": "page-footer"}, children=[Node("p", children=[text(footer)])])]))
    page.note("frame", "banner, headings and footer set", strong + bool(title) + 1)


STEPS: tuple[Callable[[Page], None], ...] = (
    strip_chrome, absolute_addresses, recover_equations, relevel_headings, restructure_figures, fix_tables, fix_links, text_semantics, ids_of_blocks, insert_images, fix_contrast, resolve_alt, append_source, apply_edits, frame,
)


def compiled(source: str, facts: dict, publisher: Publisher, steps: tuple[Callable[[Page], None], ...] = STEPS) -> tuple[str, str | None, list, list]:
    """(html, error, notes, queue) of one section. A step that fails ends this section only: nothing half done is given out."""
    try:
        page = Page(parse(source), publisher, facts)
        for step in steps:
            step(page)
        return write(page.root).strip(), None, page.notes, page.queue
    except Exception as e:
        return "", f"{type(e).__name__}: {e}", [], []
