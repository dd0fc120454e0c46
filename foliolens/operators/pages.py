"""Pages as tables: tokens, attributes, elements; filters and transforms over them.

A token row is one tag, text run, or raw block of a page, in page order. Everything but what needs a stack of open
elements is built from Spark expressions. The stack runs over whole pages in Arrow batches, once they are sorted by
page and place, and takes time in proportion to the tokens: what an element holds is told by the numbers
of the elements around each token, never by pairing elements with tokens.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import color as C
from foliolens.functions import selectors
from foliolens.functions import text as T
from foliolens.operators import rules

#: Comments, raw elements, declarations, tags whose quotes may hold '>', text, and a stray '<'. Possessive, so long tags can't exhaust the stack.
TOKEN = (
    r"(?s)<!--.*?(?:-->|\z)|<(?i:script)\b.*?</(?i:script)(?=[\s/>])[^>]*>|<(?i:style)\b.*?</(?i:style)(?=[\s/>])[^>]*>|<[!?][^>]*>?"
    r"""|</?[a-zA-Z][a-zA-Z0-9:-]*(?:"[^"]*+"|'[^']*+'|[^"'>]++)*+>|[^<]+|<"""
)
ATTRIBUTE = r"""(?s)([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def tokenize(df: DataFrame, key: str, html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, pos, kind, tag, attrs, text, raw): kind is open, close, text or raw; comments and declarations are dropped. `carry` names columns of the page that its tokens keep."""
    raw = F.col("raw")
    found = df.select(F.col(key), *carry, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(TOKEN), F.lit(0))).alias("pos", "raw")).filter(~(raw.startswith("<!") | raw.startswith("<?")))
    # What TOKEN finds begins with "<" only where it is a tag, or a stray "<" alone.
    text = ~raw.startswith("<") | (raw == "<")
    tag = F.lower(F.regexp_extract("raw", r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
    found = found.withColumn("tag", F.when(~text, tag))
    tag = F.col("tag")
    kind = F.when(tag.isNull(), "text").when(raw.startswith("</"), "close").when(tag.isin(*rules.DROPPED_SUBTREES) & raw.rlike(r"(?s)^<[a-zA-Z].*<"), "raw").otherwise("open")
    body = F.regexp_replace(F.substring(raw, F.length(tag) + 2, F.length(raw)), r"/?>$", "")
    pieces = F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(0))

    def attribute(p: Column) -> Column:
        value = F.regexp_extract(p, r"(?s)=\s*(.*)$", 1)
        return F.struct(F.lower(F.regexp_extract(p, r"^[^\s=]+", 0)).alias("name"), T.decode_entities(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")).alias("value"))

    none = F.array().cast("array<struct<name:string,value:string>>")
    listed = F.when(F.length(raw) > F.length(tag) + 2, F.transform(pieces, attribute)).otherwise(none)
    told = found.select(key, *carry, "pos", kind.alias("kind"), "tag", "raw")
    return told.select(key, *carry, "pos", "kind", "tag", F.when(F.col("kind") == "open", listed).alias("attrs"), F.when(F.col("kind") == "text", raw).alias("text"), "raw")


def serialize(tokens: DataFrame, key: str) -> DataFrame:
    """(key, html): the tokens' sources in order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "raw")))
    return tokens.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p.raw), "").alias("html"))


def attribute(name: str) -> Column:
    """The first value of an attribute of a token; null where it has none."""
    return F.get(F.filter("attrs", lambda a: a["name"] == name), 0)["value"]


def attributes(tokens: DataFrame, key: str) -> DataFrame:
    """(key, pos, tag, ord, name, value): one row per attribute, duplicates included."""
    return tokens.filter("kind = 'open'").select(key, "pos", "tag", F.posexplode("attrs").alias("ord", "a")).select(key, "pos", "tag", "ord", "a.name", "a.value")


BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "figcaption", "caption")
REFERENCES = ("p", "h1", "h2", "h3", "h4", "h5", "h6")


def by_page(tokens: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """tokens with the pages whole in partitions, in order. `whole`: they are so already, as rows that tokenize() cut from a table of one row
    a page and that were only filtered and given columns since; they aren't shuffled and sorted then."""
    return tokens if whole else tokens.repartition(key).sortWithinPartitions(key, "pos")


class Stack:
    """Open elements of the page that is being read: a close tag ends the nearest open one of its name and all inside it; one that matches none is ignored."""

    def __init__(self):
        self.open: list[tuple[int, str]] = []
        self.counts: dict[str, int] = {}
        self.next = 0

    def step(self, kind: str, tag: str | None, closed: bool) -> tuple[int | None, list[int]]:
        """The element that a tag opens or closes or that holds a text, and the elements that end with the token."""
        if kind == "text":
            return (self.open[-1][0] if self.open else None), []
        if kind == "close":
            if not self.counts.get(tag):
                return None, []
            ended = []
            while not ended or self.last != tag:
                el, self.last = self.open.pop()
                self.counts[self.last] -= 1
                ended.append(el)
            return ended[-1], ended
        el, self.next = self.next, self.next + 1
        if kind == "open" and tag not in rules.VOID_TAGS and not closed:
            self.open.append((el, tag))
            self.counts[tag] = self.counts.get(tag, 0) + 1
            return el, []
        return el, [el]


def elements(tokens: DataFrame, key: str, paths: bool = True, whole: bool = False) -> DataFrame:
    """(key, el, parent, open_pos, close_pos, depth, tag, path): the element tree. Paths take room in proportion to the depth; without them `path` is null."""
    kind = dict(tokens.dtypes)[key]
    fields = ["el", "parent", "open_pos", "close_pos", "depth", "tag", "path"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]

    def run(batches):
        page, stack, rows, last = None, Stack(), [], 0

        def made(key_type):
            for el, _ in stack.open:
                rows[el][3] = last
            columns = [list(c) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([page[0]] * len(rows), key_type), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [key, *fields])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                value, pos, what, tag, closed = row
                if page is None or page[0] != value:
                    if rows:
                        yield made(batch.schema.field(0).type)
                    page, stack, rows = (value,), Stack(), []
                held = [t for _, t in stack.open] if paths and what in ("open", "raw") else None
                parent, depth, last = (stack.open[-1][0] if stack.open else None), len(stack.open), pos
                el, ended = stack.step(what, tag, closed)
                if what in ("open", "raw"):
                    rows.append([el, parent, pos, pos, depth, tag, held])
                for e in ended:
                    rows[e][3] = pos
        if rows:
            yield made(batch.schema.field(0).type)

    columns = by_page(tokens.select(key, "pos", "kind", "tag", F.col("raw").endswith("/>").alias("closed")), key, whole)
    return columns.mapInArrow(run, f"`{key}` {kind}, el int, parent int, open_pos int, close_pos int, depth int, tag string, path array<string>")


def _placed(tokens: DataFrame, key: str, fields: list[str], whole: bool, sets: dict):
    """tokens with what their place among the elements is found from, and the function that finds it: by batch the columns of enclosing() as lists, the outermost elements as (el, tag, rule)."""
    bits: dict = {}  # conditions on tokens, by number
    # By set and rule: the numbers of a selector's conditions, from the outermost element in.
    rules_of = [[(rule, [bits.setdefault(c, len(bits)) for c in chain]) for rule, one in enumerate(m) for chain in selectors.parse(one)] if isinstance(m, tuple) else [(0, [bits.setdefault(n, len(bits))])] for n, m in sets.items()]
    if len(bits) > 63:
        raise ValueError("more than 63 different conditions in one pass")
    test = lambda c: c.column() if isinstance(c, selectors.Compound) else F.coalesce(sets[c], F.lit(False))
    marks = sum((F.when(test(c), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for c, i in bits.items()), F.lit(0).cast("long"))
    single = [[(rule, 1 << chain[0]) for rule, chain in rules_ if len(chain) == 1] for rules_ in rules_of]
    descents = [(i, rule, [1 << b for b in chain]) for i, rules_ in enumerate(rules_of) for rule, chain in rules_ if len(chain) > 1]
    n_sets = len(sets)

    def place(batches):
        page, stack = None, Stack()
        outer: list[tuple] = []  # by open element
        before: list[int | None] = [None]  # by open element, after that of the page itself
        met: list[tuple] = [(0,) * len(descents)]  # likewise: how many conditions of each descent the elements around have met, outermost first
        fitting: dict[int, list] = {}
        nowhere = (None,) * n_sets
        for batch in batches:
            els, refs, held = [], [], []
            for value, what, tag, closed, mark in zip(*(batch.column(c).to_pylist() for c in (key, "kind", "tag", "_closed", "_marks")), strict=True):
                if page is None or page[0] != value:
                    page, stack, outer, before, met = (value,), Stack(), [], [None], met[:1]
                mine, reference = (outer[-1] if outer else nowhere), before[-1]
                size = len(stack.open)
                el, ended = stack.step(what, tag, closed)
                if what in ("open", "raw"):
                    if mark not in fitting:
                        fitting[mark] = [next((rule for rule, bit in own if mark & bit), None) for own in single]
                    fits, so_far = fitting[mark], met[-1]
                    if descents:
                        fits, so_far = fits[:], list(so_far)
                        for d, (i, rule, chain) in enumerate(descents):
                            if so_far[d] == len(chain) - 1:
                                if mark & chain[-1] and (fits[i] is None or rule < fits[i]):
                                    fits[i] = rule
                            elif mark & chain[so_far[d]]:
                                so_far[d] += 1
                    mine = tuple([a or (None if rule is None else (el, tag, rule)) for a, rule in zip(mine, fits, strict=True)])
                    if len(stack.open) > size:
                        outer.append(mine)
                        before.append(reference)
                        met.append(tuple(so_far))
                elif ended:
                    mine = outer[-len(ended)]
                    del outer[-len(ended) :], before[-len(ended) :], met[-len(ended) :]
                    reference = before[-1]
                    if tag in REFERENCES:
                        before[-1] = el
                els.append(el)
                refs.append(reference)
                held.append(mine)
            yield batch, els, refs, list(zip(*held, strict=True)) if held else [()] * n_sets

    marked = tokens.withColumns({"_closed": F.col("raw").endswith("/>"), "_marks": F.when(F.col("kind").isin("open", "raw"), marks).otherwise(F.lit(0).cast("long"))})
    return by_page(marked.select(*dict.fromkeys([*fields, key, "pos", "kind", "tag", "_closed", "_marks"])), key, whole), place


def enclosing(tokens: DataFrame, key: str, keep: list[str] | None = None, whole: bool = False, **sets: tuple[str, ...] | Column) -> DataFrame:
    """tokens (or their columns `keep`) with `el`, the element that a tag opens or closes or that holds a text (numbered as in elements()), with `before`, the
    paragraph or heading that ended last beside it or beside what holds it, and for each named set of selectors, or condition on the token that
    opens an element, the outermost element of that kind that is or holds the token's element, as (el, tag, rule): rule is the number of its first selector that fits.

    Selectors with attributes need the column `attrs`. What a selector asks of one element is a condition on its token; descent is followed on the stack.
    `whole` is as by_page() says.
    """
    fields, names = keep or tokens.columns, list(sets)
    rows, place = _placed(tokens, key, fields, whole, sets)

    def run(batches):
        for batch, els, refs, held in place(batches):
            structs = []
            for column in held:
                parts = [pa.array([h and h[i] for h in column], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32()))]
                structs.append(pa.StructArray.from_arrays(parts, ["el", "tag", "rule"], mask=parts[0].is_null()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in fields], pa.array(els, pa.int32()), pa.array(refs, pa.int32()), *structs], [*fields, "el", "before", *names])

    kinds = dict(tokens.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in fields) + ", el int, before int" + "".join(f", `{n}` struct<el:int,tag:string,rule:int>" for n in sets)
    return rows.mapInArrow(run, schema)


def joined_blocks(
    tokens: DataFrame, key: str, block: tuple[str, ...] | Column, join: tuple[str, ...], first: tuple[str, ...] = (), without: tuple[str, ...] = (), but: tuple[str, ...] = (), take: Column | None = None, loose: Column | None = None, whole: bool = False
) -> DataFrame:
    """(key, n, el, tag, join, first): one row for each outermost element that `block` means, numbered in order from 0 by page, in one pass over the page: the strings `join` of its tokens
    joined in order, and the strings `first` of the first of them, named first_*. Only tokens that meet `take` count, none in elements that `without` selects or whose outermost element has a tag
    in `but`. Tokens outside that meet `loose` are rows of their own, with a negative el and no tag."""
    flags = {"_take": F.lit(True) if take is None else F.coalesce(take, F.lit(False)), "_loose": F.lit(False) if loose is None else F.coalesce(loose, F.lit(False))}
    sets = {"block": block} | ({"_left_out": without} if without else {})
    columns, asked = list(dict.fromkeys([*join, *first])), [key, "pos", *flags]
    rows, place = _placed(tokens.withColumns(flags), key, [key, "pos", *flags, *columns], whole, sets)
    names = [key, "n", "el", "tag", *join, *[f"first_{c}" for c in first]]

    def run(batches):
        now, n, keys, made = None, 0, [], []

        def batch_of(key_type):
            by = list(zip(*made, strict=True)) if made else [()] * (len(names) - 1)
            texts = [["".join(parts) for parts in c] for c in by[3 : 3 + len(join)]]
            arrays = [pa.array(keys, key_type), pa.array(by[0], pa.int32()), pa.array(by[1], pa.int32()), *[pa.array(c, pa.string()) for c in (by[2], *texts, *by[3 + len(join) :])]]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch, _, _, held in place(batches):
            values = {c: batch.column(c).to_pylist() for c in columns}
            joins, firsts = [values[c] for c in join], [values[c] for c in first]
            out = held[1] if without else [None] * len(held[0])
            for i, (value, pos, taken, single, around, left_out) in enumerate(zip(*(batch.column(c).to_pylist() for c in asked), held[0], out, strict=True)):
                if not taken or left_out is not None or around is None and not single:
                    continue
                el, tag = around[:2] if around else (-pos - 1, None)
                if tag in but:
                    continue
                if now != (el, value):
                    n = n + 1 if now is not None and now[1] == value else 0
                    now = (el, value)
                    keys.append(value)
                    made.append((n, el, tag, *[[] for _ in join], *[c[i] for c in firsts]))
                for parts, c in zip(made[-1][3:], joins, strict=False):
                    if c[i] is not None:
                        parts.append(c[i])
            if len(keys) > 1:  # the last may go on in the next batch
                last = keys.pop(), made.pop()
                yield batch_of(batch.schema.field(0).type)
                keys, made = [last[0]], [last[1]]
            kind = batch.schema.field(0).type
        if keys:
            yield batch_of(kind)

    return rows.mapInArrow(run, f"`{key}` {dict(tokens.dtypes)[key]}, n int, el int, tag string" + "".join(f", `{n}` string" for n in names[4:]))


def joined_text(texts: DataFrame, *by) -> DataFrame:
    """The texts of token rows in order, joined, decoded and collapsed."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t.text), "")
    return texts.groupBy(*by).agg(T.collapse(T.decode_entities(joined)).alias("text"))


#: What the compiler adds to a page; it is no text of the section.
ADDED = (".source-and-license", ".page-footer", ".added-title")


def text_blocks(tokens: DataFrame, key: str, tags: tuple[str, ...] = BLOCKS, without: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """(key, el, tag, text) of the outermost text blocks, but for those in elements that `without` selects."""
    made = joined_blocks(tokens, key, tags, ("text",), without=without, take=F.col("kind") == "text", whole=whole)
    return made.select(key, "el", "tag", T.collapse(T.decode_entities("text")).alias("text"))


def block_ids(tokens: DataFrame, key: str, tags: tuple[str, ...] = BLOCKS, without: tuple[str, ...] = ADDED, whole: bool = False) -> DataFrame:
    """(key, el, tag, own, block_id) of the outermost text blocks in order: their own ids, or made ones by section and place, where what `without` selects doesn't count."""
    opened = joined_blocks(tokens.withColumn("own", attribute("id")), key, tags, (), ("own",), without, take=F.col("kind") == "open", whole=whole)
    return opened.select(key, "el", "tag", F.col("first_own").alias("own"), _block_id(key, F.col("n"), "first_own").alias("block_id"))


def section_text(blocks: DataFrame, key: str) -> DataFrame:
    """(key, text): a page's non-blank block texts in order, an empty line between them."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("el", "text"))), lambda b: b.text)
    return blocks.filter("text <> ''").groupBy(key).agg(F.array_join(parts, "\n\n").alias("text"))


CONTAINERS = ("main", "article", "body")
CHROME = ("nav", "header", "footer", "aside", "form", "script", "style")
# Where books on the web hold their content (the first of any of these, else the page), and what isn't content there.
BOOK_CONTAINERS = ("section.mt-content-container, .entry-content, .book-content, main, article", "body")
BOOK_CHROME = (
    "script", "style", "nav", "header", "footer", "aside", "form", ".mt-sortable-listings-container", ".mt-subpage-listings-container",
    ".mt-topic-hierarchy-listings", ".mt-category-container", ".noinclude", ".noindex",
)


def main_content(tokens: DataFrame, key: str, containers: tuple[str, ...] = CONTAINERS, chrome: tuple[str, ...] = CHROME) -> DataFrame:
    """(key, container, n_chrome, html) of each page's first container of the first kind that it has: its tokens without the chrome inside it. Both are selectors."""
    names = [f"_c{i}" for i in range(len(containers))]
    marked = enclosing(tokens, key, [key, "pos", "kind", "tag", "raw"], chrome=chrome, **{n: (c,) for n, c in zip(names, containers, strict=True)})
    page = Window.partitionBy(key)
    own = [F.col(f"{n}.el") for n in names]
    marked = marked.withColumns({f"_first{i}": F.min(c).over(page) for i, c in enumerate(own)})
    container, inside = F.lit(None).cast("string"), F.lit(False)
    for i in reversed(range(len(containers))):
        has = F.col(f"_first{i}").isNotNull()
        container, inside = F.when(has, F.lit(containers[i])).otherwise(container), F.when(has, F.coalesce(own[i] == F.col(f"_first{i}"), F.lit(False))).otherwise(inside)
    held = marked.withColumns({"container": container, "_inside": inside}).filter("_inside AND el IS NOT NULL")  # a close tag that ends nothing is dropped
    shown = F.when(F.col("chrome").isNull(), F.struct("pos", "raw"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda p: p.raw), "")
    return held.groupBy(key, "container").agg(F.count_distinct("chrome.el").alias("n_chrome"), html.alias("html"))


FRAME = ("nav", "header", "footer", "aside", "form")


def strip_chrome(tokens: DataFrame, key: str, chrome: tuple[str, ...] = FRAME) -> DataFrame:
    """tokens without the elements that these selectors mean and all inside them."""
    return enclosing(tokens, key, chrome=chrome).filter("chrome IS NULL").select(*tokens.columns)


def chrome_counts(tokens: DataFrame, key: str, chrome: tuple[str, ...] = FRAME, whole: bool = False) -> DataFrame:
    """(key, selector, n) of the outermost elements that strip_chrome() removes, by the first selector that fits them."""
    held = enclosing(tokens, key, [key, "pos"], whole, chrome=chrome).filter("chrome IS NOT NULL")
    named = F.array(*[F.lit(c) for c in chrome])
    return held.groupBy(key, F.get(named, F.col("chrome.rule")).alias("selector")).agg(F.count_distinct("chrome.el").alias("n"))


def filter_tags(tokens: DataFrame) -> DataFrame:
    """tokens of allowed tags and texts; other tags are unwrapped, script and style go with their content."""
    return tokens.filter((F.col("kind") == "text") | T.one_of("tag", rules.ALLOWED_TAGS) & (F.col("kind") != "raw"))


def shift_headings(tokens: DataFrame, key: str) -> DataFrame:
    """tokens with headings one level down in pages that hold an h1, to h6 at most."""
    has = F.max(F.when((F.col("tag") == "h1") & (F.col("kind") == "open"), 1).otherwise(0)).over(Window.partitionBy(key)) == 1
    number = F.least(F.lit(6), F.substring("tag", 2, 1).cast("int") + 1)
    return tokens.withColumn("tag", F.when(has & F.col("tag").rlike("^h[1-6]$"), F.concat(F.lit("h"), number.cast("string"))).otherwise(F.col("tag")))


def removed_semantic(tokens: DataFrame, key: str) -> DataFrame:
    """(key, tag, first_pos) of tags that carry meaning and are not allowed, after the heading shift."""
    gone = tokens.filter((F.col("kind") == "open") & T.one_of("tag", [t for t in rules.SEMANTIC_TAGS if t not in rules.ALLOWED_TAGS]))
    return gone.groupBy(key, "tag").agg(F.min("pos").alias("first_pos"))


def _listed(values: dict[str, list[str]]) -> Column:
    return F.expr(T.literal(values))


def allowed_attribute(tag="tag", name="name") -> Column:
    """Whether (tag, name) may stay: global, ARIA, data-* and per-element names, never an event handler."""
    t, n = T._col(tag), T._col(name)
    own = F.coalesce(F.array_contains(_listed({k: v.split() for k, v in rules.ELEMENT_ATTRIBUTES.items()})[t], n), F.lit(False))
    return (n.isin(*rules.GLOBAL_ATTRIBUTES, *rules.ARIA_ATTRIBUTES) | n.startswith("data-") | own) & ~n.startswith("on")


def scheme_of(c) -> Column:
    """A URL's scheme, controls and blanks ignored; empty where it has none."""
    return F.lower(F.regexp_extract(F.regexp_replace(T._col(c), r"[\x00-\x20]", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def url_verdict(tag="tag", name="name", value="value") -> Column:
    """For (tag, name, value): 'ok', 'stripped' if the scheme isn't permitted there, null where the attribute holds no URL. Addresses of packaged files stand in pictures only, and in their exact form."""
    v = T._col(value)
    schemes = _listed({f"{t}.{n}": ["", *s] for t, names in rules.URL_ATTRIBUTES.items() for n, s in names.items()})[F.concat(T._col(tag), F.lit("."), T._col(name))]
    packaged = F.regexp_replace(v, r"[\x00-\x20]", "").startswith(rules.FILEBASE)
    exact = v.rlike(rf"^\Q{rules.FILEBASE}/{rules.PACKAGED_FOLDER}/\E[A-Za-z0-9._-]+\.(?:png|jpe?g|gif|webp)\z") & ~v.contains("..") & (T._col(tag) == "img") & (T._col(name) == "src")
    return F.when(schemes.isNotNull(), F.when(F.when(packaged, exact).otherwise(F.array_contains(schemes, scheme_of(v))), "ok").otherwise("stripped"))


def link_target(c) -> Column:
    """Links open in their own page or a new one; other names mean a new one, blank ones nothing."""
    v = F.lower(F.trim(T._col(c)))
    return F.when(v == "_self", "_self").when(v != "", "_blank")


def kept_value(name, value) -> Column:
    """An allowed attribute's value under the policy; null where nothing is left of it."""
    n, v = T._col(name), T._col(value)
    return F.when(n == "target", link_target(v)).when(n == "style", F.nullif(filter_style(v), F.lit(""))).otherwise(v)


def filter_attributes(attrs: DataFrame, key: str) -> DataFrame:
    """Attribute rows that survive: allowed, with a permitted scheme and something left of their value, the first of each name."""
    kept = attrs.filter(allowed_attribute()).withColumn("url", url_verdict()).filter("url IS NULL OR url = 'ok'").withColumn("value", kept_value("name", "value")).filter("value IS NOT NULL")
    first = Window.partitionBy(key, "pos", "name").orderBy("ord")
    return kept.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "url")


def with_kept_attributes(tokens: DataFrame) -> DataFrame:
    """tokens with the attributes that survive in `attrs`, as filter_attributes() says, without leaving the row."""
    allowed = F.filter("attrs", lambda a: allowed_attribute("tag", a["name"]) & (F.coalesce(url_verdict("tag", a["name"], a["value"]), F.lit("ok")) == "ok"))
    valued = F.filter(F.transform(allowed, lambda a: F.struct(a["name"].alias("name"), kept_value(a["name"], a["value"]).alias("value"))), lambda a: a["value"].isNotNull())
    names = F.transform("_kept", lambda a: a["name"])
    first = F.when(F.size(F.array_distinct(names)) == F.size("_kept"), F.col("_kept")).otherwise(F.filter("_kept", lambda a, i: F.array_position(names, a["name"]) == i + 1))
    return tokens.withColumn("_kept", F.when(F.size("attrs") > 0, valued)).withColumn("attrs", first).drop("_kept")


def stripped_urls(attrs: DataFrame, key: str) -> DataFrame:
    """(key, target) of attributes whose URL is stripped, as tag.attribute, once each."""
    return attrs.filter(url_verdict() == "stripped").select(key, F.concat_ws(".", "tag", "name").alias("target")).distinct()


def filter_style(c) -> Column:
    """Declarations of permitted properties whose url() parts are web addresses, in order."""
    parts = F.regexp_extract_all(T._col(c), F.lit(r"""(?:"[^"]*"|'[^']*'|\([^)]*\)|[^;"'(])+"""), F.lit(0))
    name = lambda d: F.lower(F.trim(F.regexp_extract(d, r"^([^:]*):", 1)))
    roots = "|".join(rules.STYLE_ROOTS)
    safe = lambda d: ~F.lower(d).rlike(r"url\(\s*[\"']?\s*(?!https?:)[a-z][a-z0-9+.-]*:")
    kept = F.filter(parts, lambda d: (name(d).isin(*rules.STYLE_PROPERTIES) | name(d).rlike(f"^(?:{roots})-")) & safe(d))
    told = F.transform(kept, lambda d: F.struct(name(d).alias("n"), F.trim(F.regexp_extract(d, r"(?s):(.*)$", 1)).alias("v")))
    return F.array_join(F.transform(F.filter(told, lambda d: d["v"] != ""), lambda d: F.concat(d["n"], F.lit(": "), d["v"])), "; ")


def content_counts(tokens: DataFrame, key: str) -> DataFrame:
    """Per page: headings, tables, images, links, equations, notes, and pictures whose bytes aren't packaged."""
    opened = lambda cond: F.count_if((F.col("kind") == "open") & cond).alias
    packaged = F.coalesce(attribute("src"), F.lit("")).startswith(rules.FILEBASE)
    return tokens.groupBy(key).agg(
        opened(F.col("tag").rlike("^h[1-6]$"))("headings"), opened(F.col("tag") == "table")("tables"), opened(F.col("tag") == "img")("images"),
        opened(F.col("tag") == "a")("links"), opened(F.col("tag") == "math")("equations"), opened((F.col("tag") == "aside") & (attribute("role") == "note"))("notes"), opened((F.col("tag") == "img") & ~packaged)("unavailable"),
    )


def headings(tokens: DataFrame, key: str) -> DataFrame:
    """(key, pos, level, n): headings in order, numbered from 1."""
    found = tokens.filter((F.col("kind") == "open") & F.col("tag").rlike("^h[1-6]$")).select(key, "pos", F.substring("tag", 2, 1).cast("int").alias("level"))
    return found.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos")))


def relevel(found: DataFrame, key: str) -> DataFrame:
    """Headings that skip no level: shifted so that the least is 2, then t_i = min(c_i, t_(i-1) + 1) in closed form."""
    least = F.min("level").over(Window.partitionBy(key))
    wanted = F.least(F.lit(6), F.greatest(F.lit(2), F.col("level") - least + 2))
    running = F.min(F.col("wanted") - F.col("n")).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("wanted", wanted).withColumn("new_level", F.col("n") + F.least(F.lit(1), running)).drop("wanted")


def text_semantics(tokens: DataFrame, key: str | None = None) -> DataFrame:
    """tokens with b as strong, i as em, and underlines unwrapped; with `key`, those inside links stay."""
    tag = F.when(F.col("tag") == "b", "strong").when(F.col("tag") == "i", "em").otherwise(F.col("tag"))
    step = F.when(F.col("tag") == "a", F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1)).otherwise(0)
    linked = F.sum(step).over(Window.partitionBy(key).orderBy("pos")) > 0 if key else F.lit(False)
    marked = tokens.withColumn("_linked", linked)
    return marked.filter((F.col("kind") == "text") | ~F.coalesce(F.col("tag") == "u", F.lit(False)) | F.col("_linked")).withColumn("tag", tag).drop("_linked")


def links(tokens: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, pos, href, text): links with the text up to the next tag; `carry` names columns of the page that its tokens keep."""
    after = F.lead(F.when(F.col("kind") == "text", F.col("text"))).over(Window.partitionBy(key).orderBy("pos"))
    href = F.get(F.filter("attrs", lambda a: a["name"] == "href"), 0)["value"]
    return tokens.withColumn("after", after).filter("kind = 'open' AND tag = 'a'").select(key, *carry, "pos", href.alias("href"), T.collapse(T.decode_entities(F.coalesce("after", F.lit("")))).alias("text"))


def absolutize(link, base) -> Column:
    """A link against an absolute base: other schemes and absolute links stay, // takes the scheme, / the host, others the folder; dot segments are resolved."""
    b = T._col(base)
    scheme, origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)

    def folder() -> Column:
        path = F.regexp_replace(F.regexp_replace(F.substring(b, F.length(origin) + 1, F.lit(1 << 20)), "[?#].*$", ""), "[^/]*$", "")
        return F.when(path == "", "/").otherwise(path)

    def resolved(u: Column, path: Column) -> Column:
        whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder(), path))
        steps = lambda w: F.aggregate(
            F.split(w, "/"), F.array().cast("array<string>"),
            lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.lit(1), F.size(a) - 1))).when(s == ".", a).otherwise(F.concat(a, F.array(s))),
        )
        plain = C.let(whole, lambda w: F.when(w.contains("/."), F.array_join(steps(w), "/")).otherwise(w))
        tail = F.when(path.rlike(r"(?:^|/)\.\.?$"), "/").otherwise("")
        return F.concat(origin, plain, tail, F.substring(u, F.length(path) + 1, F.lit(1 << 20)))

    def made(u: Column) -> Column:
        return (
            F.when(u.isNull() | (scheme_of(u) != ""), u).when(u.startswith("//"), F.concat(scheme, u)).when(u.startswith("#") | (u == ""), F.concat(F.regexp_replace(b, "#.*$", ""), u))
            .when(u.startswith("?"), F.concat(F.regexp_replace(b, "[?#].*$", ""), u)).otherwise(C.let(F.regexp_extract(u, r"^([^?#]*)", 1), lambda path: resolved(u, path)))
        )

    return C.let(F.trim(T._col(link)), made)


def flagged(tokens: DataFrame, key: str) -> DataFrame:
    """tokens with `shifted`, the tag after the heading shift, and with `issues`, what markup alone decides: h1 in the body, skipped heading
    levels, links without text, images without alt, repeated ids. One shuffle by page serves all of them."""
    order, page = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key)
    opened = F.col("kind") == "open"
    heading = opened & F.col("tag").rlike("^h[1-6]$")
    own_id = F.when(opened, F.get(F.filter("attrs", lambda a: a["name"] == "id"), 0)["value"])
    marked = tokens.withColumns({"_level": F.when(heading, F.substring("tag", 2, 1).cast("int")), "_id": own_id})
    after = F.lead(F.when(F.col("kind") == "text", F.col("text"))).over(order)
    marked = marked.withColumns({
        "_before": F.last("_level", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_after": after, "_h1": F.max(F.col("_level") == 1).over(page),
        "_nth": F.row_number().over(Window.partitionBy(key, "_id").orderBy("pos")),
    })
    issue = lambda test, name, impact: F.when(test, F.struct(F.lit(name).alias("id"), F.lit(impact).alias("impact")))
    issues = F.array_compact(F.array(
        issue(F.col("_level") == 1, "page-has-heading-one", "moderate"), issue(F.col("_level") > F.col("_before") + 1, "heading-order", "moderate"),
        issue(opened & (F.col("tag") == "a") & (T.collapse(T.decode_entities(F.coalesce("_after", F.lit("")))) == ""), "link-name", "serious"),
        issue(opened & (F.col("tag") == "img") & ~F.exists("attrs", lambda a: a["name"] == "alt"), "image-alt", "critical"), issue(F.col("_id").isNotNull() & (F.col("_nth") > 1), "duplicate-id", "minor"),
    ))
    number = F.least(F.lit(6), F.substring("tag", 2, 1).cast("int") + 1)
    shifted = F.when(F.col("_h1") & F.col("tag").rlike("^h[1-6]$"), F.concat(F.lit("h"), number.cast("string"))).otherwise(F.col("tag"))
    return marked.withColumns({"issues": issues, "shifted": shifted}).drop("_level", "_id", "_before", "_after", "_h1", "_nth")


#: An http address that names no host, or one that can't be.
UNREADABLE = r"(?i)^https?:(?!//(?:[^/?#@\s]*@)?(?:\[[0-9a-f:.]+\]|[^\s\[\]<>^`{|}/?#:@]+)(?::[0-9]*)?(?:[/?#]|$))"


def absolute_urls(tokens: DataFrame, base: str, xref: str | None = None) -> DataFrame:
    """tokens with the addresses in `attrs` made absolute against the column `base`: fragments, packaged files and links inside the book (those that match `xref`) stay,
    as do addresses that can't be read; plain http becomes https for what a page loads and for its own host. `rewritten`, `upgraded` and `failed` count them by token."""
    slots = [f"{t}.{n}" for t, names in rules.URL_ATTRIBUTES.items() for n in names if n != "srcset"]
    loads = F.lit(["src", "poster", "data"])

    def told(a):
        held = F.concat(F.col("tag"), F.lit("."), a["name"]).isin(*slots) & (a["value"] != "") & ~a["value"].startswith("#") & ~a["value"].startswith(rules.FILEBASE)
        held = held & ~a["value"].rlike(xref) if xref else held

        def judged(full):
            bad = full.rlike(UNREADABLE)
            upgrade = ~bad & F.lower(full).startswith("http://") & (F.array_contains(loads, a["name"]) | (T.host_of(full) == T.host_of(base)))
            value = F.when(bad, a["value"]).when(upgrade, F.concat(F.lit("https"), F.substring(full, 5, 1 << 20))).otherwise(full)
            return F.struct(a["name"].alias("name"), value.alias("value"), upgrade.alias("up"), a["value"].alias("was"), bad.alias("bad"))

        same = F.struct(a["name"].alias("name"), a["value"].alias("value"), F.lit(False).alias("up"), a["value"].alias("was"), F.lit(False).alias("bad"))
        return F.when(held, C.let(absolutize(a["value"], base), judged)).otherwise(same)

    made = tokens.withColumn("_made", F.when(F.size("attrs") > 0, F.transform("attrs", told)))
    count = lambda test: F.greatest(F.lit(0), F.coalesce(F.size(F.filter("_made", test)), F.lit(0)))
    counted = made.withColumns({"rewritten": count(lambda a: a["value"] != a["was"]), "upgraded": count(lambda a: a["up"]), "failed": count(lambda a: a["bad"])})
    new = F.transform("_made", lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value")))
    return counted.withColumn("attrs", F.coalesce(new, F.col("attrs"))).drop("_made")


def structural_issues(tokens: DataFrame, key: str) -> DataFrame:
    """(key, id, impact, pos): the issues that markup alone decides."""
    return flagged(tokens, key).select(key, F.explode("issues").alias("i"), "pos").select(key, "i.id", "i.impact", "pos")


def table_issues(tokens: DataFrame, key: str) -> DataFrame:
    """(key, id, impact, pos) of the outermost tables with rows but no header cell that aren't declared as layout."""
    marked = enclosing(tokens.withColumn("role", attribute("role")), key, [key, "pos", "kind", "tag", "raw", "role"], table=("table",)).filter("table IS NOT NULL AND kind = 'open'")
    own = F.col("table.el") == F.col("el")
    by = marked.groupBy(key, F.col("table.el").alias("_el")).agg(F.min("pos").alias("pos"), F.max(F.when(own, F.col("role"))).alias("role"), F.bool_or(F.col("tag") == "th").alias("th"), F.bool_or(F.col("tag") == "tr").alias("tr"))
    bare = by.filter(F.col("tr") & ~F.col("th") & ~F.coalesce(F.col("role").isin("presentation", "none"), F.lit(False)))
    return bare.select(key, F.lit("td-has-header").alias("id"), F.lit("critical").alias("impact"), "pos")


def audit(checks: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, check_order, id, severity, category) of the results of several checks (key, id, severity, category), in the order in which they are given."""
    found = None
    for n, (_, rows) in enumerate(checks.items()):
        part = rows.select(key, F.lit(n).alias("check_order"), "id", "severity", "category")
        found = part if found is None else found.unionByName(part)
    return found


def severity_of(impact) -> Column:
    named = F.create_map(*[F.lit(x) for pair in rules.IMPACTS.items() for x in pair])
    return F.coalesce(named[T._col(impact)], F.lit("error"))


def map_issues(found: DataFrame) -> DataFrame:
    """(…, severity, category) from a rule's id and impact: null impact is an error, incomplete results only alert."""
    severity = F.coalesce(severity_of("impact"), F.lit("error"))
    category = F.when(F.col("id").contains("color-contrast"), "contrast").when(F.col("id").startswith("aria-"), "aria").when(T.one_of("id", rules.STRUCTURE_RULES), "structure")
    incomplete = F.coalesce(F.col("incomplete"), F.lit(False)) if "incomplete" in found.columns else F.lit(False)
    return found.withColumn("severity", F.when(incomplete, "alert").otherwise(severity)).withColumn("category", F.coalesce(category, F.when(incomplete, "alert").otherwise("error")))


def gate(keys: DataFrame, issues: DataFrame, removed: DataFrame, stripped: DataFrame, key: str) -> DataFrame:
    """Per page: blockers (definite failures, removed meaning, stripped addresses), warnings, items for review, and whether the badge is withheld."""
    rows = (
        issues.select(key, "severity").unionByName(removed.select(key, F.lit("blocker").alias("severity"))).unionByName(stripped.select(key, F.lit("blocker").alias("severity")))
    )
    counted = rows.groupBy(key).agg(
        F.count_if(F.col("severity").isin("blocker", "error")).alias("blockers"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity").isin("alert", "advisory")).alias("needs_review")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("blockers", "warnings", "needs_review")}
    return keys.select(key).join(counted, key, "left").withColumns(zero).withColumn("badge_withheld", F.col("blockers") > 0)


def page_gate(keys: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """gate() over what the tokens alone decide, all counted in one pass over each page."""
    marked = flagged(tokens, key)
    severities = F.transform("issues", lambda i: severity_of(i["impact"]))
    many = lambda *names: F.coalesce(F.sum(F.size(F.filter(severities, lambda x: x.isin(*names)))), F.lit(0))
    removed = F.when((F.col("kind") == "open") & T.one_of("shifted", [t for t in rules.SEMANTIC_TAGS if t not in rules.ALLOWED_TAGS]), F.col("shifted"))
    stripped = F.transform(F.filter("attrs", lambda a: url_verdict("shifted", a["name"], a["value"]) == "stripped"), lambda a: F.concat("shifted", F.lit("."), a["name"]))
    counted = marked.groupBy(key).agg(
        (many("blocker", "error") + F.size(F.collect_set(removed)) + F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.size(stripped) > 0, stripped)))))).alias("blockers"),
        many("warning").alias("warnings"), many("alert", "advisory").alias("needs_review"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("blockers", "warnings", "needs_review")}
    return keys.select(key).join(counted, key, "left").withColumns(zero).withColumn("badge_withheld", F.col("blockers") > 0)


def sanitize(tokens: DataFrame, key: str) -> DataFrame:
    """The page policy end to end: heading shift, tag filter, attribute, style and address filter, and pages put together again in one shuffle."""
    kept = with_kept_attributes(filter_tags(shift_headings(tokens, key)))
    written = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), T.escape_attribute(a["value"]), F.lit('"'))), "")
    raw = F.when(F.col("kind") == "open", F.concat(F.lit("<"), F.col("tag"), F.coalesce(written, F.lit("")), F.lit(">"))).when(F.col("kind") == "close", F.concat(F.lit("</"), F.col("tag"), F.lit(">"))).otherwise(F.col("raw"))
    return serialize(kept.select(key, "pos", raw.alias("raw")), key)


def assign_block_ids(blocks: DataFrame, key: str, order: str, own: str | None = None, prefix: str = "blk-") -> DataFrame:
    """blocks with stable ids: `prefix`, a hash of the section's id in base 36 and the block's ordinal, where they have none of their own."""
    return blocks.withColumn("block_id", _block_id(key, F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1, own, prefix))


def _block_id(key: str, ordinal: Column, own: str | None = None, prefix: str = "blk-") -> Column:
    made = F.concat(F.lit(prefix), F.lower(F.conv(T.fnv1a(F.col(key).cast("string")).cast("string"), 10, 36)), F.lit("-"), ordinal.cast("string"))
    return F.coalesce(F.nullif(F.col(own), F.lit("")), made) if own else made


def preceding_reference(tokens: DataFrame, key: str, tags: tuple[str, ...]) -> DataFrame:
    """(key, el, reference): for the elements with these tags the text of the paragraph or heading that ended last beside them, else beside what holds them."""
    marked = enclosing(tokens.select(key, "pos", "kind", "tag", "text", "raw"), key, reference=REFERENCES)
    targets = marked.filter((F.col("kind") == "open") & F.col("tag").isin(*tags) & F.col("before").isNotNull()).select(key, "el", "before")
    texts = joined_text(marked.filter("kind = 'text' AND reference IS NOT NULL"), key, F.col("reference.el").alias("before"))
    return targets.join(texts, [key, "before"]).select(key, "el", F.col("text").alias("reference"))


def element_ids(tokens: DataFrame, key: str, tags: tuple[str, ...], kind: str) -> DataFrame:
    """(key, pos, element_id): the id of every element with these tags: its own where it is the first with that, else `kind` and its ordinal."""
    own = F.nullif(F.trim(F.get(F.filter("attrs", lambda a: a["name"] == "id"), 0)["value"]), F.lit(""))
    found = tokens.filter((F.col("kind") == "open") & F.col("tag").isin(*tags)).select(key, "pos", own.alias("own"))
    found = found.withColumns({"n": F.row_number().over(Window.partitionBy(key).orderBy("pos")), "k": F.row_number().over(Window.partitionBy(key, "own").orderBy("pos"))})
    return found.select(key, "pos", F.when(F.col("own").isNotNull() & (F.col("k") == 1), F.col("own")).otherwise(F.concat(F.lit(f"{kind}-"), F.col("n").cast("string"))).alias("element_id"))


def extract_tex(tokens: DataFrame, key: str, without: tuple[str, ...] = ("pre", "code", "math")) -> DataFrame:
    """(key, pos, tex, display): delimited TeX in texts, those of pages outside code and what is mathematics already."""
    outside = enclosing(tokens, key, [key, "pos", "kind", "text", "raw"], _left_out=without).filter("_left_out IS NULL") if without and "raw" in tokens.columns else tokens
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)\\\(.*?\\\)|\\\[.*?\\\]|\$\$.*?\$\$"), F.lit(0))).alias("m")
    rows = outside.filter("kind = 'text'").select(key, "pos", found)
    return rows.select(key, "pos", F.trim(F.regexp_replace("m", r"(?s)^(?:\\\(|\\\[|\$\$)|(?:\\\)|\\\]|\$\$)$", "")).alias("tex"), ~F.col("m").startswith("\\(")).toDF(key, "pos", "tex", "display")


def equation_images(tokens: DataFrame, key: str) -> DataFrame:
    """(key, pos, tex, display): pictures that stand for an equation (by class or address) and carry its TeX as alternative text."""
    raw, classes = F.trim(attribute("alt")), F.split(F.coalesce(attribute("class"), F.lit("")), r"\s+")
    made = F.exists(classes, lambda c: c.startswith("ql-img-")) | F.coalesce(attribute("src").contains("quicklatex.com"), F.lit(False))
    told = tokens.filter((F.col("kind") == "open") & (F.col("tag") == "img")).filter(made & (F.coalesce(raw, F.lit("")) != "") & (F.lower(raw) != "rendered by quicklatex.com"))
    tex = F.trim(F.regexp_replace(raw, r"(?s)^(?:\\\[|\\\(|\$\$|\$)\s*|\s*(?:\\\]|\\\)|\$\$|\$)$", ""))
    display = raw.startswith("\\[") | raw.startswith("$$") | F.exists(classes, lambda c: c.contains("displayed"))
    return told.select(key, "pos", tex.alias("tex"), display.alias("display")).filter("tex <> ''")


def anchor_ids(titles: DataFrame, group: str, title: str, order: list[str]) -> DataFrame:
    """titles with anchors of letters, digits and _.:-, unique in their group."""
    from foliolens.operators.publishing import unique_names

    return unique_names(titles.withColumn("_anchor", T.anchor(title)), group, "_anchor", order, "anchor").drop("_anchor")
