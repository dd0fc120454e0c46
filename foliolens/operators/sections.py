"""What pages are made of, for review and publishing: text runs with their colours, plan blocks, inventories, assembled pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import color as C
from foliolens.functions import text as T
from foliolens.operators import audits as A
from foliolens.operators import pages as P

#: What a browser gives elements before any style: pixels, and whether bold.
SIZES = {"h1": 32.0, "h2": 24.0, "h3": 18.72, "h5": 13.28, "h6": 10.72}
_FRAME = ("html", "body")
_HEAD = ("head", "title", "meta", "link", "script", "style", "base")
BOLD = ("h1", "h2", "h3", "h4", "h5", "h6", "b", "strong", "th")


def _style() -> Column:
    return F.get(F.filter("attrs", lambda a: a["name"] == "style"), 0)["value"]


def _declared(style: Column, names: str) -> Column:
    """The last declaration of a property in a style."""
    return F.trim(F.try_element_at(F.regexp_extract_all(style, F.lit(rf"(?i)(?:^|;)\s*(?:{names})\s*:\s*((?:[^;(]|\([^)]*\))+)"), F.lit(1)), F.lit(-1)))


def text_runs(tokens: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """(key, el, fg, bg_kind, layers, gradient_css, reason, size): one row per visible element with own text.

    Colours, sizes and visibility are those declared inline, inherited from the nearest element that declares them. A background is
    the colour layers down to an opaque one or white, or the nearest gradient, image or filter above that stops them.
    """
    opened = F.col("kind") == "open"

    def told(style: Column) -> Column:
        """What a style declares; each part is found once."""
        named = {"back": "background|background-color", "image": "background-image|background", "px": "font-size", "fg": "color", "filter": "filter", "weight": "font-weight"}
        hidden = style.rlike(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)") | F.exists("attrs", lambda a: a["name"] == "hidden")
        return C.let(F.struct(*[_declared(style, names).alias(n) for n, names in named.items()], F.coalesce(hidden, F.lit(False)).alias("hidden")), coloured)

    def coloured(d: Column) -> Column:
        return C.let(F.regexp_extract(d["back"], r"(#[0-9a-f]{3,8}|rgba?\([^)]*\)|^[a-z]+$)", 1), lambda color: C.let(C.parse_color(color)["a"], lambda a: made_of(d, color, a)))

    def made_of(d: Column, color: Column, a: Column) -> Column:
        image = F.regexp_extract(F.coalesce(d["image"], F.lit("")), r"((?:repeating-)?(?:linear|radial|conic)-gradient\(.*\)|url\(.*\))", 1)
        return F.struct(
            d["fg"].alias("fg"), F.when(a > 0, color).alias("bg"), F.coalesce(a >= 1, F.lit(False)).alias("opaque"), F.nullif(image, F.lit("")).alias("image"), F.coalesce(F.nullif(d["filter"], F.lit("none")), F.lit("")).alias("filter"),
            F.regexp_extract(d["px"], r"^([0-9.]+)(?:px|pt|em|rem|%)$", 1).try_cast("double").alias("n"), F.regexp_extract(d["px"], "(px|pt|em|rem|%)$", 1).alias("unit"),
            F.when(d["weight"].isin("bold", "bolder"), 700).otherwise(d["weight"].try_cast("int")).alias("weight"), d["hidden"].alias("hidden"),
        )

    own = F.when(opened & (F.size("attrs") > 0), C.let(F.lower(_style()), told))
    rows = P.by_page(tokens.select(key, "pos", "kind", "tag", F.col("raw").endswith("/>").alias("closed"), own.alias("own"), (F.trim(F.coalesce("text", F.lit(""))) != "").alias("said")), key, whole)
    fields = ["el", "fg", "bg_kind", "layers", "gradient_css", "reason", "px", "weight"]
    types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.float64(), pa.int32()]
    scale = {"px": lambda n, above: n, "pt": lambda n, above: n * 4 / 3, "em": lambda n, above: n * above, "rem": lambda n, above: n * 16, "%": lambda n, above: n * above / 100}

    def inherited(above: tuple, tag: str, own: dict | None) -> tuple:
        fg, kind, layers, css, reason, px, weight, hidden = above
        px, weight, hidden = SIZES.get(tag, px), 700 if tag in BOLD else weight, hidden or tag in _HEAD
        if own:
            fg, weight, hidden = own["fg"] or fg, own["weight"] or weight, hidden or own["hidden"]
            if own["n"] is not None:
                px = scale[own["unit"]](own["n"], above[5])
            if own["image"]:
                conic = own["image"].startswith(("conic", "repeating-conic"))
                kind, layers, css, reason = ("unresolvable", [], None, "conic-gradient") if conic else ("gradient", [], own["image"], None) if "gradient" in own["image"] else ("image", [], None, None)
            elif own["filter"]:
                kind, layers, css, reason = "unresolvable", [], None, "css-filter"
            elif own["bg"] and own["opaque"]:
                kind, layers, css, reason = "layers", [own["bg"]], None, None
            elif own["bg"] and kind == "layers":
                layers = [own["bg"], *layers]
        return fg, kind, layers, css, reason, px, weight, hidden

    def run(batches):
        floor = ("#000000", "layers", ["#ffffff"], None, None, 16.0, 400, False)
        page, stack, held, seen = None, P.Stack(), [floor], set()
        for batch in batches:
            at, found = [], []
            for i, (value, what, tag, closed, own, said) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6)), strict=True)):
                if page is None or page[0] != value:
                    page, stack, held, seen = (value,), P.Stack(), [floor], set()
                size = len(stack.open)
                el, ended = stack.step(what, tag, closed)
                if len(stack.open) > size:
                    held.append(inherited(held[-1], tag, own))
                elif what == "close" and ended:
                    del held[-len(ended) :]
                elif what == "text" and said and el is not None and el not in seen and not held[-1][7]:
                    seen.add(el)
                    at.append(i)
                    found.append((el, *held[-1][:7]))
            columns = [list(c) for c in zip(*found, strict=True)] if found else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [key, *fields])

    made = rows.mapInArrow(run, f"`{key}` {dict(tokens.dtypes)[key]}, el int, fg string, bg_kind string, layers array<string>, gradient_css string, reason string, px double, weight int")
    return made.select(key, "el", "fg", "bg_kind", "layers", "gradient_css", "reason", C.size_class("px", "weight").alias("size"))


def recolored(tokens: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """tokens whose inline colours, where text fails against its background, give way to the better of two inks."""
    changed = A.normalize_contrast(text_runs(tokens, key, whole)).filter("ink IS NOT NULL").select(key, "el", "ink")
    joined = P.enclosing(tokens, key, whole=whole).join(changed, [key, "el"], "left")
    style = F.concat(F.regexp_replace(F.coalesce(_style(), F.lit("")), r"(?i)(^|;)\s*color\s*:[^;]*;?", "$1"), F.lit("; color: "), F.col("ink"))
    new = F.concat(F.filter("attrs", lambda a: a["name"] != "style"), F.array(F.struct(F.lit("style").alias("name"), F.regexp_replace(style, r"^[;\s]+", "").alias("value"))))
    return joined.withColumn("attrs", F.when((F.col("kind") == "open") & F.col("ink").isNotNull(), new).otherwise(F.col("attrs"))).select(*tokens.columns)


# What plan blocks are called.
KINDS = {"p": "Paragraph", "ul": "List", "ol": "List", "table": "Table", "pre": "Code", "blockquote": "Quotation", "hr": "Rule", "dl": "Definition list", "section": "Section", "div": "Block"}


def _excerpt(c: Column) -> Column:
    return F.when(F.length(c) > 60, F.concat(F.rtrim(F.substring(c, 1, 59)), F.lit("…"))).otherwise(c)


def plan_blocks(tokens: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """(key, block_idx, tag, level, text, summary, html): the blocks at a page's top level in order; loose texts are blocks (tag null), and a declared label overrides the summary."""
    label = F.trim(F.get(F.filter("attrs", lambda a: a["name"] == "data-plan-label"), 0)["value"])
    loose = (F.col("kind") == "text") & (T.collapse("text") != "")
    rows = P.joined_blocks(
        tokens.withColumn("label", label), key, ~F.col("tag").isin(*_FRAME), ("raw", "text"), ("raw", "label", "kind"), but=_HEAD, take=F.coalesce(~F.col("tag").isin(*_FRAME), F.lit(True)), loose=loose, whole=whole
    )
    # The declaration itself goes from the tag that opens the block.
    bare = F.regexp_replace("first_raw", r"""(?i)\s+data-plan-label\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", "")
    html = F.when((F.col("first_kind") == "open") , F.concat(bare, F.substring("raw", F.length("first_raw") + 1, F.length("raw")))).otherwise(F.col("raw"))
    made = rows.select(key, F.col("n").alias("block_idx"), "tag", "text", F.col("first_label").alias("label"), html.alias("html"))
    text, level = T.collapse(T.decode_entities("text")), F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    named = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    made = made.withColumns({"text": text, "level": level})
    kind = F.when(F.col("tag").isNull(), "Text").when(F.col("level").isNotNull(), "Heading").otherwise(F.coalesce(named[F.col("tag")], F.concat(F.lit("<"), "tag", F.lit(">"))))
    told = F.when((F.col("text") != "") | F.col("level").isNotNull(), F.concat(kind, F.lit(": "), _excerpt(F.col("text")))).otherwise(kind)
    summary = F.when(F.coalesce("label", F.lit("")) != "", _excerpt(F.col("label"))).otherwise(told)
    return made.select(key, "block_idx", "tag", "level", "text", summary.alias("summary"), "html")


# Classes and data types of blocks that tell what matters.
KEY_CLASSES = (
    "os-key-takeaways key-takeaways os-summary summary os-learning-objectives learning-objectives chapter-summary key-concepts os-glossary-container glossary"
).split()
KEY_TYPES = ("key-takeaways", "summary", "learning-objectives")


def metadata_inventory(tokens: DataFrame, key: str) -> DataFrame:
    """(key, el, kind, text, detail): headings of levels 2 to 4, glossary terms with the definition right after them, bold terms of at most 60
    characters that open a paragraph or item, and paragraphs and items in key blocks."""
    value = lambda name: F.get(F.filter("attrs", lambda a: a["name"] == name), 0)["value"]
    is_key = F.arrays_overlap(F.split(F.coalesce(value("class"), F.lit("")), r"\s+"), F.lit(list(KEY_CLASSES))) | F.coalesce(value("data-type"), F.lit("")).isin(*KEY_TYPES)
    order = Window.partitionBy(key).orderBy("pos")
    opens = (F.col("kind") == "open") & F.col("tag").isin("p", "li")
    lead = (F.col("kind") == "open") & F.col("tag").isin("b", "strong") & F.lag(opens).over(order)
    marked = P.enclosing(
        tokens.withColumn("_lead", lead), key, head=("h2", "h3", "h4"), term=("dt",), definition=("dd",), item=("p", "li"), lead=F.col("_lead"), block=is_key & (F.col("kind") == "open")
    )
    # One pass: a text goes once to each of its kinds.
    kinds = {m: F.when(F.col(m).isNotNull(), F.struct(F.lit(m).alias("mark"), F.col(f"{m}.el").alias("el"))) for m in ("head", "term", "definition", "lead")}
    keyed = F.when(F.col("item").isNotNull() & F.col("block").isNotNull(), F.struct(F.lit("key").alias("mark"), F.col("item.el").alias("el")))
    texts = marked.filter("kind = 'text'").select(key, "pos", "text", F.explode(F.array_compact(F.array(*kinds.values(), keyed))).alias("_m"))
    joined = P.joined_text(texts, key, F.col("_m.mark").alias("mark"), F.col("_m.el").alias("el"))
    after = Window.partitionBy(key, F.when(F.col("mark").isin("term", "definition"), "term").otherwise(F.col("mark"))).orderBy("el")
    detail = F.when((F.col("mark") == "term") & (F.lead("mark").over(after) == "definition"), F.nullif(F.lead("text").over(after), F.lit("")))
    named = F.expr(T.literal({"head": "heading", "term": "glossary", "lead": "defined-term", "key": "key-block"}))[F.col("mark")]
    told = joined.withColumn("detail", detail).filter("mark <> 'definition' AND (mark <> 'lead' OR text <> '' AND length(text) <= 60)")
    return told.select(key, "el", named.alias("kind"), "text", "detail")


def table_facts(tokens: DataFrame, key: str) -> DataFrame:
    """(key, el, role, nested, has_th, rows) of a page's outermost tables: their role, whether they hold another table, header cells, and their rows, those of inner tables among them."""
    marked = P.enclosing(tokens, key, table=("table",)).filter("kind = 'open' AND table IS NOT NULL")
    own = F.col("el") == F.col("table.el")
    role = F.get(F.filter("attrs", lambda a: a["name"] == "role"), 0)["value"]
    return marked.groupBy(key, F.col("table.el").alias("el")).agg(
        F.max(F.when(own, role)).alias("role"), F.bool_or(~own & (F.col("tag") == "table")).alias("nested"), F.bool_or(F.col("tag") == "th").alias("has_th"), F.count_if(F.col("tag") == "tr").alias("rows")
    )


def assemble_page(html, title, footer: str = "Continue to the next page.") -> Column:
    """A page as published: its first second-level heading, or the section's title, as banner, the body in a frame, and a footer. An assembled page stays as it is."""
    h, t = T._col(html), F.coalesce(F.trim(T._col(title)), F.lit(""))
    own = F.regexp_extract(h, r"(?is)<h2\b[^>]*>.*?</h2>", 0)
    banner = F.when(own != "", F.regexp_replace(own, r"(?is)^<h2\b[^>]*>(.*)</h2>$", '<h2 class="page-title"><strong>$1</strong></h2>')).when(t != "", F.concat(F.lit('<h2 class="page-title"><strong>'), T.escape_text(t), F.lit("</strong></h2>"))).otherwise("")
    at = F.when(own != "", F.instr(h, own)).otherwise(F.lit(1))
    body = F.when(own != "", F.concat(F.substring(h, F.lit(1), at - 1), F.substring(h, at + F.length(own), F.length(h)))).otherwise(h)
    made = F.concat(F.lit('<div class="page-frame">'), banner, F.lit('<div class="page-body">'), body, F.lit(f'</div><div class="page-footer"><p>{footer}</p></div></div>'))
    return F.when(h.contains('class="page-frame"'), h).otherwise(made)


def page_captions(markdown, page, references) -> Column:
    """Markdown with the pictures of a page, in order, captioned by the page and pointing at their packaged references where there are any."""
    m, refs = T._col(markdown), T._col(references)
    parts = F.split(m, r"!\[Image: [^\]]*\]\(image\)")
    picture = lambda i: F.concat(F.lit("![Figure on page "), T._col(page).cast("string"), F.lit("]("), F.coalesce(F.get(refs, i), F.lit("image")), F.lit(")"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(picture(i - 1), p))), "")
