"""Page plans, page identity, matching against an existing site, and export tables."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import text as T

MOST_PAGES = 100


def unique_names(df: DataFrame, group: str, base: str, order: list[str], into: str, suffix: str = "-{}", fold: bool = False) -> DataFrame:
    """df with `base` made unique within `group` in reading order: later ones get a number from 2 on. With `fold`, case doesn't tell names apart; they carry no blanks at their ends.

    Counting repeats is exact unless a natural name equals a generated one. Names that differ without the numbers at their ends never
    meet; those of one stem among which that happens, found by an anti-check, are renamed one by one in a grouped job, the others never leave Spark SQL.
    """
    norm = (lambda c: F.lower(F.trim(c))) if fold else (lambda c: c)
    before, after = suffix.split("{}")
    n = F.row_number().over(Window.partitionBy(group, norm(F.col(base))).orderBy(*order))
    named = df.withColumn("_n", n).withColumn(into, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit(before), F.col("_n").cast("string"), F.lit(after))))
    named = named.withColumn("_stem", F.trim(F.regexp_replace(norm(F.col(base)), rf"(?:\s*\Q{before}\E[0-9]+\Q{after}\E)+\s*$", "")))
    twice = named.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(group, norm(F.col(into))))).filter("_t > 1").select(group, "_stem").distinct()
    clean = named.join(twice, [group, "_stem"], "left_anti").drop("_n", "_stem").select(*df.columns, into)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([(c, "ascending") for c in order]).to_pylist()
        taken: set[str] = set()
        key = (lambda s: s.strip().lower()) if fold else (lambda s: s)
        for r in rows:
            name, k = r[base], 2
            while key(name) in taken:
                name, k = f"{r[base]}{before}{k}{after}", k + 1
            taken.add(key(name))
            r[into] = name
        return pa.Table.from_pylist(rows, table.schema)

    mended = named.drop("_n").join(twice, [group, "_stem"], "left_semi").select(*df.columns, into, "_stem")
    return clean.unionByName(mended.groupBy(group, "_stem").applyInArrow(run, mended.schema).drop("_stem"))


def split_level(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, split): the smallest heading level that occurs at least twice."""
    return blocks.filter("level IS NOT NULL").groupBy(doc, "level").count().filter("count >= 2").groupBy(doc).agg(F.min("level").alias("split"))


def propose_pages(blocks: DataFrame, doc: str, most: int = MOST_PAGES) -> DataFrame:
    """blocks (doc, block_idx, level) with their page number. A heading of the split level opens a page; what stands before the first is
    a page of its own if it holds more than headings; too many pages become one."""
    order = Window.partitionBy(doc).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.join(split_level(blocks, doc), doc, "left").withColumn("_opens", F.coalesce((F.col("level") == F.col("split")).cast("int"), F.lit(0)))
    marked = marked.withColumn("_page", F.sum("_opens").over(order))
    whole = Window.partitionBy(doc)
    preamble = F.coalesce(F.bool_or((F.col("_page") == 0) & F.col("level").isNull()).over(whole), F.lit(False))
    page = F.when(F.col("split").isNull(), 0).when(preamble, F.col("_page")).otherwise(F.greatest(F.lit(0), F.col("_page") - 1))
    numbered = marked.withColumn("page", page)
    over = F.max("page").over(whole) + 1 > most
    return numbered.withColumn("over_budget", over).withColumn("page", F.when(F.col("over_budget"), 0).otherwise(F.col("page")).cast("int")).drop("_opens", "_page")


def page_rows(blocks: DataFrame, doc: str, title: str, html: str) -> DataFrame:
    """(doc, page, page_id, title, html, blocks) of proposed pages, with unique titles."""
    opens = F.min_by(F.when((F.col("level") == F.col("split")) & ~F.col("over_budget"), F.col(title)), F.when((F.col("level") == F.col("split")) & ~F.col("over_budget"), F.col("block_idx")))
    parts = F.array_sort(F.collect_list(F.struct("block_idx", F.col(html).alias("h"))))
    pages = blocks.groupBy(doc, "page").agg(F.min("block_idx").alias("first"), opens.alias("_own"), parts.alias("_parts"))
    base = F.coalesce(F.nullif(F.trim("_own"), F.lit("")), F.concat(F.lit("Document "), F.col(doc).cast("string")))
    pages = pages.select(
        doc, "page", F.concat(F.col(doc).cast("string"), F.lit("-page-"), (F.col("first") + 1).cast("string")).alias("page_id"), base.alias("base"),
        F.array_join(F.transform("_parts", lambda p: p.h), "").alias("html"), F.size("_parts").alias("blocks"),
    )
    return unique_names(pages, doc, "base", ["page"], "title", " ({})", fold=True).drop("base")


def validate_plan(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, problem, title): no page included, blank titles, titles that repeat (once each)."""
    used = pages.filter("included")
    none = pages.groupBy(doc).agg(F.count_if("included").alias("n")).filter("n = 0").select(doc, F.lit("none-included").alias("problem"), F.lit(None).cast("string").alias("title"))
    blank = used.filter(F.trim("title") == "").select(doc, F.lit("blank-title").alias("problem"), "title")
    twice = used.filter(F.trim("title") != "").groupBy(doc, F.lower(F.trim("title")).alias("k")).agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return none.unionByName(blank).unionByName(twice.select(doc, F.lit("duplicate-title").alias("problem"), "title"))


def replay_plan_edits(pages: DataFrame, log: DataFrame, doc: str) -> DataFrame:
    """Applies each document's edits (seq, op, page_id, value) in order: rename, include, merge-next, move, split. Impossible ones are rejected with a reason.

    The order matters, so a document is one group: at most MOST_PAGES pages.
    """
    kind = dict(pages.dtypes)[doc]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        plan = [{"page_id": r["page_id"], "title": r["title"], "included": r["included"], "blocks": list(r["blocks"])} for r in left.sort_by("page").to_pylist()]
        key = left.column(doc)[0].as_py() if left.num_rows else None
        rejected = []
        for e in right.sort_by("seq").to_pylist() if left.num_rows else []:
            at = next((i for i, p in enumerate(plan) if p["page_id"] == e["page_id"]), None)
            value, problem = e["value"], None
            if at is None:
                problem = "no-such-page"
            elif e["op"] == "rename":
                plan[at]["title"] = value
            elif e["op"] == "include":
                plan[at]["included"] = value == "true"
            elif e["op"] == "merge-next" and at + 1 < len(plan):
                plan[at]["blocks"] += plan.pop(at + 1)["blocks"]
            elif e["op"] == "move" and 0 <= at + int(value) < len(plan):
                plan.insert(at + int(value), plan.pop(at))
            elif e["op"] == "split" and int(value) in plan[at]["blocks"][1:]:
                cut = plan[at]["blocks"].index(int(value))
                plan.insert(at + 1, {"page_id": f"{key}-page-{int(value) + 1}", "title": f"{plan[at]['title']} (continued)", "included": plan[at]["included"], "blocks": plan[at]["blocks"][cut:]})
                plan[at]["blocks"] = plan[at]["blocks"][:cut]
            else:
                problem = f"impossible-{e['op']}"
            if problem:
                rejected.append({"page_id": e["page_id"], "title": problem, "included": False, "blocks": [], "page": None})
        rows = [{**p, "page": i} for i, p in enumerate(plan)] + rejected
        schema = pa.schema([(doc, left.schema.field(doc).type), ("page", pa.int32()), ("page_id", pa.string()), ("title", pa.string()), ("included", pa.bool_()), ("blocks", pa.list_(pa.int32()))])
        return pa.Table.from_pylist([{doc: key, **r} for r in rows], schema)

    return pages.groupBy(doc).cogroup(log.groupBy(doc)).applyInArrow(run, f"`{doc}` {kind}, page int, page_id string, title string, included boolean, blocks array<int>")


def qualified_title(chapter, section) -> Column:
    """The section's title after its chapter's label, unless it already begins with the chapter's number."""
    number = F.regexp_extract(T._col(chapter), r"(?i)^\s*(?:ch(?:apter)?\.?\s+)?(\d+)\b", 1)
    label = F.when(number != "", F.concat(F.lit("Chapter "), number)).otherwise(F.trim(T._col(chapter)))
    own = F.regexp_extract(T._col(section), r"^\s*(\d+)", 1)
    return F.when((number != "") & (own == number), T._col(section)).otherwise(F.trim(F.concat_ws(" ", label, T._col(section))))


def page_targets(sections: DataFrame, export: str, order: list[str]) -> DataFrame:
    """Sections that compiled, with a slug unique in the export and a qualified title."""
    good = sections.filter(F.col("error").isNull() & (F.length("html") > 0)).withColumn("_base", F.concat_ws("-", T.slug("chapter_title"), T.slug("section_title")))
    named = unique_names(good, export, "_base", order, "slug")
    return named.withColumn("title", qualified_title("chapter_title", "section_title")).drop("_base")


def resolve_targets(targets: DataFrame, existing: DataFrame, export: str) -> DataFrame:
    """targets with the page of the site they overwrite: that of the same address, else that of the same title if it is the only one free and only one target wants it."""
    urls = existing.select(export, F.col("url").alias("slug"), F.col("url").alias("_same"))
    first = targets.join(urls, [export, "slug"], "left")
    claimed = first.filter("_same IS NOT NULL").select(export, F.col("_same").alias("url"))
    free = existing.join(claimed, [export, "url"], "left_anti").groupBy(export, "title").agg(F.count(F.lit(1)).alias("_free"), F.min("url").alias("_url"))
    wanting = F.sum(F.when(F.col("_same").isNull(), 1).otherwise(0)).over(Window.partitionBy(export, "title"))
    joined = first.withColumn("_wanting", wanting).join(free, [export, "title"], "left")
    open_ = F.col("_same").isNull() & F.col("_free").isNotNull()
    alone = (F.col("_wanting") == 1) & (F.col("_free") == 1)
    return joined.withColumn("existing_url", F.coalesce("_same", F.when(open_ & alone, F.col("_url")))).withColumn("ambiguous", open_ & ~alone).drop("_same", "_free", "_url", "_wanting")


def publish_status(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn("status", F.when(F.col("existing_url").isNotNull(), "overwrite").when(F.col("ambiguous"), "unknown").otherwise("new"))


def remaining(targets: DataFrame, landed: DataFrame, key: list[str], order: list[str], group: str) -> DataFrame:
    """Targets that have not landed, numbered in sending order."""
    return targets.join(landed, key, "left_anti").withColumn("send", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def stopped_by(log: DataFrame, group: str, order: str) -> DataFrame:
    """Per batch of a sending log (slug, outcome): pages that landed, and what stopped it: the first outcome that is none of landing, with its page."""
    bad = F.col("outcome") != "landed"
    first = F.min_by(F.when(bad, F.struct("slug", "outcome")), F.when(bad, F.col(order)))
    return log.groupBy(group).agg(F.count_if(~bad).alias("landed"), first.alias("_s")).select(group, "landed", F.col("_s.slug").alias("slug"), F.col("_s.outcome").alias("stopped_by"))


def manifest_items(targets: DataFrame, export: str, chapter_order: str, order: str) -> DataFrame:
    """Positions of modules and items in an export, with resource ids of safe characters."""
    module = F.dense_rank().over(Window.partitionBy(export).orderBy(chapter_order))
    item = F.row_number().over(Window.partitionBy(export, chapter_order).orderBy(order))
    return targets.withColumn("module", module).withColumn("item", item).withColumn("resource", F.concat(F.lit("res-"), F.regexp_replace("slug", "[^A-Za-z0-9._-]", "_")))


def asset_budget(assets: DataFrame, doc: str, order: str, size: str, most: int = 64, each: int = 4 << 20, total: int = 8 << 20) -> DataFrame:
    """assets with the first reason to refuse each: too many, empty, too large, or beyond the document's total. Bytes that break the total count on."""
    window = Window.partitionBy(doc).orderBy(order)
    numbered = assets.withColumn("_n", F.row_number().over(window))
    eligible = (F.col("_n") <= most) & (F.col(size) > 0) & (F.col(size) <= each)
    running = F.sum(F.when(eligible, F.col(size)).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0))
    reason = F.when(F.col("_n") > most, "too-many").when(F.col(size) <= 0, "empty").when(F.col(size) > each, "too-large").when(F.col("_total") > total, "over-total")
    return numbered.withColumn("_total", running).withColumn("refused", reason).drop("_n", "_total")


def dedupe_assets(assets: DataFrame, doc: str, digest: str, order: str, origin: str) -> DataFrame:
    """assets with the origin that names equal bytes: the first seen in the document."""
    return assets.withColumn("named_by", F.first_value(origin).over(Window.partitionBy(doc, digest).orderBy(order)))


# Letters that don't decompose into a plain one and marks.
WHOLE_LETTERS = {"ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "ß": "ss"}


def plain_letters(c) -> Column:
    """Latin letters without their marks; the table follows from the letters' own decompositions."""
    pairs = {chr(i): unicodedata.normalize("NFKD", chr(i)) for i in range(0xC0, 0x250)}
    marked = {x: d[0] for x, d in pairs.items() if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(m) for m in d[1:])}
    out = T._col(c)
    for letter, plain in WHOLE_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.translate(F.regexp_replace(out, r"[\u0300-\u036f]", ""), "".join(marked), "".join(marked.values()))


def asset_name(origin, digest, extension) -> Column:
    """A safe name: the base name in plain letters as a slug, eight digits of the digest, the extension."""
    base = F.regexp_replace(F.regexp_extract(T._col(origin), r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(plain_letters(base)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(slug, F.lit("")), F.lit("image")), F.lit("-"), F.substring(T._col(digest), 1, 8), F.lit("."), T._col(extension))


def asset_integrity(references: DataFrame, assets: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """(assets to ship, references without an asset)."""
    wanted = references.select(key).distinct()
    return assets.join(wanted, key, "left_semi").dropDuplicates([key]), wanted.join(assets.select(key), key, "left_anti")


def sniff_raster(content) -> Column:
    """(media type, width, height) of PNG, GIF and WebP headers, the latter of lossy, lossless and extended files; null for others, and where a size is 0."""
    head = F.hex(F.substring(T._col(content), 1, 30))
    number = lambda at, n: F.conv(F.substring(head, 2 * at + 1, 2 * n), 16, 10).cast("long")
    little = lambda at: number(at, 1) + 256 * number(at + 1, 1)
    made = lambda kind, w, h: F.when((w > 0) & (h > 0), F.struct(F.lit(kind).alias("media_type"), w.alias("width"), h.alias("height")))
    webp = lambda chunk: (F.length(head) == 60) & head.rlike("^52494646.{8}57454250" + "".join(f"{ord(c):02X}" for c in chunk))
    bits = little(21) + 65536 * little(23)  # lossless files keep two sizes of 14 bits, less 1, one after the other
    low = lambda n, shift=0: F.shiftright(n, shift).bitwiseAND(0x3FFF)
    return (
        F.when(head.startswith("89504E470D0A1A0A"), made("image/png", number(16, 4), number(20, 4))).when(head.rlike("^47494638(37|39)61"), made("image/gif", little(6), little(8)))
        .when(webp("VP8X"), made("image/webp", 1 + little(24) + 65536 * number(26, 1), 1 + little(27) + 65536 * number(29, 1)))
        .when(webp("VP8L"), made("image/webp", 1 + low(bits), 1 + low(bits, 14))).when(webp("VP8 "), made("image/webp", low(little(26)), low(little(28))))
    )


def jpeg_sizes(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, media_type, width, height) of rasters. JPEG keeps its size in a segment found by walking, so this is an Arrow job over the bytes; other headers are read by sniff_raster."""
    kind = dict(files.dtypes)[key]

    def size(data: bytes) -> tuple[int, int] | None:
        at = 2
        while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + length if length >= 2 else len(data)
        return None

    def run(batches):
        for batch in batches:
            found = [size(c or b"") for c in batch.column(1).to_pylist()]
            columns = [pa.array(["image/jpeg" if f else None for f in found], pa.string()), *[pa.array([f[i] if f else None for f in found], pa.int64()) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "media_type", "width", "height"])

    walked = files.filter(F.hex(F.substring(content, 1, 2)) == "FFD8").select(key, content).mapInArrow(run, f"`{key}` {kind}, media_type string, width long, height long")
    sniffed = files.filter(F.coalesce(F.hex(F.substring(content, 1, 2)), F.lit("")) != "FFD8").withColumn("_r", sniff_raster(content)).select(key, "_r.media_type", "_r.width", "_r.height")
    return walked.unionByName(sniffed)


def asset_refusals(assets: DataFrame, doc: str) -> DataFrame:
    """(doc, refused, n): refused assets by cause."""
    return assets.filter("refused IS NOT NULL").groupBy(doc, "refused").agg(F.count(F.lit(1)).alias("n"))


def insert_images(blocks: DataFrame, edits: DataFrame, doc: str) -> DataFrame:
    """blocks (doc, block_idx, html) with images (doc, target, src, html, mode) put after or in place of their target block, unless the document has them; lost targets add nothing."""
    shown = blocks.select(F.col(doc).alias("_d"), F.col("html").alias("_h"))
    new = edits.join(shown, (F.col("_d") == F.col(doc)) & F.col("_h").contains(F.concat(F.lit('src="'), F.col("src"), F.lit('"'))), "left_anti")
    targets = blocks.select(doc, F.col("block_idx").alias("target"))
    placed = new.join(targets, [doc, "target"], "left_semi").select(doc, "target", "mode", "html", "src")
    rows = placed.select(doc, (F.col("target") + 0.5).alias("place"), "html", F.col("src").alias("_by"))
    replaced = placed.filter("mode = 'replace'").select(doc, F.col("target").alias("block_idx")).distinct()
    kept = blocks.join(replaced, [doc, "block_idx"], "left_anti").select(doc, F.col("block_idx").cast("double").alias("place"), "html", F.lit("").alias("_by"))
    return kept.unionByName(rows).withColumn("block_idx", F.row_number().over(Window.partitionBy(doc).orderBy("place", "_by")) - 1).drop("place", "_by")


def regroup(queue: DataFrame, sections: DataFrame, order: list[str]) -> DataFrame:
    """A merged queue's items under their chapters, numbered in book order."""
    return queue.join(sections.select("section_id", "chapter_id"), "section_id").withColumn("n", F.row_number().over(Window.partitionBy("chapter_id").orderBy(*order)))
