"""Books and chapters: assembling them, figures, captions, attribution, imports, and what reviews roll up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import audits as A
from foliolens.operators import pages as P

# What marks a text as quoting: a year in brackets, "v.", "et al.", a numbered reference.
CITATION = r"\(\d{4}[a-z]?\)|\bv\.\s|\bet al\.|\[\d+\]"
# Licence codes of a book catalog and their names.
LICENSES = {"ccby": "CC BY", "ccbysa": "CC BY-SA", "ccbync": "CC BY-NC", "ccbyncsa": "CC BY-NC-SA", "ccbynd": "CC BY-ND", "ccbyncnd": "CC BY-NC-ND", "gnu": "GNU FDL", "publicdomain": "Public Domain"}


def catalog_by_network(raw: DataFrame) -> DataFrame:
    """raw (network, link, title, authors) cleaned: tags and references out of titles, rows without link or title dropped, numbered by title in each network."""
    title = T.collapse(T.decode_entities(F.regexp_replace("title", "<[^>]*>", "")))
    good = raw.withColumn("title", title).filter((F.coalesce("link", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    if "authors" in raw.columns:  # names, each of which may be a list of its own
        good = good.withColumn("authors", F.filter(F.transform(F.flatten("authors"), lambda a: T.collapse(a)), lambda a: a != ""))
    return good.withColumn("n", F.row_number().over(Window.partitionBy("network").orderBy(F.lower("title"), "link")))


def network_counts(catalog: DataFrame) -> DataFrame:
    """(network, books) of a catalog."""
    return catalog.groupBy("network").agg(F.count(F.lit(1)).alias("books"))


def commons_catalog(raw: DataFrame, least: int = 500) -> DataFrame:
    """raw (code, authors) with licence names and authors as arrays. Fewer rows than `least` are taken for a broken download: an error."""
    if (n := raw.limit(least).count()) < least:
        raise ValueError(f"{n} rows, at least {least} are wanted")
    return raw.withColumn("license", license_name("code")).withColumn("authors", split_authors("authors"))


def license_name(code) -> Column:
    """A code's name; codes that are not listed stay as they are."""
    named = F.create_map(*[F.lit(x) for p in LICENSES.items() for x in p])
    return F.coalesce(named[T._col(code)], T._col(code))


def split_authors(c) -> Column:
    return F.filter(F.transform(F.split(T._col(c), r";|\band\b"), lambda a: F.trim(a)), lambda a: a != "")


def release_versions(df: DataFrame, json: str) -> DataFrame:
    """(book, version, retired) of manifests {books: {id: {defaultVersion, retired}}}."""
    parsed = F.from_json(json, "books map<string, struct<defaultVersion:string, retired:boolean>>")
    return df.select(F.explode(parsed["books"]).alias("book", "v")).select("book", F.col("v.defaultVersion").alias("version"), F.coalesce("v.retired", F.lit(False)).alias("retired"))


def wanted_versions(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """wanted (book) with their release; a book that the manifest lacks, or has retired, is an error row."""
    joined = wanted.join(versions.groupBy("book").agg(F.min("version").alias("version"), F.max("retired").alias("_retired")), "book", "left")
    return joined.withColumn("error", F.when(F.col("version").isNull(), "unknown-book").when(F.col("_retired"), "retired")).drop("_retired")


def assemble_chapters(outlines: DataFrame, pages: DataFrame, books: DataFrame) -> DataFrame:
    """Outline entries (book, chapter, node, n) with their pages (book, node, html, url) and the book's address and licence; a page without content is an error row."""
    joined = outlines.join(pages, ["book", "node"], "left").join(books.select("book", "book_url", F.col("license").alias("_license")), "book", "left")
    error = F.when(F.col("html").isNull(), "missing").when(F.trim("html") == "", "empty")
    return joined.select("book", "chapter", "node", "n", "html", F.coalesce("url", "book_url").alias("canonical_url"), F.coalesce("license", "_license").alias("license") if "license" in pages.columns else F.col("_license").alias("license"), error.alias("error"))


def three_part_outline(tocs: DataFrame, json: str, key: str) -> DataFrame:
    """(key, n, id, title) of tables of contents with front matter, parts of chapters, and back matter; entries without content or words dropped."""
    entry = "array<struct<id:int, title:string, has_content:boolean, words:int>>"
    parsed = F.from_json(json, f"front {entry}, parts array<struct<chapters:{entry}>>, back {entry}")
    empty = F.array().cast(entry)
    every = F.concat(F.coalesce(parsed["front"], empty), F.coalesce(F.flatten(parsed["parts"]["chapters"]), empty), F.coalesce(parsed["back"], empty))
    good = F.filter(every, lambda e: F.coalesce(e["has_content"], F.lit(False)) & (F.coalesce(e["words"], F.lit(0)) > 0))
    return tocs.select(key, F.posexplode(good).alias("n", "e")).select(key, F.col("n") + 1, F.col("e.id").alias("id"), F.col("e.title").alias("title")).toDF(key, "n", "id", "title")


def xref_map(nodes: DataFrame, base: str) -> DataFrame:
    """(book, node, url) for nodes with a slug."""
    return nodes.filter(F.coalesce("slug", F.lit("")) != "").select("book", "node", F.concat(F.lit(base), "book", F.lit("/pages/"), "slug").alias("url"))


def resolve_xrefs(links: DataFrame, xrefs: DataFrame, fallback: str | None = None) -> DataFrame:
    """links whose address names a node by a 36-digit identifier, resolved with its fragment kept; unresolved ones fall back and are marked. Links that tell their book look only there."""
    node = F.regexp_extract("href", r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)
    on = ["book"] if "book" in links.columns else []
    urls = xrefs.groupBy(*on, F.col("node").alias("_node")).agg(F.min("url").alias("_url"))
    joined = links.withColumn("_node", F.nullif(node, F.lit(""))).join(urls, [*on, "_node"], "left")
    fragment = F.regexp_extract("href", "(#.*)$", 1)
    resolved = F.when(F.col("_node").isNull(), F.col("href")).when(F.col("_url").isNotNull(), F.concat("_url", fragment)).otherwise(F.lit(fallback))
    return joined.withColumn("resolved", resolved).withColumn("unresolved", F.col("_node").isNotNull() & F.col("_url").isNull()).drop("_node", "_url")


# Link texts that say nothing, and bare addresses.
GENERIC_LINK, RAW_LINK = r"(?i)^(?:click here|here|read more|more info(?:rmation)?|learn more|this link|link|more)$", r"(?i)^(?:https?://|www\.)\S+$"


def label_link(href, text, target=None) -> Column:
    """A better text for links that say nothing: the heading or text that a fragment points at, the mail address, the last path part in words, or the host; others keep theirs."""
    h, t = T._col(href), T.collapse(text)
    aim = F.coalesce(T.collapse(target), F.lit("")) if target is not None else F.lit("")
    last = F.regexp_replace(F.regexp_extract(T.normalize_url(h), r"^[a-zA-Z]+://[^/]+/(?:.*/)?([^/]+)$", 1), r"(?i)\.(?:html?|pdf|php)$", "")
    words = F.trim(F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace(F.regexp_replace(last, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "")), "[-_]+", " "), r"\s+", " "))
    subject = F.when((F.coalesce(words, F.lit("")) != "") & (F.lower(words) != "index"), words).otherwise(F.nullif(T.host_of(h), F.lit("")))
    mail = F.nullif(F.regexp_replace(F.substring(h, 8, 400), r"\?.*$", ""), F.lit(""))
    better = F.when(h.startswith("#") & (aim != ""), F.concat(F.lit("Go to "), F.substring(aim, 1, 96))).when(F.lower(h).startswith("mailto:"), F.concat(F.lit("Email "), mail)).otherwise(F.concat(F.lit("Read more about "), subject))
    return F.when(t.rlike(GENERIC_LINK) | t.rlike(RAW_LINK), F.coalesce(better, t)).otherwise(t)


def label_links(links: DataFrame, targets: DataFrame, section: str) -> DataFrame:
    """links (section, href, text) with a `label`; targets (section, id, text) are what fragments may point at."""
    named = targets.groupBy(section, F.concat(F.lit("#"), "id").alias("_href")).agg(F.min("text").alias("_target"))
    joined = links.withColumn("_href", F.when(F.col("href").startswith("#"), F.col("href"))).join(named, [section, "_href"], "left")
    return joined.withColumn("label", label_link("href", "text", "_target")).drop("_href", "_target")


def figure_captions(tokens: DataFrame, key: str) -> DataFrame:
    """(key, el, caption, n): figures with the text of their own caption, numbered; no caption is null. A figure inside another belongs to it."""
    marked = P.enclosing(tokens.select(key, "pos", "kind", "tag", "text", "raw"), key, figure=("figure",), caption=("figcaption",)).filter("figure IS NOT NULL")
    shown = F.when((F.col("kind") == "text") & F.col("caption").isNotNull(), F.struct("pos", "text"))
    caption = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda p: p["text"]), "")
    out = marked.groupBy(key, F.col("figure.el").alias("el")).agg(F.nullif(T.collapse(T.decode_entities(caption)), F.lit("")).alias("caption"))
    return out.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("el")))


def caption_parts(c) -> Column:
    """(text, label_only): a caption without its trailing credit, and whether only a label such as 'Figure 3.2' is left."""
    text = T.collapse(F.regexp_replace(T._col(c), r"(?i)\s*\((?:credit|source|attribution)[^)]*\)\s*\.?$", ""))
    return F.struct(text.alias("text"), text.rlike(r"(?i)^(?:figure|fig\.?|table)\s*[\d.]+\.?$").alias("label_only"))


def table_caption(own, summary, label, reference) -> Column:
    blank = lambda c: F.nullif(F.trim(T._col(c)), F.lit(""))
    return F.coalesce(blank(own), blank(summary), blank(label), F.nullif(T.first_sentence(reference), F.lit("")), F.lit("Data table"))


def attribution(title, publisher, book, authors, license_) -> Column:
    """The source-and-licence line of a page; what is not stated is said not to be."""
    people = F.when(F.size(T._col(authors)) > 0, F.concat(F.lit("by "), F.array_join(T._col(authors), ", "))).otherwise("authors not stated")
    source = F.coalesce(F.nullif(F.trim(T._col(publisher)), F.lit("")), F.concat(F.lit("from "), T._col(book)))
    terms = F.coalesce(F.concat(F.lit("licensed under "), F.nullif(F.trim(T._col(license_)), F.lit(""))), F.lit("license not stated"))
    return F.concat(T._col(title), F.lit(", "), source, F.lit(", "), people, F.lit(", "), terms, F.lit(". This version was modified."))


def authorable(courses: DataFrame) -> DataFrame:
    """Courses where some enrolment teaches, assists or designs."""
    return courses.filter(F.exists("enrollments", lambda e: e["type"].isin("teacher", "ta", "designer"))).withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Untitled course")))


def admit_images(hits: DataFrame) -> DataFrame:
    """Search hits whose licence allows reuse, as cc0, pd, by or by-sa, with a credit line; non-commercial, no-derivatives and unknown ones are dropped."""
    name = F.lower(F.regexp_replace(F.coalesce("license_name", F.lit("")), r"[\s_-]+", "-"))
    code = F.when(name.rlike("(?:^|-)n[cd](?:-|$)"), None).when(name.rlike("^cc0|^cc-zero"), "cc0").when(name.rlike("^public-domain|^pd(?:-|$)"), "pd").when(name.rlike("^(?:cc-)?by-sa"), "by-sa").when(name.rlike("^(?:cc-)?by(?:-|$)"), "by")
    good = hits.withColumn("code", code).filter(F.col("code").isNotNull() & (F.col("code").isin("cc0", "pd") | F.col("deed_url").isNotNull()) & (F.col("width") > 0) & (F.col("height") > 0))
    return good.withColumn("credit", F.concat_ws(" · ", "title", "author", "source", "license_name")).withColumn("share_alike", F.col("code") == "by-sa")


def admit_documents(files: DataFrame, capabilities: DataFrame, most: int = 16 << 20) -> DataFrame:
    """files (name, detected, length, content) with the first reason to refuse them; capabilities: (extension, format, enabled)."""
    joined = files.withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))).join(capabilities, "extension", "left")
    reason = (
        F.when(F.col("format").isNull(), "unknown-format").when(~F.col("enabled"), "disabled").when(F.col("length") > most, "too-large")
        .when(F.col("detected").isNotNull() & (F.col("detected") != F.col("format")), "format-differs").when((F.col("format") == "pdf") & (F.hex(F.substring("content", 1, 5)) != "255044462D"), "not-a-pdf")
    )
    return joined.withColumn("reason", reason)


def validate_metadata(df: DataFrame) -> DataFrame:
    """Works with their first problem in rights metadata."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    problem = (
        F.when(blank("title"), "title").when(~F.coalesce(F.col("authority").isin("owner", "licensed", "public-domain", "permission"), F.lit(False)), "authority").when(~F.coalesce("acknowledged", F.lit(False)), "acknowledgement")
        .when(~blank("license_url") & blank("license_name"), "license-name").when(~blank("source_url") & ~T.is_public_url("source_url"), "source-url")
    )
    return df.withColumn("problem", problem)


def findings_rollup(removals: DataFrame, doc: str) -> DataFrame:
    """Per document and code the removed items, sorted, and their number."""
    return removals.groupBy(doc, "code").agg(F.array_sort(F.collect_set("item")).alias("items"), F.count(F.lit(1)).alias("n"))


def split_points(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, page, block): every inner block boundary of planned pages with block lists."""
    return pages.filter(F.size("blocks") > 1).select(doc, "page", F.explode(F.slice("blocks", 2, F.size("blocks") - 1)).alias("block"))


def confirm_plan(pages: DataFrame, doc: str) -> DataFrame:
    """Included pages in order as numbered sections."""
    return pages.filter("included").withColumn("section", F.row_number().over(Window.partitionBy(doc).orderBy("page")))


def confirmed_report(findings: DataFrame, counts: DataFrame, confirmed: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """(findings, counts) of documents whose plan is confirmed: findings lose the page that they named, as no page of that name is left, and `sections` counts the confirmed ones."""
    made = confirmed.groupBy(doc).agg(F.count(F.lit(1)).alias("sections"))
    return findings.drop("section_id"), counts.drop("sections").join(made, doc, "left").fillna(0, ["sections"])


def publish_blockers(chapters: DataFrame) -> DataFrame:
    """(chapter, blocker) rows of chapters (chapter, pages, queued, failed, blockers, audited, destination, and where known images and via): an interface takes no images."""
    tests = {"no-destination": F.col("destination").isNull(), "nothing-to-publish": F.col("pages") == 0, "unanswered": F.col("queued") > 0, "failed-pages": F.col("failed") > 0, "accessibility": F.col("blockers") > 0, "not-audited": ~F.col("audited")}
    if {"images", "via"} <= set(chapters.columns):
        tests["images-to-api"] = (F.col("images") > 0) & (F.col("via") == "api")
    return chapters.select("chapter", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("blocker"))


def publish_groups(pages: DataFrame, chapter: str = "chapter") -> DataFrame:
    """Per chapter of pages (status, error): pages to be written anew, over others, or in doubt, and those that failed."""
    live = F.col("error").isNull()
    status = lambda name: F.count_if(live & (F.col("status") == name)).alias(name)
    return pages.groupBy(chapter).agg(status("new"), status("overwrite"), status("unknown"), F.count_if(~live).alias("failed"))


def export_rubric(ratings: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """Per chapter a JSON record and a Markdown table of (row_id, rating, note), bars escaped."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    rows = F.array_sort(F.collect_list(F.struct("row_id", F.coalesce("rating", F.lit("not rated")).alias("rating"), safe(F.col("note")).alias("note"))))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), r["row_id"].cast("string"), F.lit(" | "), r["rating"], F.lit(" | "), r["note"], F.lit(" |")))
    table = F.concat(F.lit("| row | rating | note |\n| --- | --- | --- |\n"), F.array_join(lines, "\n"))
    return ratings.groupBy(chapter).agg(F.to_json(F.struct(rows.alias("rows"))).alias("json"), table.alias("markdown"))


def export_review(rows: DataFrame, checks: DataFrame, applied: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """(chapter, json, markdown) of whole reviews: rows (category, row_id, rating, note), checks (category, element, answer) and applied edits (ord, category, section, kind, original, replacement, stale).

    The Markdown is a table of ratings, the checklist and the list of edits in their order; the JSON holds the same, unescaped. Chapters that no table of the three names aren't there.
    """
    line = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(x) for x in c]), F.lit(" |"))
    listed = lambda df, order, fields, cells, name: df.groupBy(chapter).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("j"), line(*cells).alias("l")))).alias(name))
    rating = F.coalesce("rating", F.lit("not rated")).alias("rating")
    state = F.when(F.col("stale"), F.concat("kind", F.lit(" (stale)"))).otherwise(F.col("kind"))
    parts = [
        listed(rows, ["category", "row_id"], ["category", "row_id", rating, "note"], ["category", "row_id", rating, "note"], "rows"), listed(checks, ["category", "element"], ["category", "element", "answer"], ["category", "element", "answer"], "checklist"),
        listed(applied, ["ord"], ["category", "section", "kind", "original", "replacement", "stale"], ["category", "section", state, "original", "replacement"], "applied"),
    ]
    whole = parts[0].join(parts[1], chapter, "full_outer").join(parts[2], chapter, "full_outer")
    lines = lambda n: F.coalesce(F.transform(n, lambda x: x["l"]), F.array().cast("array<string>"))
    json = F.to_json(F.struct(*[F.transform(n, lambda x: x["j"]).alias(n) for n in ("rows", "checklist", "applied")]))
    markdown = F.concat(
        F.lit("## Ratings\n\n"), _table(["Category", "Row", "Rating", "Note"], lines("rows")), F.lit("\n\n## Checklist\n\n"), _table(["Category", "Element", "Answer"], lines("checklist")),
        F.lit("\n\n## Edits\n\n"), _table(["Category", "Section", "Kind", "Original", "Replacement"], lines("applied")),
    )
    return whole.select(chapter, json.alias("json"), markdown.alias("markdown"))


def _cell(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(T._col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")


def _table(head: list[str], rows: Column) -> Column:
    lines = F.concat(F.lit(f"| {' | '.join(head)} |\n| {' | '.join('---' for _ in head)} |\n"), F.array_join(rows, "\n"))
    return F.when(F.size(rows) > 0, lines).otherwise("None.")


def export_patterns(areas: DataFrame, revisions: DataFrame, book: str = "book") -> DataFrame:
    """(book, markdown): what was seen over a whole book: a table of areas (area, rating, notes) and one of revisions (ord, where, revision, rationale) in their order."""
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    said = F.array_sort(F.collect_list(F.struct("area", line(_cell("area"), F.coalesce("rating", F.lit("no draft")), F.coalesce(F.nullif(_cell("notes"), F.lit("")), F.lit("no draft"))).alias("line"))))
    first = areas.groupBy(book).agg(F.transform(said, lambda r: r["line"]).alias("_areas"))
    told = F.array_sort(F.collect_list(F.struct("ord", line(_cell("where"), _cell("revision"), _cell("rationale")).alias("line"))))
    second = revisions.groupBy(book).agg(F.transform(told, lambda r: r["line"]).alias("_revisions"))
    none = F.array().cast("array<string>")
    both = first.join(second, book, "full_outer")
    return both.select(book, F.concat(F.lit("## Areas\n\n"), _table(["Area", "Rating", "Notes"], F.coalesce("_areas", none)), F.lit("\n\n## Revisions\n\n"), _table(["Where", "Revision", "Rationale"], F.coalesce("_revisions", none))).alias("markdown"))


def export_plan(plan: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """(chapter, markdown): a chapter's revision plan (priority, ord, where, issue, revision) as a table, by priority and then in its order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("priority").cast("string"), _cell("where"), _cell("issue"), _cell("revision")), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct("priority", "ord", line.alias("line"))))
    return plan.groupBy(chapter).agg(_table(["Priority", "Where", "Issue", "Revision"], F.transform(rows, lambda r: r["line"])).alias("markdown"))


def parse_rating(c) -> Column:
    """A rating from free text: the first of its names, or null."""
    name = F.lower(F.regexp_extract(T._col(c), r"(?i)\b(exclusive|emerging|inclusive|n/?a|not applicable)\b", 1))
    return F.when(name.isin("n/a", "na", "not applicable"), "na").otherwise(F.nullif(name, F.lit("")))


RATINGS = {"not applicable": "na", "n/a": "na", "na": "na", "exclusive": "exclusive", "emerging inclusive": "emerging", "emerging": "emerging", "inclusive": "inclusive"}


def rubric_drafts(replies: DataFrame, rows: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """(key, area, row_id, rating, notes): of every area that a reply names, all its rubric rows (area, row_id), rated or null.

    A row is named by its letter or in full at the start of what the reply gives; a rating of the area itself counts
    only where the area has one row. Later entries of an area or row count.
    """
    schema = "areas array<struct<area:string, rating:string, notes:string, rows:array<struct<row:string, rating:string>>>>"
    named = F.create_map(*[F.lit(x) for pair in RATINGS.items() for x in pair])
    rating = lambda c: named[F.lower(F.trim(F.coalesce(c, F.lit(""))))]
    areas = replies.select(key, F.posexplode(F.from_json(reply, schema)["areas"]).alias("_n", "_a")).withColumn("area", F.nullif(F.regexp_extract(F.trim("_a.area"), r"^(7\.[1-8])", 1), F.lit(""))).filter("area IS NOT NULL")
    given = areas.select(key, "_n", "area", F.posexplode("_a.rows").alias("_m", "_r"))
    at = lambda i: F.regexp_extract(F.trim("_r.row"), r"^(?i)(?:(7\.[1-8])\.)?([a-z])(?![a-z0-9])", i)
    given = given.filter(at(2) != "").select(key, "area", F.concat(F.coalesce(F.nullif(at(1), F.lit("")), F.col("area")), F.lit("."), F.lower(at(2))).alias("row_id"), rating(F.col("_r.rating")).alias("rating"), F.struct("_n", "_m").alias("_o"))
    given = given.groupBy(key, "area", "row_id").agg(F.max_by(F.struct("rating"), "_o").alias("_g"))
    last = areas.groupBy(key, "area").agg(F.max_by(F.struct(rating(F.col("_a.rating")).alias("own"), F.coalesce("_a.notes", F.lit("")).alias("notes")), "_n").alias("_l"))
    sized = rows.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("area")))
    every = last.join(sized, "area").join(given, [key, "area", "row_id"], "left")
    return every.select(key, "area", "row_id", F.when(F.col("_g").isNotNull(), F.col("_g.rating")).when(F.col("_size") == 1, F.col("_l.own")).alias("rating"), F.col("_l.notes").alias("notes"))


def rated_categories(ratings: DataFrame, rows: DataFrame) -> DataFrame:
    """(chapter_id, category, complete): whether every rubric row of a category has a rating; rows: (category, row_id)."""
    sizes = rows.groupBy("category").agg(F.count(F.lit(1)).alias("_of"))
    done = ratings.filter("rating IS NOT NULL").join(rows, "row_id").groupBy("chapter_id", "category").agg(F.count_distinct("row_id").alias("_n"))
    return done.join(sizes, "category").select("chapter_id", "category", (F.col("_n") == F.col("_of")).alias("complete"))


def applied_edits(edits: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """edits (original) with whether they are stale: their text no longer stands in the block."""
    return edits.join(blocks.select(*on, "text"), on, "left").withColumn("stale", ~F.coalesce(F.col("text").contains(F.col("original")), F.lit(False))).drop("text")


def edit_category(kind, own, lexicon) -> Column:
    """The category of an edit: 7.1 for images, else its own, else the lexicon's, else 7.6."""
    return F.when(T._col(kind) == "image", "7.1").otherwise(F.coalesce(T._col(own), T._col(lexicon), F.lit("7.6")))


def in_quotation(tree_path, text) -> Column:
    """Inside a quoting element, or in a block with a citation."""
    return F.exists(T._col(tree_path), lambda t: t.isin("blockquote", "q", "cite")) | T._col(text).rlike(CITATION)


def ocr_pages(detected: DataFrame, measured: DataFrame, doc: str, enough: int = 40, kinds: DataFrame | None = None) -> DataFrame:
    """(doc, page) to be read by OCR: those a detector names and those measured without text, less pages with at least `enough` characters; every page of documents (doc, kind) that hold no text."""
    named = detected.select(doc, "page").unionByName(measured.filter("text_length = 0").select(doc, "page")).distinct()
    wanted = named.join(measured.filter(F.col("text_length") >= enough).select(doc, "page"), [doc, "page"], "left_anti")
    if kinds is None:
        return wanted
    scanned = kinds.filter("kind <> 'text'").select(doc)
    return wanted.unionByName(measured.join(scanned, doc, "left_semi").select(doc, "page")).distinct()


def deck_findings(slides: DataFrame, deck: str = "deck_id", claims: DataFrame | None = None) -> DataFrame:
    """Per deck: untitled slides, slides with notes, objects that have no page form, titles out of order where the slides tell it, and, with what reconciliation gave (deck, status), blocks that belong to no slide."""
    late = F.count_if(F.coalesce("title_out_of_order", F.lit(False))) if "title_out_of_order" in slides.columns else F.lit(0).cast("long")
    found = slides.groupBy(deck).agg(F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("untitled"), F.count_if(F.trim(F.coalesce("notes", F.lit(""))) != "").alias("with_notes"), F.sum(F.col("charts") + F.col("diagrams") + F.col("media")).alias("unrepresentable"), late.alias("out_of_order"))
    if claims is None:
        return found
    orphans = claims.groupBy(deck).agg(F.count_if(F.col("status") == "orphan").alias("unattributed"))
    return found.join(orphans, deck, "left").withColumn("unattributed", F.coalesce("unattributed", F.lit(0)))


def picture_refs(slides: DataFrame, deck: str = "deck_id") -> DataFrame:
    """(deck, part, n, sole): how many slides show a picture, and whether only one does."""
    shown = slides.select(deck, "number", F.explode(F.array_distinct("picture_origins")).alias("part"))
    return shown.groupBy(deck, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("sole", F.col("n") == 1)


def review_verdict(ratings: DataFrame, key: DataFrame, least: float = 90.0) -> DataFrame:
    """One row of ratings (item, coverage, unsafe) against the items that were to be rated: counts of what is wrong, mean coverage, and whether the review passes."""
    known = ratings.join(key.select("item").distinct(), "item", "left_semi")
    s = known.agg(F.count(F.lit(1)).alias("reviewed"), F.count_distinct("item").alias("_items"), F.count_if(~F.coalesce(F.col("coverage").between(0, 100), F.lit(False))).alias("invalid"), F.count_if(F.coalesce("unsafe", F.lit(False))).alias("unsafe"), F.coalesce(F.avg(F.coalesce("coverage", F.lit(0))), F.lit(0.0)).alias("_mean"))
    s = s.crossJoin(key.agg(F.count_distinct("item").alias("expected"))).crossJoin(ratings.agg(F.count(F.lit(1)).alias("_rows")))  # three tables of one row
    missing, duplicate = F.col("expected") - F.col("_items"), F.col("reviewed") - F.col("_items")
    passed = (F.col("_rows") == F.col("expected")) & (missing == 0) & (duplicate == 0) & (F.col("invalid") == 0) & (F.col("unsafe") == 0) & (F.col("_mean") >= least)
    return s.select("reviewed", "expected", missing.alias("missing"), duplicate.alias("duplicate"), "invalid", "unsafe", F.round("_mean", 1).alias("mean_coverage"), passed.alias("passed"))


def validate_ratings(ratings: DataFrame, key: DataFrame) -> DataFrame:
    """One row: items missing, rated twice, out of 1 to 5, and whether the set passes."""
    by_item = key.select("item").join(ratings.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("score").between(1, 5)).alias("bad"), F.avg("score").alias("mean")), "item", "left")
    s = by_item.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("duplicate"), F.coalesce(F.sum("bad"), F.lit(0)).alias("out_of_range"))
    return s.withColumn("passed", (F.col("missing") == 0) & (F.col("duplicate") == 0) & (F.col("out_of_range") == 0))


# Words for people.
PEOPLE = (
    "person", "people", "man", "men", "woman", "women", "boy", "boys", "girl", "girls", "child", "children", "baby", "infant", "toddler", "teen", "teenager", "adult", "adults", "student", "students", "teacher", "teachers",
    "instructor", "professor", "worker", "workers", "nurse", "nurses", "doctor", "doctors", "physician", "patient", "patients", "scientist", "scientists", "researcher", "researchers", "engineer", "engineers", "farmer", "farmers",
    "family", "families", "parent", "parents", "mother", "father", "couple", "crowd", "group of", "team", "athlete", "athletes", "player", "players", "customer", "customers", "shopper", "employee", "employees", "soldier", "soldiers",
    "officer", "officers", "portrait", "face", "faces", "hand", "hands", "someone", "anyone", "everyone",
)


def image_inventory(images: DataFrame, words: tuple[str, ...] = PEOPLE, alt: str = "alt", caption: str = "caption") -> DataFrame:
    """images with their alt defect and whether alt or caption mention people, by whole words."""
    people = "(?i)(?<![\\w-])(?:" + "|".join(words) + ")(?![\\w-])"
    return images.withColumn("issue", A.alt_issue(alt)).withColumn("mentions_people", F.concat_ws(" ", F.coalesce(alt, F.lit("")), F.coalesce(caption, F.lit(""))).rlike(people))


def image_summary(inventory: DataFrame, alt: str = "alt") -> DataFrame:
    """One row over image_inventory(): images, those that mention people, declared decorative ones, and those without text."""
    return inventory.agg(F.count(F.lit(1)).alias("images"), F.count_if("mentions_people").alias("with_people"), F.count_if(F.trim(alt) == "").alias("decorative"), F.count_if(F.col(alt).isNull()).alias("no_alt"))


def section_bodies(sections: DataFrame, images: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """(chapter, body): the sections (section_id, ord, title, text) of a chapter in order, each with the texts and captions of its images (section_id, pos, alt, caption)."""
    told = F.concat(F.lit('alt="'), F.coalesce("alt", F.lit("(none)")), F.lit('" caption="'), F.coalesce("caption", F.lit("")), F.lit('"'))
    listed = images.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", told.alias("t")))), lambda i: i["t"]), " | ").alias("_images"))
    body = F.concat(F.lit("## "), "title", F.lit("\n"), "text", F.lit("\n\nImages: "), F.coalesce("_images", F.lit("(none)")))
    rows = sections.join(listed, "section_id", "left").select(chapter, F.struct("ord", "section_id", body.alias("body")).alias("s"))
    return rows.groupBy(chapter).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["body"]), "\n\n").alias("body"))
