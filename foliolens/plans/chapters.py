"""Queries of chapter assembly, imports and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import chapters as H
from foliolens.plans.registry import query, table


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), 'l' || c_custkey)::INT AS n, c_name AS title FROM customer WHERE c_custkey % 6 > 0")
def catalog_networks(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = c.select("c_custkey", F.col("c_nationkey").alias("network"), F.when(F.col("c_custkey") % 6 > 0, F.concat(F.lit("l"), F.col("c_custkey").cast("string"))).alias("link"), F.concat(F.lit("<b> "), "c_name", F.lit(" </b>")).alias("title"))
    return H.catalog_by_network(raw).select("c_custkey", "n", "title")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'CC BY' WHEN 1 THEN 'Public Domain' ELSE 'odd' END AS license, 'A' || s_suppkey || '|B' AS authors FROM supplier")
def catalog_licenses(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    code = F.when(F.col("s_suppkey") % 3 == 0, "ccby").when(F.col("s_suppkey") % 3 == 1, "publicdomain").otherwise("odd")
    return s.select("s_suppkey", H.license_name(code).alias("license"), F.array_join(H.split_authors(F.concat(F.lit("A"), F.col("s_suppkey").cast("string"), F.lit(" and B; "))), "|").alias("authors"))


@query("SELECT 'b' || p_partkey AS book, 'v' || p_size AS version, p_partkey % 2 = 0 AS retired FROM part")
def release_versions(spark, sf_dir):
    entry = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"defaultVersion":"v'), F.col("p_size").cast("string"), F.lit('","retired":true}'))).otherwise(F.concat(F.lit('{"defaultVersion":"v'), F.col("p_size").cast("string"), F.lit('"}')))
    return H.release_versions(table(spark, sf_dir, "part").select(F.concat(F.lit('{"books":{"b'), F.col("p_partkey").cast("string"), F.lit('":'), entry, F.lit("}}")).alias("j")), "j")


@query("""SELECT o_orderkey AS book, l_linenumber AS n, CASE WHEN l_linenumber % 4 = 0 THEN 'missing' WHEN l_linenumber % 4 = 1 THEN 'empty' END AS error,
  CASE WHEN l_linenumber % 4 = 0 OR l_linenumber % 3 = 0 THEN 'https://b/' || o_orderkey ELSE 'https://p/' || l_linenumber END AS canonical_url, o_orderpriority AS license FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")  # fmt: skip
def chapters_assembled(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("n")).withColumn("node", F.concat_ws("-", F.col("book").cast("string"), F.col("n").cast("string"))).withColumn("chapter", F.lit("c"))
    n = F.col("n")
    pages = lines.filter(n % 4 != 0).select("book", "node", F.when(n % 4 == 1, " ").otherwise("<p>").alias("html"), F.when(n % 3 != 0, F.concat(F.lit("https://p/"), n.cast("string"))).alias("url")).dropDuplicates(["node"])
    books = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), F.concat(F.lit("https://b/"), F.col("o_orderkey").cast("string")).alias("book_url"), F.col("o_orderpriority").alias("license"))
    return H.assemble_chapters(lines, pages, books).select("book", "n", "error", "canonical_url", "license")


@query("SELECT n_nationkey, u.n::INT AS n, u.id FROM nation, (VALUES (1, 1), (2, 3), (3, 5)) AS u(n, id)")
def three_part_outlines(spark, sf_dir):
    item = lambda i, words: f'{{"id":{i},"title":"t","has_content":true,"words":{words}}}'
    toc = f'{{"front":[{item(1, 5)},{item(2, 0)}],"parts":[{{"chapters":[{item(3, 9)}]}},{{"chapters":[]}}],"back":[{{"id":4,"title":"x","words":3}},{item(5, 1)}]}}'
    return H.three_part_outline(table(spark, sf_dir, "nation").withColumn("toc", F.lit(toc)), "toc", "n_nationkey").select("n_nationkey", "n", "id")


_UUID = "substr(md5(p_partkey::VARCHAR), 1, 8) || '-' || substr(md5(p_partkey::VARCHAR), 9, 4) || '-' || substr(md5(p_partkey::VARCHAR), 13, 4) || '-' || substr(md5(p_partkey::VARCHAR), 17, 4) || '-' || substr(md5(p_partkey::VARCHAR), 21, 12)"


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'https://x/y#z' WHEN p_size < 25 THEN 'https://site/b/pages/s' || p_partkey || '#f' END AS resolved, p_partkey % 3 > 0 AND p_size >= 25 AS unresolved FROM part")
def xrefs_resolved(spark, sf_dir):
    m = F.md5(F.col("p_partkey").cast("string"))
    part = table(spark, sf_dir, "part").withColumn("node", F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12)))
    nodes = part.select(F.lit("b").alias("book"), F.col("node").alias("node"), F.when(F.col("p_size") < 25, F.concat(F.lit("s"), F.col("p_partkey").cast("string"))).alias("slug"))
    links = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "https://x/y#z").otherwise(F.concat(F.lit("/contents/"), "node", F.lit("#f"))).alias("href"))
    return H.resolve_xrefs(links, H.xref_map(nodes, "https://site/")).select("p_partkey", "resolved", "unresolved")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Read more about ' || p_brand || ' b ' || p_size WHEN 1 THEN 'Email ' || p_type || '@x.org' WHEN 2 THEN 'Read more about h.example' WHEN 3 THEN 'Own ' || p_name
  WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 'Go to ' || substr(p_name || ' ' || repeat('x', p_size * 3), 1, 96) ELSE 'link' END ELSE 'Read more about h.example' END AS label FROM part""")
def links_labelled(spark, sf_dir):
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    size = F.col("p_size").cast("string")
    href = (
        F.when(k == 0, F.concat(F.lit("https://h.example/x/"), F.regexp_replace("p_brand", "#", "%23"), F.lit("-b_"), size, F.lit(".html?q#f"))).when(k == 1, F.concat(F.lit("mailto:"), "p_type", F.lit("@x.org?subject=s")))
        .when(k == 4, F.concat(F.lit("#"), size)).when(k == 5, F.lit("https://h.example/index.php")).otherwise("https://h.example/")
    )
    text = F.when(k == 3, F.concat(F.lit(" Own  "), name)).when(k == 2, "https://h.example/").when(k == 4, "link").otherwise("Click here")
    part = table(spark, sf_dir, "part")
    links = part.select("p_partkey", href.alias("href"), text.alias("text"))
    targets = part.filter("p_size % 2 = 0").select("p_partkey", size.alias("id"), F.concat(name, F.lit("  "), F.repeat(F.lit("x"), F.col("p_size") * 3)).alias("text"))
    return H.label_links(links, targets, "p_partkey").select("p_partkey", "label")


@query("SELECT p_partkey, p_name || ', from Book, ' || CASE WHEN p_size % 2 = 0 THEN 'by ' || p_brand || ', X' ELSE 'authors not stated' END || ', ' || CASE WHEN p_size % 3 = 0 THEN 'licensed under CC' ELSE 'license not stated' END || '. This version was modified.' AS line FROM part")
def attribution_lines(spark, sf_dir):
    authors = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.lit("X"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", H.attribution("p_name", F.lit(" "), F.lit("Book"), authors, F.when(F.col("p_size") % 3 == 0, "CC").otherwise("")).alias("line"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Figure 3.2' ELSE 'Figure 1. ' || p_name END AS text, p_size % 3 = 0 AS label_only, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Data table' END AS caption FROM part")
def captions(spark, sf_dir):
    raw = F.when(F.col("p_size") % 3 == 0, "Figure 3.2 (credit: x)").otherwise(F.concat(F.lit("Figure 1.  "), "p_name", F.lit(" (Source: y).")))
    fallback = H.table_caption(F.lit(" "), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit(None).cast("string"), F.lit(""))
    return table(spark, sf_dir, "part").withColumn("c", H.caption_parts(raw)).select("p_partkey", "c.text", "c.label_only", fallback.alias("caption"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'by-sa' WHEN 1 THEN 'cc0' WHEN 2 THEN 'pd' END AS code FROM part WHERE p_partkey % 5 < 3 AND p_size > 1")
def images_admitted(spark, sf_dir):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "CC BY-SA 4.0").when(k == 1, "CC0").when(k == 2, "Public domain").when(k == 3, "CC BY-NC 2.0").otherwise("CC BY 2.0")
    hits = table(spark, sf_dir, "part").select("p_partkey", name.alias("license_name"), F.when(k == 0, "https://deed").alias("deed_url"), (F.col("p_size") - 1).alias("width"), F.lit(5).alias("height"), F.col("p_name").alias("title"), F.lit("a").alias("author"), F.lit("s").alias("source"))
    return H.admit_images(hits).select("p_partkey", "code")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'unknown-format' WHEN 1 THEN 'disabled' WHEN 2 THEN 'too-large' WHEN 3 THEN 'format-differs' WHEN 4 THEN 'not-a-pdf' END AS reason FROM part")
def documents_admitted(spark, sf_dir):
    k = F.col("p_partkey") % 6
    files = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k == 0, "a.xyz").when(k == 1, "a.doc").when(k == 2, "b.x.DOCX").when(k == 3, "c.docx").otherwise("d.pdf").alias("name"), F.when(k == 3, "pdf").alias("detected"),
        F.when(k == 2, 17 << 20).otherwise(10).alias("length"), F.when(k == 4, F.lit("nope")).otherwise(F.lit("%PDF-1.7")).cast("binary").alias("content"),
    )
    able = spark.createDataFrame([("docx", "docx", True), ("doc", "doc", False), ("pdf", "pdf", True)], "extension string, format string, enabled boolean")
    return H.admit_documents(files, able).select("p_partkey", "reason")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'authority' WHEN 2 THEN 'license-name' WHEN 3 THEN 'source-url' END AS problem FROM part")
def metadata_problems(spark, sf_dir):
    k = F.col("p_partkey") % 5
    works = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k == 0, " ").otherwise("t").alias("title"), F.when(k == 1, "me").otherwise("owner").alias("authority"), F.lit(True).alias("acknowledged"), F.when(k == 2, "https://l").alias("license_url"),
        F.lit("").alias("license_name"), F.when(k == 3, "http://127.0.0.1/x").otherwise("https://a.example/x").alias("source_url"),
    )
    return H.validate_metadata(works).select("p_partkey", "problem")


@query("SELECT l_orderkey AS doc, l_linestatus AS code, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS items, count(*) AS n FROM lineitem GROUP BY 1, 2")
def removals_rolled_up(spark, sf_dir):
    removals = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linestatus").alias("code"), F.col("l_returnflag").alias("item"))
    return H.findings_rollup(removals, "doc").withColumn("items", F.array_join("items", ","))


@query("""SELECT o_orderkey AS chapter, unnest(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'no-destination' END, CASE WHEN o_orderkey % 4 = 0 THEN 'nothing-to-publish' END, CASE WHEN o_orderstatus = 'O' THEN 'unanswered' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'accessibility' END, CASE WHEN o_orderstatus = 'P' THEN 'not-audited' END], lambda x: x IS NOT NULL)) AS blocker FROM orders""")  # fmt: skip
def publishing_blockers(spark, sf_dir):
    k = F.col("o_orderkey")
    chapters = table(spark, sf_dir, "orders").select(
        k.alias("chapter"), F.when(k % 5 != 0, "site").alias("destination"), (k % 4).alias("pages"), (F.col("o_orderstatus") == "O").cast("int").alias("queued"), F.lit(0).alias("failed"),
        (k % 3 == 0).cast("int").alias("blockers"), (F.col("o_orderstatus") != "P").alias("audited"),
    )
    return H.publish_blockers(chapters)


@query("SELECT l_orderkey AS chapter_id, '| row | rating | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || CASE WHEN l_returnflag = 'N' THEN 'not rated' ELSE l_returnflag END || ' | a\\|b ' || l_suppkey || ' |', chr(10) ORDER BY l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'not rated' ELSE l_returnflag END, 'a\\|b ' || l_suppkey) AS markdown FROM lineitem GROUP BY 1")
def rubric_exports(spark, sf_dir):
    ratings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chapter_id"), F.col("l_linenumber").alias("row_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("rating"), F.concat(F.lit("a|b\n"), F.col("l_suppkey").cast("string")).alias("note"))
    return H.export_rubric(ratings).select("chapter_id", "markdown")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'inclusive' WHEN 1 THEN 'na' WHEN 2 THEN 'emerging' END AS rating FROM part")
def ratings_parsed(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "Rating: Inclusive.").when(k == 1, "This is N/A here").when(k == 2, "EMERGING, not inclusive").otherwise("unclear")
    return table(spark, sf_dir, "part").select("p_partkey", H.parse_rating(text).alias("rating"))


@query("WITH r AS (SELECT DISTINCT o_custkey AS chapter_id, (o_orderkey % 6)::INT AS row_id FROM orders) SELECT chapter_id, row_id // 3 AS category, count(DISTINCT row_id) = 3 AS complete FROM r GROUP BY 1, 2")
def rubric_categories(spark, sf_dir):
    ratings = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter_id"), (F.col("o_orderkey") % 6).cast("int").alias("row_id"), F.lit("na").alias("rating"))
    return H.rated_categories(ratings, spark.createDataFrame([(i // 3, i) for i in range(6)], "category int, row_id int"))


@query("SELECT doc_id, text NOT LIKE '%the of%' AS stale FROM documents")
def edits_stale(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return H.applied_edits(docs.select("doc_id", F.lit("the of").alias("original")), docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", "stale")


@query("SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem WHERE (l_suppkey % 3 = 0 OR l_partkey % 4 = 0) EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 4 = 1")
def ocr_pages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    measured = lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.when(F.col("l_partkey") % 4 == 0, 0).when(F.col("l_partkey") % 4 == 1, 50).otherwise(10).alias("text_length"))
    return H.ocr_pages(lines.filter("l_suppkey % 3 = 0").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")), measured, "doc")


@query("WITH s AS (SELECT DISTINCT l_orderkey AS deck_id, l_linenumber AS number, l_returnflag AS part FROM lineitem) SELECT deck_id, part, count(*) AS n, count(*) = 1 AS sole FROM s GROUP BY 1, 2")
def deck_picture_refs(spark, sf_dir):
    slides = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("deck_id"), F.col("l_linenumber").alias("number")).agg(F.collect_list("l_returnflag").alias("picture_origins"))
    return H.picture_refs(slides)


@query("SELECT l_orderkey AS deck_id, count(*) FILTER (l_linenumber % 2 = 0) AS untitled, count(*) FILTER (l_suppkey % 5 = 0) AS with_notes, sum(l_linenumber + 1)::BIGINT AS unrepresentable, count(*) FILTER (l_partkey % 4 = 0) AS out_of_order, count(*) FILTER (l_suppkey % 10 = 0) AS unattributed FROM lineitem GROUP BY 1")
def deck_findings(spark, sf_dir):
    from foliolens.plans.decks import decks_reconciled

    n = F.col("l_linenumber")
    slides = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deck_id"), F.when(n % 2 == 1, "t").alias("title"), F.when(F.col("l_suppkey") % 5 == 0, "n").otherwise(" ").alias("notes"), n.alias("charts"), F.lit(1).alias("diagrams"), F.lit(0).alias("media"), (F.col("l_partkey") % 4 == 0).alias("title_out_of_order"))
    return H.deck_findings(slides, claims=decks_reconciled(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, 0 AS duplicate, (SELECT count(*) FROM labels WHERE quality + 5 * toxic NOT BETWEEN 1 AND 5) AS out_of_range, false AS passed")
def ratings_validated(spark, sf_dir):
    ratings = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), (F.col("quality") + 5 * F.col("toxic")).alias("score"))
    return H.validate_ratings(ratings, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item")))


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_-])(idiot|clown|moron)([^a-z0-9_-]|$)') AS mentions_people FROM documents")
def people_mentioned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("alt"), F.col("text").alias("caption"))
    return H.image_inventory(docs, ("idiot", "clown", "moron")).select("doc_id", "mentions_people")


__all__ = ["T"]
