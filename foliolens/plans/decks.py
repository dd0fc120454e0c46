"""Queries of paged documents, decks and restored reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from foliolens.operators import decks as D
from foliolens.plans.registry import query, table


@query("SELECT l_orderkey AS deck_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS block_idx, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) END::INT AS slide, CASE WHEN l_suppkey % 10 = 0 THEN 'orphan' ELSE 'text' END AS status FROM lineitem UNION ALL SELECT l_orderkey, NULL, n::INT, 'missing-text' FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE l_suppkey % 10 = 0")
def decks_reconciled(spark, sf_dir):
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deck_id"), "l_linenumber", "l_partkey", "l_suppkey")
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("deck_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    text = F.concat(F.lit("Slide <"), F.col("n").cast("string"), F.lit("> of "), F.col("l_partkey").cast("string"))
    none = F.array().cast("array<string>")
    slides = lines.select(F.col("deck_id").alias("deck_id"), F.col("n").alias("number"), F.array(text).alias("text_runs"), F.lit("").alias("notes"), none.alias("picture_origins"))
    blocks = lines.select(F.col("deck_id").alias("deck_id"), (F.col("n") - 1).alias("block_idx"), F.when(F.col("l_suppkey") % 10 == 0, "elsewhere").otherwise(text).alias("text"), none.alias("picture_origins"))
    return D.reconcile(slides, blocks)


@query("""WITH m AS (SELECT l_orderkey AS doc, l_linenumber AS page, max(l_suppkey % 7) AS images FROM lineitem GROUP BY 1, 2), a AS (SELECT doc, page, false AS added, images FROM m WHERE page % 3 > 0 UNION ALL SELECT doc, page, true, 1 FROM m WHERE page % 3 = 0),
o AS (SELECT *, last_value(CASE WHEN NOT added THEN page END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own FROM a)
SELECT doc, page, CASE WHEN added THEN 0 ELSE 4 END::INT AS text_length, CASE WHEN added THEN 1 ELSE greatest(0, images - sum(CASE WHEN added THEN 1 ELSE 0 END) OVER (PARTITION BY doc, own)) END::BIGINT AS images, added FROM o""")  # fmt: skip
def document_pages(spark, sf_dir):
    marked = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.max(F.col("l_suppkey") % 7).alias("images")).withColumn("text", F.lit("ab \n cd"))
    return D.page_summaries(marked.filter("page % 3 > 0"), marked.filter("page % 3 = 0").withColumn("images", F.lit(1)), "doc")


_PAGES = "WITH m AS (SELECT l_orderkey AS doc, l_linenumber AS page, max(l_suppkey % 3) AS images, max(l_partkey % 60) AS t FROM lineitem GROUP BY 1, 2), f AS (SELECT doc, page, 'empty-page' AS code FROM m WHERE t = 0 AND images = 0 UNION ALL SELECT doc, page, 'needs-ocr' FROM m WHERE t < 40 AND images > 0 UNION ALL SELECT doc, page, 'figures-lost' FROM m WHERE images > 1) "


@query(_PAGES + "SELECT doc, code, count(*) AS n, CASE WHEN count(*) = 1 THEN min(page) END AS page FROM f GROUP BY doc, code")
def document_findings(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.max(F.col("l_suppkey") % 3).alias("images"), F.max(F.col("l_partkey") % 60).alias("text_length")).withColumn("packaged", F.lit(1))
    return D.document_findings(pages, "doc")


@query("SELECT p_partkey AS id, 'r1' AS row, CASE p_partkey % 3 WHEN 0 THEN 'na' ELSE 'inclusive' END AS rating, least(100, greatest(0, p_size * 4 - 50))::DOUBLE AS benchmark FROM part WHERE p_partkey % 5 > 0")
def reviews_restored(spark, sf_dir):
    k = F.col("p_partkey")
    version = F.when(k % 5 == 0, "9").otherwise("1")
    rating = F.when(k % 3 == 0, "na").otherwise("inclusive")
    json = F.concat(F.lit('{"version":'), version, F.lit(',"benchmark":'), (F.col("p_size") * 4 - 50).cast("string"), F.lit(',"ratings":{"r1":"'), rating, F.lit('","r2":"great","zz":"na"}}'))
    return D.restore_reviews(table(spark, sf_dir, "part").select(k.alias("id"), json.alias("j")), "j", ["r1", "r2"])


@query("WITH h AS (SELECT p_partkey % 50 AS section_id, lower(p_type) AS gram FROM part), c AS (SELECT section_id, CASE WHEN gram LIKE 'p%' THEN '7.1' ELSE '7.6' END AS category FROM h) SELECT category, count(*) AS n, count(DISTINCT section_id) AS sections FROM c GROUP BY category")
def findings_by_category(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    hits = part.select((F.col("p_partkey") % 50).alias("section_id"), F.lower("p_type").alias("gram"))
    rules = part.filter(F.lower("p_type").startswith("p")).select(F.col("p_type").alias("phrase"), F.lit("7.1").alias("category")).distinct()
    return D.findings_by_category(D.term_category(hits, rules))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_name AS name FROM part WHERE p_partkey % 5 > 0)
SELECT k AS id, 'edit' AS kind, 's::b::0::' || name AS item, 'new ' || name AS value FROM p WHERE s % 2 = 0 UNION ALL SELECT k, 'image', 's::image::0::' || name || '.jpg', name || '.jpg' FROM p WHERE s % 3 > 0
UNION ALL SELECT k, 'asset', name || '.jpg', '6279746573' FROM p WHERE s % 3 > 0 UNION ALL SELECT k, 'rating', 'r1', CASE WHEN k % 3 = 0 THEN 'na' ELSE 'inclusive' END FROM p UNION ALL SELECT k, 'answer', 'e', 'yes' FROM p WHERE s % 4 > 0
UNION ALL SELECT k, 'header', name, least(100, greatest(0, s * 4 - 50))::INTEGER::VARCHAR FROM p""")
def documents_restored(spark, sf_dir):
    """Whole review documents: some of another version, with ratings and answers that are none, edits without text, pictures without bytes."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    text = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("")), F.lit('"'))
    of = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    file = F.concat(name, F.lit(".jpg"))
    image = of('{"kind":"image","placement":{"kind":"replace","elementId":"b"},"assetName":', text(file), ',"width":3,"height":4,"alt":"","caption":"c","attribution":{"text":"t","sourcePageUrl":"u","licenseName":"l","shareAlike":false}}')
    edits = of('{"c":{"edits":{', text(of("s::b::0::", name)), ':{"kind":"replace","replacement":', F.when(size % 2 == 0, text(of("new ", name))).otherwise("7"), "},", text(of("s::image::0::", file)), ":", image, ',"key":{"kind":"keep"}}}}')
    assets = of('{"c":[{"id":"1","mediaType":"m","extension":"e","sha256":"s","originPart":"o","name":', text(file), ',"bytes":', F.when(size % 3 > 0, F.lit('"Ynl0ZXM="')).otherwise('"%"'), "}]}")
    rating = F.when(k % 3 == 0, "na").otherwise("inclusive")
    review = of('{"c":{"categories":{"7.1":{"ratings":{"r1":"', rating, '","r2":"great"},"checklist":{"e":', F.when(size % 4 > 0, F.lit('"yes"')).otherwise("true"), '}},"8":{"ratings":{"r1":"na"}}}}}')
    json = of('{"version":', F.when(k % 5 == 0, "2").otherwise("1"), ',"header":{"assessor":{"name":', text(name), '},"benchmark":{"bipocPercent":', size * 4 - 50, '}},"reviews":', review, ',"edits":', edits, ',"assets":', assets, "}")
    got = D.restore_documents(table(spark, sf_dir, "part").select(k.alias("id"), json.alias("json")), "json", ["7.1", "7.2"])
    row = lambda df, kind, item, value: df.select("id", F.lit(kind).alias("kind"), F.col(item).alias("item"), value.cast("string").alias("value"))
    rows = [row(got.edits.filter("kind = 'replace'"), "edit", "edit", F.col("replacement")), row(got.edits.filter("kind = 'image'"), "image", "edit", F.col("name")), row(got.assets, "asset", "name", F.lower(F.hex("bytes")))]
    rows += [row(got.ratings, "rating", "row", F.col("value")), row(got.answers, "answer", "element", F.col("value")), row(got.header, "header", "name", F.col("benchmark").cast("int")), row(got.edits.filter("kind = 'keep'"), "keep", "edit", F.col("edit"))]
    return reduce(lambda a, b: a.unionByName(b), rows)
