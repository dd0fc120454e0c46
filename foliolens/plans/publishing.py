"""Queries of page planning, identity, matching and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import chapters as H
from foliolens.operators import publishing as B
from foliolens.plans.registry import query, table

# Each line of a document is a block; the level follows from its number, so that levels 1 to 3 occur.
_BLOCKS = """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS html, unnest(range(len(string_split(text, chr(10)))))::INT AS block_idx FROM documents),
blocks AS (SELECT *, CASE WHEN block_idx % 7 = 1 THEN 2 WHEN block_idx % 11 = 3 THEN 1 WHEN block_idx % 5 = 4 THEN 3 END AS level FROM lines),
lv AS (SELECT doc_id, min(level) AS split FROM (SELECT doc_id, level FROM blocks WHERE level IS NOT NULL GROUP BY doc_id, level HAVING count(*) >= 2) GROUP BY doc_id),
m AS (SELECT b.*, split, sum(CASE WHEN level = split THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS pg FROM blocks b LEFT JOIN lv USING (doc_id)),
p AS (SELECT *, CASE WHEN split IS NULL THEN 0 WHEN coalesce(bool_or(pg = 0 AND level IS NULL) OVER (PARTITION BY doc_id), false) THEN pg ELSE greatest(0, pg - 1) END::INT AS page0 FROM m),
pages_ AS (SELECT *, max(page0) OVER (PARTITION BY doc_id) + 1 > 100 AS over_budget FROM p),
planned AS (SELECT *, CASE WHEN over_budget THEN 0 ELSE page0 END AS page FROM pages_) """


def blocks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "html"))
    i = F.col("block_idx")
    return lines.withColumn("level", F.when(i % 7 == 1, 2).when(i % 11 == 3, 1).when(i % 5 == 4, 3))


@query(_BLOCKS + "SELECT doc_id, split FROM lv")
def plan_split_levels(spark, sf_dir):
    return B.split_level(blocks(spark, sf_dir), "doc_id")


@query(_BLOCKS + "SELECT doc_id, block_idx, page, over_budget FROM planned")
def plan_pages(spark, sf_dir):
    return B.propose_pages(blocks(spark, sf_dir), "doc_id").select("doc_id", "block_idx", "page", "over_budget")


@query(
    _BLOCKS + """, g AS (SELECT doc_id, page, min(block_idx) AS first, count(*)::INT AS blocks, md5(string_agg(html, '' ORDER BY block_idx)) AS digest, arg_min(html, block_idx) FILTER (level = split AND NOT over_budget) AS own FROM planned GROUP BY doc_id, page),
b AS (SELECT *, coalesce(nullif(trim(own), ''), 'Document ' || doc_id) AS base FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(base)) ORDER BY page) AS k FROM b)
SELECT doc_id, page, doc_id || '-page-' || (first + 1) AS page_id, blocks, digest, CASE WHEN k = 1 THEN base ELSE base || ' (' || k || ')' END AS title FROM n"""
)
def plan_page_rows(spark, sf_dir):
    planned = B.propose_pages(blocks(spark, sf_dir), "doc_id").withColumn("head", F.col("html"))
    return B.page_rows(planned, "doc_id", "head", "html").withColumn("digest", F.md5("html")).drop("html")


@query("""WITH t AS (SELECT p_partkey // 50 AS doc, p_size, CASE WHEN p_size % 10 = 0 THEN ' ' ELSE p_type END AS title, p_partkey % 3 > 0 AS included FROM part)
SELECT doc, 'none-included' AS problem, NULL AS title FROM t GROUP BY doc HAVING count(*) FILTER (included) = 0
UNION ALL SELECT doc, 'blank-title', title FROM t WHERE included AND trim(title) = ''
UNION ALL SELECT doc, 'duplicate-title', min(title) FROM t WHERE included AND trim(title) <> '' GROUP BY doc, lower(trim(title)) HAVING count(*) > 1""")
def plan_problems(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pages = part.select(F.floor(F.col("p_partkey") / 50).alias("doc"), F.when(F.col("p_size") % 10 == 0, " ").otherwise(F.col("p_type")).alias("title"), (F.col("p_partkey") % 3 > 0).alias("included"))
    return B.validate_plan(pages, "doc")


@query()
def plan_edits_replayed(spark, sf_dir):
    planned = B.propose_pages(blocks(spark, sf_dir), "doc_id")
    pages = planned.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("block_idx")).alias("blocks"))
    pages = pages.select("doc_id", "page", F.concat(F.col("doc_id").cast("string"), F.lit("-page-"), (F.get("blocks", 0) + 1).cast("string")).alias("page_id"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("title"), F.lit(True).alias("included"), "blocks")
    op = F.element_at(F.array(*[F.lit(x) for x in ("rename", "merge-next", "include", "move")]), (F.col("page") % 4 + 1).cast("int"))
    value = F.when(op == "move", "1").when(op == "include", "false").otherwise("New title")
    log = pages.select(F.col("doc_id").alias("doc_id"), F.col("page").cast("long").alias("seq"), op.alias("op"), F.col("page_id").alias("page_id"), value.alias("value"))
    return B.replay_plan_edits(pages, log, "doc_id")


_SECTIONS = "WITH s AS (SELECT p_brand AS export, 'Chapter ' || p_size || ': x' AS chapter_title, CASE WHEN p_partkey % 4 = 0 THEN p_size || '.1 Start' ELSE p_name END AS section_title, p_partkey, p_size FROM part WHERE p_partkey % 13 > 0), b AS (SELECT *, trim(regexp_replace(lower(chapter_title), '[^a-z0-9]+', '-', 'g'), '-') || '-' || trim(regexp_replace(lower(section_title), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM s), t AS (SELECT export, p_partkey, p_size, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug, CASE WHEN regexp_matches(section_title, '^' || p_size || '\\.') THEN section_title ELSE 'Chapter ' || p_size || ' ' || section_title END AS title FROM (SELECT *, row_number() OVER (PARTITION BY export, base ORDER BY p_size, p_partkey) AS n FROM b)) "


def targets(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sections = part.select(
        F.col("p_brand").alias("export"), F.concat(F.lit("Chapter "), F.col("p_size").cast("string"), F.lit(": x")).alias("chapter_title"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".1 Start"))).otherwise(F.col("p_name")).alias("section_title"),
        F.when(F.col("p_partkey") % 13 == 0, "failed").alias("error"), F.lit("<p>").alias("html"), "p_partkey", "p_size",
    )
    return B.page_targets(sections, "export", ["p_size", "p_partkey"]).select("export", "p_partkey", "p_size", "slug", "title")


@query(_SECTIONS + "SELECT * FROM t")
def publish_targets(spark, sf_dir):
    return targets(spark, sf_dir)


_SITE = """, e AS (SELECT export, CASE WHEN p_partkey % 3 = 0 THEN slug ELSE 'u' || p_partkey END AS url, title FROM t WHERE p_partkey % 2 = 0),
f AS (SELECT t.*, e.url AS same FROM t LEFT JOIN e ON e.export = t.export AND e.url = t.slug), free AS (SELECT export, title, count(*) AS n, min(url) AS url FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.export = e.export AND f.same = e.url) GROUP BY export, title),
w AS (SELECT f.*, sum(CASE WHEN same IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY export, title) AS wanting FROM f)
SELECT w.export, w.slug, coalesce(same, CASE WHEN wanting = 1 AND free.n = 1 THEN free.url END) AS existing_url, same IS NULL AND free.n IS NOT NULL AND NOT (wanting = 1 AND free.n = 1) AS ambiguous,
CASE WHEN coalesce(same, CASE WHEN wanting = 1 AND free.n = 1 THEN free.url END) IS NOT NULL THEN 'overwrite' WHEN free.n IS NOT NULL THEN 'unknown' ELSE 'new' END AS status FROM w LEFT JOIN free ON free.export = w.export AND free.title = w.title"""


@query(_SECTIONS + _SITE)
def publish_resolved(spark, sf_dir):
    wanted = targets(spark, sf_dir)
    site = wanted.filter("p_partkey % 2 = 0").select("export", F.when(F.col("p_partkey") % 3 == 0, F.col("slug")).otherwise(F.concat(F.lit("u"), F.col("p_partkey").cast("string"))).alias("url"), "title")
    return B.publish_status(B.resolve_targets(wanted, site, "export")).select("export", "slug", "existing_url", "ambiguous", "status")


@query(_SECTIONS + "SELECT export, slug, row_number() OVER (PARTITION BY export ORDER BY p_size, p_partkey)::INT AS send FROM t WHERE p_partkey % 5 > 0")
def publish_remaining(spark, sf_dir):
    wanted = targets(spark, sf_dir)
    return B.remaining(wanted, wanted.filter("p_partkey % 5 = 0").select("export", "slug"), ["export", "slug"], ["p_size", "p_partkey"], "export").select("export", "slug", "send")


@query(_SECTIONS + "SELECT export, slug, dense_rank() OVER (PARTITION BY export ORDER BY p_size)::INT AS module, row_number() OVER (PARTITION BY export, p_size ORDER BY p_partkey)::INT AS item, 'res-' || slug AS resource FROM t")
def publish_manifest(spark, sf_dir):
    return B.manifest_items(targets(spark, sf_dir), "export", "p_size", "p_partkey").select("export", "slug", "module", "item", "resource")


@query(
    """WITH a AS (SELECT p_brand AS doc, p_partkey AS idx, (p_partkey * 7919 % 500000)::BIGINT * (p_partkey % 9) AS size FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS n FROM a),
r AS (SELECT *, sum(CASE WHEN n <= 64 AND size > 0 AND size <= 4194304 THEN size ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx) AS t FROM n)
SELECT doc, idx, CASE WHEN n > 64 THEN 'too-many' WHEN size <= 0 THEN 'empty' WHEN size > 4194304 THEN 'too-large' WHEN t > 8388608 THEN 'over-total' END AS refused FROM r"""
)
def asset_budgets(spark, sf_dir):
    size = (F.col("p_partkey") * 7919 % 500000).cast("long") * (F.col("p_partkey") % 9)
    assets = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("idx"), size.alias("size"))
    return B.asset_budget(assets, "doc", "idx", "size").select("doc", "idx", "refused")


_ASSETS = "WITH a AS (SELECT p_brand AS doc, p_partkey AS idx, md5(p_type) AS digest, 'media/' || p_name || '.png' AS origin FROM part) "


@query(_ASSETS + "SELECT doc, idx, first_value(origin) OVER (PARTITION BY doc, digest ORDER BY idx) AS named_by, substr(trim(regexp_replace(lower(origin[7:-5]), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) || '-' || substr(digest, 1, 8) || '.png' AS name FROM a")
def asset_names(spark, sf_dir):
    assets = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("idx"), F.md5("p_type").alias("digest"), F.concat(F.lit("media/"), "p_name", F.lit(".png")).alias("origin"))
    return B.dedupe_assets(assets, "doc", "digest", "idx", "origin").select("doc", "idx", "named_by", B.asset_name("origin", "digest", F.lit("png")).alias("name"))


@query("SELECT DISTINCT l_partkey AS name, l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) AS missing FROM lineitem")
def asset_references(spark, sf_dir):
    assets = table(spark, sf_dir, "part").filter("p_size < 40").select(F.col("p_partkey").alias("name"))
    ship, unresolved = B.asset_integrity(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name")), assets)
    return ship.withColumn("missing", F.lit(False)).unionByName(unresolved.withColumn("missing", F.lit(True)))


@query("WITH s AS (SELECT p_partkey, p_size, p_partkey % 3 < 2 AND p_size > 0 AND p_partkey % 200 > 0 AS sized FROM part) SELECT p_partkey, CASE WHEN sized THEN CASE p_partkey % 3 WHEN 0 THEN 'image/png' ELSE 'image/gif' END END AS media_type, CASE WHEN sized THEN p_size END::BIGINT AS width, CASE WHEN sized THEN p_partkey % 200 END::BIGINT AS height FROM s")
def raster_headers(spark, sf_dir):
    """Headers of pictures, some of height 0, which are none."""
    big = lambda c: F.lpad(F.hex(c), 8, "0")
    small = lambda c: F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0"))
    size, key = F.col("p_size").cast("long"), (F.col("p_partkey") % 200).cast("long")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(size), big(key))
    gif = F.concat(F.lit("474946383961"), small(size), small(key))
    content = F.unhex(F.when(F.col("p_partkey") % 3 == 0, png).when(F.col("p_partkey") % 3 == 1, gif).otherwise("00FF"))
    return table(spark, sf_dir, "part").withColumn("r", B.sniff_raster(content)).select("p_partkey", "r.media_type", "r.width", "r.height")


@query("""WITH s AS (SELECT p_partkey, p_partkey % 4 AS k, p_size * 300 + 1 AS w, (p_partkey * 7) % 16383 + 1 AS h FROM part)
SELECT p_partkey, CASE WHEN k < 3 THEN 'image/webp' END AS media_type, CASE WHEN k < 3 THEN w END::BIGINT AS width, CASE WHEN k < 3 THEN h END::BIGINT AS height FROM s""")
def webp_headers(spark, sf_dir):
    """Lossy, lossless and extended files, and one that is cut off, made byte by byte."""
    k, w, h = F.col("p_partkey") % 4, (F.col("p_size") * 300 + 1).cast("long"), ((F.col("p_partkey") * 7) % 16383 + 1).cast("long")
    little = lambda n, width: F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(width)])
    head = lambda chunk, rest: F.concat(F.lit("524946460000000057454250" + chunk + "00000000"), rest)
    lossy = head("56503820", F.concat(F.lit("0000009D012A"), little(w + F.when(F.col("p_size") % 2 == 0, 0x4000).otherwise(0), 2), little(h, 2)))  # a scale stands above the size
    lossless = head("5650384C", F.concat(F.lit("2F"), little((w - 1) + F.shiftleft(h - 1, 14), 4), F.lit("0000000000")))
    extended = head("56503858", F.concat(F.lit("00000000"), little(w - 1, 3), little(h - 1, 3)))
    content = F.unhex(F.when(k == 0, lossy).when(k == 1, lossless).when(k == 2, extended).otherwise(F.substring(extended, 1, 58)))
    return table(spark, sf_dir, "part").withColumn("r", B.sniff_raster(content)).select("p_partkey", "r.media_type", "r.width", "r.height")


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')[1:60], ''), 'page') AS slug FROM part")
def page_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug("p_name").alias("slug"))


def _planned(spark, sf_dir):
    planned = B.propose_pages(blocks(spark, sf_dir), "doc_id")
    return planned.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("block_idx")).alias("blocks"))


@query(_BLOCKS + "SELECT doc_id, page, block_idx AS block FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_idx) AS k FROM planned) WHERE k > 1")
def plan_split_points(spark, sf_dir):
    return H.split_points(_planned(spark, sf_dir), "doc_id")


@query(_BLOCKS + "SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page)::INT AS section FROM (SELECT DISTINCT doc_id, page FROM planned) WHERE page % 3 <> 1")
def plan_confirmed(spark, sf_dir):
    return H.confirm_plan(_planned(spark, sf_dir).withColumn("included", F.col("page") % 3 != 1), "doc_id").select("doc_id", "page", "section")


@query("SELECT p_partkey, 'image/jpeg' AS media_type, p_size::BIGINT AS width, (p_partkey % 200)::BIGINT AS height FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 3 <> 2")
def jpeg_headers(spark, sf_dir):
    two = lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")
    body = F.concat(F.lit("FFD8FFE000044A46FFC0000B08"), two(F.col("p_partkey") % 200), two(F.col("p_size")), F.lit("010000"))
    files = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.when(F.col("p_partkey") % 3 == 2, body).otherwise("0000")).alias("content"))
    return B.jpeg_sizes(files, "p_partkey")


@query(
    """WITH a AS (SELECT p_brand AS doc, p_partkey AS idx, (p_partkey * 7919 % 500000)::BIGINT * (p_partkey % 9) AS size FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS n FROM a),
r AS (SELECT *, sum(CASE WHEN n <= 64 AND size > 0 AND size <= 4194304 THEN size ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx) AS t FROM n),
f AS (SELECT doc, CASE WHEN n > 64 THEN 'too-many' WHEN size <= 0 THEN 'empty' WHEN size > 4194304 THEN 'too-large' WHEN t > 8388608 THEN 'over-total' END AS refused FROM r)
SELECT doc, refused, count(*) AS n FROM f WHERE refused IS NOT NULL GROUP BY 1, 2"""
)
def asset_refusals(spark, sf_dir):
    size = (F.col("p_partkey") * 7919 % 500000).cast("long") * (F.col("p_partkey") % 9)
    assets = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("idx"), size.alias("size"))
    return B.asset_refusals(B.asset_budget(assets, "doc", "idx", "size"), "doc")


@query(
    _BLOCKS + """, e AS (SELECT doc_id, 2 AS target FROM documents WHERE doc_id % 3 < 2), k AS (SELECT doc_id, block_idx::DOUBLE AS place, html FROM lines l WHERE NOT (doc_id % 3 = 1 AND block_idx = 2)
UNION ALL SELECT doc_id, 2.5, '<img src="i">' FROM e WHERE EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = e.doc_id AND l.block_idx = 2)) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS block_idx, md5(html) AS digest FROM k"""
)
def images_inserted(spark, sf_dir):
    lines = blocks(spark, sf_dir).drop("level")
    edits = table(spark, sf_dir, "documents").filter("doc_id % 3 < 2").select("doc_id", F.lit(2).alias("target"), F.lit("i").alias("src"), F.lit('<img src="i">').alias("html"), F.when(F.col("doc_id") % 3 == 1, "replace").otherwise("after").alias("mode"))
    return B.insert_images(lines, edits, "doc_id").select("doc_id", "block_idx", F.md5("html").alias("digest"))


@query("SELECT o_custkey AS chapter_id, l_orderkey AS section_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)::INT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def queue_regrouped(spark, sf_dir):
    queue = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), "l_linenumber", "l_partkey", "l_suppkey")
    sections = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), F.col("o_custkey").alias("chapter_id"))
    return B.regroup(queue, sections, ["section_id", "l_linenumber", "l_partkey", "l_suppkey"]).select("chapter_id", "section_id", "n")
