"""Queries of catalogs, outlines, edits, reviews and sending, on rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolens.operators import audits as A
from foliolens.operators import chapters as H
from foliolens.operators import corpora as K
from foliolens.operators import decks as D
from foliolens.operators import pages as P
from foliolens.operators import publishing as B
from foliolens.operators import sections as S
from foliolens.plans.registry import dealt, query, table
from foliolens.plans.sections import _K, _RUN, _RUNS, _lum, _runs


def name(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@query("""WITH n AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey::BIGINT AS ord, CASE r_regionkey % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'chapter' END AS type, r_name AS title FROM region
  UNION ALL SELECT 'n' || n_nationkey || '@2', 'r' || n_regionkey, n_nationkey, NULL, CASE WHEN n_nationkey % 7 = 3 THEN 'Glossary' ELSE n_name END FROM nation UNION ALL SELECT 's' || s_suppkey || '@7', 'n' || s_nationkey || '@2', s_suppkey, NULL, s_name FROM supplier),
m AS (SELECT *, node IN (SELECT parent FROM n WHERE parent IS NOT NULL) AS inn FROM n), a AS (SELECT parent AS node, bool_and(inn) AS every FROM m WHERE parent IS NOT NULL GROUP BY 1),
g AS (SELECT m.*, every FROM m LEFT JOIN a USING (node) WHERE inn AND lower(title) NOT IN ('answer key', 'index', 'glossary')), t AS (SELECT *, coalesce(type = 'unit', false) OR (coalesce(type NOT IN ('unit', 'chapter'), true) AND every) AS holds FROM g WHERE parent IS NULL),
c AS (SELECT node, title FROM t WHERE NOT holds UNION ALL SELECT g.node, g.title FROM g JOIN t ON g.parent = t.node WHERE holds),
l AS (SELECT c.node AS chapter, c.title, [x.ord] AS path, x.node, x.title AS section FROM c JOIN m x ON x.parent = c.node WHERE NOT x.inn UNION ALL SELECT c.node, c.title, [x.ord, y.ord], y.node, y.title FROM c JOIN m x ON x.parent = c.node JOIN m y ON y.parent = x.node WHERE NOT y.inn)
SELECT split_part(chapter, '@', 1) AS chapter, title, row_number() OVER (PARTITION BY chapter ORDER BY path)::INT AS n, split_part(node, '@', 1) AS node, section FROM l""")
def books_outlined(spark, sf_dir):
    none = F.lit(None).cast("string")
    row = lambda df, node, parent, ord_, type_, title: df.select(F.lit("b").alias("book"), node.alias("node"), parent.alias("parent"), F.col(ord_).cast("long").alias("ord"), type_.alias("type"), title.alias("title"))
    kind = F.when(F.col("r_regionkey") % 3 == 0, "unit").when(F.col("r_regionkey") % 3 == 1, "chapter")
    nodes = row(table(spark, sf_dir, "region"), name("r", "r_regionkey"), none, "r_regionkey", kind, F.concat(F.lit("<span>"), "r_name", F.lit("</span>\n")))
    nodes = nodes.unionByName(row(table(spark, sf_dir, "nation"), F.concat(name("n", "n_nationkey"), F.lit("@2")), name("r", "n_regionkey"), "n_nationkey", none, F.when(F.col("n_nationkey") % 7 == 3, "<b>Glossary</b>").otherwise(F.col("n_name"))))
    nodes = nodes.unionByName(row(table(spark, sf_dir, "supplier"), F.concat(name("s", "s_suppkey"), F.lit("@7")), F.concat(name("n", "s_nationkey"), F.lit("@2")), "s_suppkey", none, F.col("s_name")))
    return K.flatten_toc(nodes).drop("book")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), l AS (SELECT l_orderkey AS page, CASE WHEN l_orderkey % 5 > 0 THEN l_linenumber % 3 END AS item, l_partkey % 2 = 1 AS nested, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos,
  'https://h.example/' || (l_partkey % 7) || CASE WHEN l_suppkey % 5 = 0 THEN '.pdf' ELSE '' END AS url, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'T' || l_partkey END AS text FROM d),
g AS (SELECT * FROM l WHERE text <> '' AND url NOT LIKE '%.pdf'), w AS (SELECT *, coalesce(item, -1) AS chapter, bool_or(nested) OVER (PARTITION BY page, item) AS deep, arg_min(text, pos) FILTER (NOT nested AND item IS NOT NULL) OVER (PARTITION BY page, item) AS title FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY page, chapter, url ORDER BY pos) AS k FROM w WHERE item IS NULL OR nested = deep), o AS (SELECT *, row_number() OVER (PARTITION BY page, chapter ORDER BY pos)::INT AS n, first_value(text) OVER (PARTITION BY page, chapter ORDER BY pos) AS head FROM k WHERE k = 1)
SELECT page, chapter::INT AS chapter, CASE WHEN item IS NOT NULL THEN coalesce(title, head) END AS title, n, url, text FROM o WHERE deep OR item IS NULL OR n = 1""")
def toc_of_items(spark, sf_dir):
    # One shuffle by page serves the distinct lines and all windows.
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey").distinct()
    links = lines.select(
        F.col("l_orderkey").alias("page"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_linenumber") % 3).alias("item"), (F.col("l_partkey") % 2 == 1).alias("nested"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("pos"),
        F.concat(F.lit("https://h.example/"), (F.col("l_partkey") % 7).cast("string"), F.when(F.col("l_suppkey") % 5 == 0, ".pdf").otherwise(""), F.lit("?q")).alias("href"), F.when(F.col("l_suppkey") % 7 == 0, " ").otherwise(name("T", "l_partkey")).alias("text"),
    )
    return K.toc_from_items(links, "page")


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN upper(p_name[1]) || substr(p_name, 2) ELSE p_name END AS w, split_part(p_name, ' ', 2) AS noun, p_brand, p_size FROM part), q AS (SELECT *, split_part(w, ' ', 1) AS a, split_part(w, ' ', 2) AS b FROM p)
SELECT p_partkey, a || ' ' || b || ' ' || CASE p_size % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'New' ELSE 'new' END || ' ' || b || ' END' || CASE WHEN p_size % 2 = 0 THEN ' (' || p_brand || ')' ELSE '' END AS edited, (1 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END)::INT AS applied, 1::INT AS stale FROM q""")
def blocks_edited(spark, sf_dir):
    title = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 100))).otherwise(F.col("p_name"))
    part = table(spark, sf_dir, "part").withColumn("w", title)
    blocks = part.select("p_partkey", F.concat("w", F.lit(" "), "w", F.lit(" END")).alias("text"))
    none = F.lit(None).cast("string")
    edit = lambda df, ord_, original, occurrence, kind, replacement, context: df.select("p_partkey", F.lit(ord_).alias("ord"), original.alias("original"), F.lit(occurrence).alias("occurrence"), F.lit(kind).alias("kind"), replacement.alias("replacement"), context.alias("context"))
    edits = edit(part, 0, F.split("w", " ")[0], 1, "replace", F.lit("new"), none).unionByName(edit(part, 2, F.lit("absent"), 0, "replace", F.lit("x"), none))
    edits = edits.unionByName(edit(part, 1, F.lit("END"), 0, "keep", none, F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))))
    return K.apply_edits(blocks, edits, ["p_partkey"]).select("p_partkey", "edited", "applied", "stale")


_INKED = _RUNS + f""", l AS (SELECT {_K}, size, {_lum('r', 'g', '0.0')} AS x, CASE WHEN {_K} % 5 = 2 THEN 1.0 ELSE {_lum('b', '9.0', '9.0')} END AS y, {_lum('45.0', '59.0', '69.0')} AS d FROM run WHERE bg_kind = 'layers'),
i AS (SELECT {_K}, CASE WHEN (greatest(x, y) + 0.05) / (least(x, y) + 0.05) < CASE size WHEN 'large' THEN 3 ELSE 4.5 END THEN CASE WHEN (greatest(d, y) + 0.05) / (least(d, y) + 0.05) >= 1.05 / (y + 0.05) THEN '#2d3b45' ELSE '#ffffff' END END AS ink FROM l) """


@query(_INKED + f"SELECT {_K}, ink FROM run LEFT JOIN i USING ({_K})")
def inks_chosen(spark, sf_dir):
    return A.normalize_contrast(_runs(spark, sf_dir)).select(_K, "ink")


@query(_INKED + f", s AS (SELECT {_K}, {_RUN} AS html FROM part) SELECT {_K}, CASE WHEN ink IS NULL THEN NULL ELSE 'font-size:' || p_size || 'pt' || CASE WHEN {_K} % 7 = 0 THEN ';display:none' ELSE '' END || '; color: ' || ink END AS style FROM part LEFT JOIN i USING ({_K})")
def styles_recolored(spark, sf_dir):
    tokens = P.tokenize(table(spark, sf_dir, "part").select(_K, F.expr(_RUN).alias("html")), _K)
    style = F.get(F.filter("attrs", lambda a: a["name"] == "style"), 0)["value"]
    first = S.recolored(tokens, _K, whole=True).filter("kind = 'open' AND tag = 'p'").groupBy(_K).agg(F.max(F.when(style.contains("; color: "), style)).alias("style"))
    return first


@query("""WITH r AS (SELECT p_partkey, p_name, p_size % 4 AS k, CASE p_size % 5 WHEN 0 THEN 'na' WHEN 1 THEN 'exclusive' WHEN 2 THEN 'emerging' WHEN 3 THEN 'inclusive' END AS v FROM part)
SELECT p_partkey, '7.1' AS area, x.row_id, CASE WHEN k = 0 AND x.row_id = '7.1.a' THEN v WHEN k = 0 AND x.row_id = '7.1.c' THEN 'na' END AS rating, p_name AS notes FROM r, (VALUES ('7.1.a'), ('7.1.b'), ('7.1.c')) x(row_id) WHERE k IN (0, 2)
UNION ALL SELECT p_partkey, '7.2', '7.2.a', v, p_name FROM r WHERE k = 1""")
def rubric_drafts_read(spark, sf_dir):
    k, size = F.col("p_size") % 4, F.col("p_size") % 5
    value = F.when(size == 0, "N/A").when(size == 1, " exclusive").when(size == 2, "Emerging Inclusive").when(size == 3, "INCLUSIVE").otherwise("great")
    rows = F.when(k == 0, F.array(F.struct(F.lit("A (Photos of People)").alias("row"), value.alias("rating")), F.struct(F.lit("7.1.c").alias("row"), F.lit("not applicable").alias("rating")), F.struct(F.lit("ab").alias("row"), value.alias("rating"))))
    area = F.when(k == 0, "7.1 Images").when(k == 1, "7.2: Names").when(k == 2, "7.1").otherwise("nine")
    reply = F.to_json(F.struct(F.array(F.struct(area.alias("area"), F.when(k > 0, value).alias("rating"), F.col("p_name").alias("notes"), rows.alias("rows"))).alias("areas")))
    dimension = spark.createDataFrame([("7.1", "7.1.a"), ("7.1", "7.1.b"), ("7.1", "7.1.c"), ("7.2", "7.2.a")], "area string, row_id string")
    return H.rubric_drafts(table(spark, sf_dir, "part").select("p_partkey", reply.alias("reply")), dimension, "p_partkey")


@query("SELECT o_custkey AS chapter, count(*) FILTER (o_orderkey % 5 > 0 AND o_orderkey % 3 = 0) AS new, count(*) FILTER (o_orderkey % 5 > 0 AND o_orderkey % 3 = 1) AS overwrite, count(*) FILTER (o_orderkey % 5 > 0 AND o_orderkey % 3 = 2) AS unknown, count(*) FILTER (o_orderkey % 5 = 0) AS failed FROM orders GROUP BY 1")
def publish_groups(spark, sf_dir):
    k = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter"), F.when(k % 3 == 0, "new").when(k % 3 == 1, "overwrite").otherwise("unknown").alias("status"), F.when(k % 5 == 0, "x").alias("error"))
    return H.publish_groups(pages)


@query("SELECT user_id, count(*) FILTER (event_type NOT IN ('error', 'view')) AS landed, arg_min(event_id, event_id) FILTER (event_type IN ('error', 'view')) AS slug, arg_min(CASE event_type WHEN 'error' THEN 'refused' ELSE 'offline' END, event_id) FILTER (event_type IN ('error', 'view')) AS stopped_by FROM events GROUP BY 1")
def sending_stopped(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("slug"), F.when(F.col("event_type") == "error", "refused").when(F.col("event_type") == "view", "offline").otherwise("landed").alias("outcome"))
    return B.stopped_by(log, "user_id", "event_id")


@query("SELECT event_id % 8 AS category, user_id AS section_id, count(*) AS n, min(props) AS message FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def finder_failures(spark, sf_dir):
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").select((F.col("event_id") % 8).alias("category"), F.col("user_id").alias("section_id"), F.col("props").alias("message"))
    return D.failures_by_category(failed)


@query("SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'CC BY' WHEN 1 THEN 'CC BY-NC-SA' ELSE c_mktsegment END AS license, c_name || '|' || c_mktsegment AS authors FROM customer")
def commons_books(spark, sf_dir):
    code = F.when(F.col("c_nationkey") % 3 == 0, "ccby").when(F.col("c_nationkey") % 3 == 1, "ccbyncsa").otherwise(F.col("c_mktsegment"))
    raw = table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"), F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, " and ").otherwise("; "), "c_mktsegment").alias("authors"))
    return H.commons_catalog(raw, least=100).select("c_custkey", "license", F.array_join("authors", "|").alias("authors"))


@query("SELECT c_nationkey AS network, count(*) AS books, string_agg(DISTINCT a, ',' ORDER BY a) AS authors FROM (SELECT c_nationkey, unnest([c_mktsegment, 'Editor ' || c_nationkey]) AS a, c_custkey FROM customer WHERE c_custkey % 6 > 0) GROUP BY 1")
def networks_counted(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    authors = F.array(F.array(F.col("c_mktsegment"), F.lit(" ")), F.array(F.concat(F.lit(" Editor  "), F.col("c_nationkey").cast("string"))))
    raw = c.select(F.col("c_nationkey").alias("network"), F.when(F.col("c_custkey") % 6 > 0, F.col("c_name")).alias("link"), F.col("c_name").alias("title"), authors.alias("authors"))
    catalog = H.catalog_by_network(raw)
    people = catalog.select("network", F.explode("authors").alias("a")).groupBy("network").agg(F.array_join(F.array_sort(F.collect_set("a")), ",").alias("authors"))
    return H.network_counts(catalog.select("network", F.explode("authors").alias("a"))).join(people, "network")


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN 'v' || p_size END AS version, CASE WHEN p_size <= 10 THEN 'unknown-book' WHEN p_size > 40 THEN 'retired' END AS error FROM part")
def releases_found(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("book", name("b", "p_partkey"))
    versions = part.filter("p_size > 10").select("book", name("v", "p_size").alias("version"), (F.col("p_size") > 40).alias("retired"))
    return H.wanted_versions(part.select("p_partkey", "book"), versions).select("p_partkey", "version", "error")


@query("SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem WHERE l_orderkey % 9 = 0 UNION SELECT doc, page FROM (SELECT l_orderkey AS doc, l_linenumber AS page, max(l_partkey % 60) AS t, min(l_partkey % 60) AS u FROM lineitem GROUP BY 1, 2) WHERE u = 0 AND t < 40")
def ocr_of_scans(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 60).alias("text_length"))
    kinds = lines.select("doc", F.when(F.col("doc") % 9 == 0, "scanned").otherwise("text").alias("kind")).distinct()
    return H.ocr_pages(lines.limit(0), lines, "doc", kinds=kinds)


@query("SELECT sum(b.v - a.v)::BIGINT AS p_size, count(*) FILTER (a.k IS NULL) AS missing_left, count(*) FILTER (b.k IS NULL) AS missing_right FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 5 > 0) a FULL JOIN (SELECT p_partkey AS k, p_size * 2 AS v FROM part WHERE p_partkey % 7 > 0) b ON a.k = b.k")
def runs_totalled(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return K.run_totals(part.filter("p_partkey % 5 > 0"), part.filter("p_partkey % 7 > 0").withColumn("p_size", F.col("p_size") * 2), "p_partkey", ["p_size"])


@query("SELECT p_brand, p_size % 3 AS variant, CASE WHEN bool_and(p_partkey % 17 > 0) THEN 'pass' ELSE 'fail' END AS verdict, arg_min(p_name, p_partkey) FILTER (p_partkey % 17 = 0) AS reason FROM part GROUP BY 1, 2")
def evidence_reasons(spark, sf_dir):
    seen = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 3).alias("variant"), (F.col("p_partkey") % 17 > 0).alias("ok"), "p_partkey", "p_name")
    return K.evidence_reasons(seen, "p_brand", "variant", "ok", "p_partkey", "p_name")


@query("""WITH r AS (SELECT l_partkey AS item, (l_quantity * 2.1)::DOUBLE AS coverage, l_suppkey % 97 = 0 AS unsafe FROM lineitem), k AS (SELECT p_partkey AS item FROM part WHERE p_size < 45), v AS (SELECT * FROM r WHERE item IN (SELECT item FROM k))
SELECT count(*) AS reviewed, (SELECT count(*) FROM k) AS expected, (SELECT count(*) FROM k) - count(DISTINCT item) AS missing, count(*) - count(DISTINCT item) AS duplicate, count(*) FILTER (coverage NOT BETWEEN 0 AND 100) AS invalid, count(*) FILTER (unsafe) AS unsafe, round(avg(coverage), 1) AS mean_coverage,
  (SELECT count(*) FROM r) = (SELECT count(*) FROM k) AND count(DISTINCT item) = (SELECT count(*) FROM k) AND count(*) = count(DISTINCT item) AND count(*) FILTER (coverage NOT BETWEEN 0 AND 100 OR unsafe) = 0 AND avg(coverage) >= 90 AS passed FROM v""")
def reviews_judged(spark, sf_dir):
    ratings = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_quantity") * 2.1).alias("coverage"), (F.col("l_suppkey") % 97 == 0).alias("unsafe"))
    return H.review_verdict(ratings, table(spark, sf_dir, "part").filter("p_size < 45").select(F.col("p_partkey").alias("item")))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '7.1' ELSE coalesce(CASE WHEN p_size % 3 = 0 THEN '7.' || (p_size % 8 + 1) END, CASE WHEN p_type LIKE 'S%' THEN '7.5' END, '7.6') END AS category FROM part")
def edit_categories(spark, sf_dir):
    own = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("7."), (F.col("p_size") % 8 + 1).cast("string")))
    lexicon = F.when(F.col("p_type").startswith("S"), "7.5")
    return table(spark, sf_dir, "part").select("p_partkey", H.edit_category(F.when(F.col("p_size") % 4 == 0, "image").otherwise("replace"), own, lexicon).alias("category"))


@query("SELECT conv_id, turn AS draft, CASE WHEN turn % 5 IN (3, 4) OR length(text) < 2 THEN 'observation' ELSE 'edit' END AS kind FROM conversations")
def drafts_by_category(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    blocks = c.select("conv_id", F.col("turn").alias("block_idx"), "text")
    category = F.when(F.col("turn") % 5 == 3, "7.3").when(F.col("turn") % 5 == 4, "7.7.1").otherwise("7.6")
    drafts = c.select("conv_id", F.col("turn").alias("draft"), F.substring("text", 2, 12).alias("quote"), category.alias("category"))
    return K.ground_drafts(drafts, blocks, "conv_id").select("conv_id", "draft", "kind")


@query("SELECT page_id::VARCHAR AS section_id, url AS canonical_url, regexp_replace(url, '[^/]*$', '') AS content_base_url, md5(html) AS digest FROM pages")
def sections_read(spark, sf_dir):
    from foliolens.sources import files

    return files.read_pages(spark, f"{sf_dir}/pages.parquet").select("section_id", "canonical_url", "content_base_url", F.md5("html").alias("digest"))


@query("""WITH s AS (SELECT o_custkey AS chapter_id, o_orderkey, '## ' || o_orderpriority || chr(10) || 'order ' || o_orderkey || chr(10) || chr(10) || 'Images: ' || coalesce(i, '(none)') AS body FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg('alt="' || coalesce(CASE WHEN l_suppkey % 3 > 0 THEN 'p' || l_partkey END, '(none)') || '" caption="' || CASE WHEN l_partkey % 2 = 0 THEN l_returnflag ELSE '' END || '"', ' | ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem) GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT chapter_id, md5(string_agg(body, chr(10) || chr(10) ORDER BY o_orderkey)) AS body FROM s GROUP BY 1""")
def prompt_bodies(spark, sf_dir):
    sections = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter_id"), F.col("o_orderkey").alias("section_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("title"), name("order ", "o_orderkey").alias("text"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    images = lines.select(F.col("l_orderkey").alias("section_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.when(F.col("l_suppkey") % 3 > 0, name("p", "l_partkey")).alias("alt"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).alias("caption"))
    return H.section_bodies(sections, images).withColumn("body", F.md5("body"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'none' END AS role, p_size % 4 = 0 AS nested, p_size % 2 = 0 OR p_size % 4 = 0 AS has_th, (2 + p_size % 5 + CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS rows FROM part")
def tables_described(spark, sf_dir):
    size = F.col("p_size")
    inner = F.when(size % 4 == 0, "<table><tr><th>i</th></tr></table>").otherwise("")
    rows = F.concat(F.lit("<tr><td>a"), inner, F.lit("</td></tr><tr>"), F.when(size % 2 == 0, "<th>h</th>").otherwise("<td>h</td>"), F.lit("</tr>"), F.repeat(F.lit("<tr><td>r</td></tr>"), size % 5))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<div><table"), F.when(size % 3 == 0, ' role="none"').otherwise(""), F.lit(">"), rows, F.lit("</table></div>")).alias("html"))
    return S.table_facts(P.tokenize(pages, "p_partkey"), "p_partkey").drop("el")


@query("""WITH v AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '$IMS-CC-FILEBASE$/packaged/' || p_partkey || '.png' WHEN 1 THEN ' $IMS-CC-FILEBASE$/packaged/' || p_partkey || '.png' WHEN 2 THEN '$IMS-CC-FILEBASE$/other/' || p_partkey || '.png' WHEN 3 THEN '$IMS-CC-FILEBASE$/packaged/a..b.gif' ELSE 'packaged/' || p_partkey || '.png' END AS src, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 4) THEN '<img src="' || src || '">' ELSE '<img>' END || CASE WHEN p_size % 5 = 4 THEN '<audio src="' || src || '">' ELSE '<audio>' END AS html FROM v""")
def packaged_addresses(spark, sf_dir):
    k, base = name("", "p_partkey"), "$IMS-CC-FILEBASE$/"
    n = F.col("p_size") % 5
    src = F.when(n == 0, F.concat(F.lit(base + "packaged/"), k, F.lit(".png"))).when(n == 1, F.concat(F.lit(" " + base + "packaged/"), k, F.lit(".png"))).when(n == 2, F.concat(F.lit(base + "other/"), k, F.lit(".png"))).when(n == 3, F.lit(base + "packaged/a..b.gif")).otherwise(F.concat(F.lit("packaged/"), k, F.lit(".png")))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('<img src="'), src, F.lit('"><audio src="'), src, F.lit('">')).alias("html"))
    return P.sanitize(P.tokenize(pages, "p_partkey"), "p_partkey")


@query("SELECT p_partkey, replace(p_name, ' ', '-') || '-ueoessa-' || p_size || '-' || substr(md5(p_name), 1, 8) || '.png' AS name FROM part")
def asset_names_folded(spark, sf_dir):
    origin = F.concat(F.lit("word/media\\"), F.upper("p_name"), F.lit(" Üéœßà_"), F.col("p_size").cast("string"), F.lit(".x.PNG"))
    return table(spark, sf_dir, "part").select("p_partkey", B.asset_name(F.regexp_replace(origin, r"\.x", ""), F.md5("p_name"), F.lit("png")).alias("name"))
