"""Queries of page parts, folds and exports, on pages and logs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.operators import audits as A
from foliolens.operators import chapters as H
from foliolens.operators import corpora as K
from foliolens.operators import pages as P
from foliolens.operators import queues as Q
from foliolens.operators import sections as S
from foliolens.plans.audits import _IMAGES, _LIN, images
from foliolens.plans.pages import _TOKENS, _tokens
from foliolens.plans.queues import _GRID, _cells
from foliolens.plans.registry import query, table

# Pages made of the lines of an order, one block a line.
_LINES = "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem"


def _order_pages(spark, sf_dir, block):
    # One shuffle by order serves the distinct lines and the pages.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").repartition("l_orderkey").distinct()
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    made = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), block.alias("b")))).alias("all"))
    return P.tokenize(made.select("l_orderkey", F.array_join(F.transform("all", lambda x: x["b"]), "").alias("html")), "l_orderkey")


_BLOCK = """CASE l_linenumber % 4 WHEN 0 THEN '<h3>Part ' || l_partkey || '</h3>' WHEN 1 THEN '<p>Supplier ' || l_suppkey || ' of <b>' || l_returnflag || '</b> &amp; ' || repeat('x', l_suppkey::INT % 80) || '</p>'
  WHEN 2 THEN '<ul data-plan-label="Slide ' || l_partkey || '"><li>a<li>b</ul>' ELSE '<hr>' END"""


@query(f"""WITH b AS (SELECT *, {_BLOCK.replace('</ul>', '</li></ul>').replace('<li>a<li>', '<li>a</li><li>')} AS raw, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1)::INT AS block_idx FROM ({_LINES})),
t AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'Part ' || l_partkey WHEN 1 THEN trim('Supplier ' || l_suppkey || ' of ' || l_returnflag || ' & ' || repeat('x', l_suppkey::INT % 80)) WHEN 2 THEN 'ab' ELSE '' END AS text FROM b)
SELECT l_orderkey, block_idx, CASE l_linenumber % 4 WHEN 0 THEN 3 END::INT AS level, text, CASE l_linenumber % 4 WHEN 0 THEN 'Heading: ' WHEN 1 THEN 'Paragraph: ' ELSE '' END || CASE l_linenumber % 4 WHEN 2 THEN 'Slide ' || l_partkey WHEN 3 THEN 'Rule'
  ELSE CASE WHEN length(text) > 60 THEN rtrim(substr(text, 1, 59)) || '…' ELSE text END END AS summary FROM t""")
def plan_blocks(spark, sf_dir):
    block = F.expr(_BLOCK.replace("::INT", "").replace("l_suppkey % 80", "int(l_suppkey % 80)").replace("</ul>", "</li></ul>").replace("<li>a<li>", "<li>a</li><li>"))
    return S.plan_blocks(_order_pages(spark, sf_dir, block), "l_orderkey", whole=True).select("l_orderkey", "block_idx", "level", "text", "summary")


@query()
def page_section_texts(spark, sf_dir):
    return P.section_text(P.text_blocks(_tokens(spark, sf_dir), "page_id", whole=True), "page_id").withColumn("text", F.md5("text"))


@query(f"""WITH t AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'Line ' || l_partkey ELSE 'a ' || l_suppkey || ' b' END AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n FROM ({_LINES}))
SELECT l_orderkey, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM t WHERE text <> '' GROUP BY 1""")
def section_texts(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    block = F.when(n == 0, F.lit("<p> </p>")).when(n == 1, F.concat(F.lit("<h2>Line\n "), F.col("l_partkey").cast("string"), F.lit("</h2>"))).otherwise(F.concat(F.lit("<blockquote><p>a <i>"), F.col("l_suppkey").cast("string"), F.lit("</i> b</p></blockquote>")))
    return P.section_text(P.text_blocks(_order_pages(spark, sf_dir, block), "l_orderkey", whole=True), "l_orderkey")


@query(_TOKENS + "SELECT page_id, pos, 'link-' || row_number() OVER (PARTITION BY page_id ORDER BY pos) AS element_id FROM tok WHERE kind = 'open' AND tag = 'a'")
def page_element_ids(spark, sf_dir):
    return P.element_ids(_tokens(spark, sf_dir), "page_id", ("a",), "link")


_K = "p_partkey"
_RUN = f"""'<div style="background:' || CASE {_K} % 5 WHEN 0 THEN 'linear-gradient(90deg, #000000, navy ' || p_size || '%)' WHEN 1 THEN 'url(x.png)' WHEN 2 THEN '#ffffff80' ELSE 'rgb(' || ({_K} * 37 % 256) || ', 9, 9)' END || CASE WHEN {_K} % 11 = 0 THEN ';filter: blur(1px)' ELSE '' END
  || '"><p style="color: rgb(' || ({_K} * 59 % 256) || ', ' || ({_K} * 83 % 256) || ', 0);font-size:' || p_size || 'pt' || CASE WHEN {_K} % 7 = 0 THEN ';display:none' ELSE '' END || '">' || p_name || '</p><p> </p></div>'"""


def _runs(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(_K, F.expr(_RUN).alias("html"))
    return S.text_runs(P.tokenize(pages, _K), _K, whole=True)


_RUNS = f"""WITH run AS (SELECT {_K}, 1 AS el, 'rgb(' || ({_K} * 59 % 256) || ', ' || ({_K} * 83 % 256) || ', 0)' AS fg, CASE WHEN {_K} % 5 = 0 THEN 'gradient' WHEN {_K} % 5 = 1 THEN 'image' WHEN {_K} % 11 = 0 THEN 'unresolvable' ELSE 'layers' END AS bg_kind,
  CASE WHEN p_size * 4 / 3.0 >= 24 THEN 'large' ELSE 'normal' END AS size, p_size, ({_K} * 59 % 256)::DOUBLE AS r, ({_K} * 83 % 256)::DOUBLE AS g, ({_K} * 37 % 256)::DOUBLE AS b FROM part WHERE {_K} % 7 > 0) """


@query(_RUNS + f"""SELECT {_K}, el, fg, bg_kind, CASE WHEN bg_kind <> 'layers' THEN '' WHEN {_K} % 5 = 2 THEN '#ffffff80|#ffffff' ELSE 'rgb(' || b::INT || ', 9, 9)' END AS layers, CASE WHEN bg_kind = 'gradient' THEN 'linear-gradient(90deg, #000000, navy ' || p_size || '%)' END AS gradient_css, CASE WHEN bg_kind = 'unresolvable' THEN 'css-filter' END AS reason, size FROM run""")
def text_runs(spark, sf_dir):
    return _runs(spark, sf_dir).withColumn("layers", F.array_join("layers", "|"))


def _lum(r, g, b):
    return f"(0.2126 * {_LIN.format(c=r)} + 0.7152 * {_LIN.format(c=g)} + 0.0722 * {_LIN.format(c=b)})"


@query(_RUNS + f""", s AS (SELECT {_K}, min((greatest(x, y) + 0.05) / (least(x, y) + 0.05)) AS worst FROM (SELECT {_K}, {_lum('r', 'g', '0.0')} AS x, {_lum('0.0', '0.0', 'v')} AS y FROM (SELECT {_K}, r, g, floor(128 * i / 9.0 + 0.5)::DOUBLE AS v FROM run, (SELECT unnest(range(10)) AS i) WHERE bg_kind = 'gradient')) GROUP BY 1),
l AS (SELECT {_K}, (greatest(x, y) + 0.05) / (least(x, y) + 0.05) AS raw FROM (SELECT {_K}, {_lum('r', 'g', '0.0')} AS x, CASE WHEN {_K} % 5 = 2 THEN 1.0 ELSE {_lum('b', '9.0', '9.0')} END AS y FROM run WHERE bg_kind = 'layers'))
SELECT {_K}, CASE WHEN bg_kind = 'gradient' THEN CASE WHEN worst < CASE size WHEN 'large' THEN 3 ELSE 4.5 END THEN 'blocker' END WHEN bg_kind = 'layers' THEN CASE WHEN raw < CASE size WHEN 'large' THEN 3 ELSE 4.5 END THEN 'blocker' END ELSE 'alert' END AS severity
FROM run LEFT JOIN s USING ({_K}) LEFT JOIN l USING ({_K})""")
def text_run_issues(spark, sf_dir):
    return A.contrast_issues(_runs(spark, sf_dir).withColumn("swatches", F.array().cast("array<string>"))).select(_K, "severity")


@query(_IMAGES + """, h AS (SELECT p_partkey, p_size FROM part) SELECT p_partkey, 0 AS check_order, 'heading-order' AS id, 'warning' AS severity, 'structure' AS category FROM h WHERE p_size % 6 + 1 > 2 UNION ALL SELECT p_partkey, 1, issue, severity, CASE WHEN severity = 'error' THEN 'error' ELSE 'alert' END FROM sev WHERE issue IS NOT NULL""")
def audit_in_order(spark, sf_dir):
    """The checks of pages made of parts, each a table of its own, in their fixed order."""
    level = (F.col("p_size") % 6 + 1).cast("string")
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<h1>a</h1><h"), level, F.lit(">b</h"), level, F.lit(">")).alias("html"))
    structure = P.map_issues(P.structural_issues(P.tokenize(pages, "p_partkey"), "p_partkey")).filter("id = 'heading-order'")
    alt = A.alt_quality(images(spark, sf_dir)).filter("issue IS NOT NULL").withColumnRenamed("issue", "id")
    return P.audit({"structure": structure, "alt-text": alt}, "p_partkey")


@query(_GRID + """, t AS (SELECT DISTINCT l_orderkey AS table_id, CASE WHEN l_orderkey % 11 = 0 THEN 'presentation' END AS role, CASE l_orderkey % 4 WHEN 0 THEN 'row' WHEN 1 THEN 'presentation' WHEN 2 THEN 'both' END AS choice FROM lineitem),
f AS (SELECT t, max(CASE WHEN c = 0 THEN cs END) AS fc FROM c GROUP BY t), r AS (SELECT table_id, role, choice, CASE WHEN choice IN ('row', 'both') THEN CASE WHEN g.rowspan THEN 'rowspan' WHEN g.ragged THEN 'ragged' WHEN g.fr > 1 OR choice = 'both' AND fc > 1 THEN 'colspan-in-band' END END AS refused FROM t JOIN g ON g.t = table_id JOIN f ON f.t = table_id),
s AS (SELECT table_id, refused, CASE WHEN role = 'presentation' THEN 'presentational' WHEN choice = 'presentation' THEN 'layout' WHEN choice IN ('row', 'both') AND refused IS NULL THEN 'promoted' ELSE 'queued' END AS status FROM r) SELECT table_id, status, CASE WHEN status = 'queued' THEN refused END AS refused FROM s""")
def queue_table_triage(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    k = F.col("table_id")
    tables = cells.select("table_id").distinct().withColumn("role", F.when(k % 11 == 0, "presentation"))
    answers = tables.select("table_id", F.when(k % 4 == 0, "row").when(k % 4 == 1, "presentation").when(k % 4 == 2, "both").alias("choice")).filter("choice IS NOT NULL")
    return Q.queue_tables(tables, cells, answers).select("table_id", "status", "refused")


_TYPE = "CASE event_type WHEN 'click' THEN 'replace' WHEN 'signup' THEN 'keep' WHEN 'error' THEN 'dismiss' WHEN 'view' THEN 'undo' ELSE 'image' END"


@query(f"""WITH e AS (SELECT user_id || ':' || (event_id % 7) AS key, {_TYPE} AS type, event_id, value FROM events), l AS (SELECT key, arg_max(type, event_id) AS type, arg_max(value, event_id) AS value FROM e GROUP BY key)
SELECT key, type, value FROM l WHERE type IN ('replace', 'keep', 'image') UNION ALL SELECT key, 'dismissed', NULL FROM l WHERE type = 'dismiss'""")
def edits_folded(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", F.col("event_id") % 7).alias("key"), F.expr(_TYPE).alias("type"), "event_id", "value")
    edits, dismissed = Q.fold_edits(log, "key", "event_id")
    return edits.select("key", "type", "value").unionByName(dismissed.select("key", F.lit("dismissed").alias("type"), F.lit(None).cast("double").alias("value")))


_SLOT = "CASE event_type WHEN 'click' THEN 'rate' WHEN 'signup' THEN 'clear-rating' WHEN 'error' THEN 'check' WHEN 'view' THEN 'note' ELSE 'summary' END"


@query(f"""WITH e AS (SELECT user_id AS chapter_id, {_SLOT} AS type, event_id % 3 AS category, event_id // 3 % 5 AS id, event_type || event_id AS value, event_id FROM events),
s AS (SELECT chapter_id, type, value, event_id, CASE WHEN type IN ('rate', 'clear-rating') THEN 'rating' ELSE type END AS slot, CASE WHEN type <> 'summary' THEN category END AS category, CASE WHEN type NOT IN ('note', 'summary') THEN id END AS id FROM e
  WHERE type IN ('note', 'summary') OR type IN ('rate', 'clear-rating') AND id < 4 OR type = 'check' AND id >= 2)
SELECT chapter_id, slot, category, id, arg_max(value, event_id) AS value FROM s GROUP BY ALL HAVING arg_max(type, event_id) <> 'clear-rating'""")
def reviews_folded(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("chapter_id"), F.expr(_SLOT).alias("type"), (F.col("event_id") % 3).alias("category"), F.expr("event_id div 3 % 5").alias("id"), F.concat("event_type", "event_id").alias("value"), "event_id")
    known = log.select("category", "id").distinct()
    return Q.fold_reviews(log, known.filter("id < 4"), known.filter("id >= 2"), "event_id")


@query("""SELECT p_partkey, 'heading' AS kind, p_type AS text, NULL AS detail FROM part UNION ALL SELECT p_partkey, 'glossary', p_brand, CASE WHEN p_size % 2 = 0 THEN p_name END FROM part UNION ALL SELECT p_partkey, 'glossary', 'last', NULL FROM part
UNION ALL SELECT p_partkey, 'defined-term', p_name, NULL FROM part WHERE p_size % 3 > 0 UNION ALL SELECT p_partkey, 'key-block', p_name || ' & ' || p_size, NULL FROM part WHERE p_size < 25 UNION ALL SELECT p_partkey, 'key-block', 'item', NULL FROM part WHERE p_size < 25""")
def metadata_found(spark, sf_dir):
    size, name = F.col("p_size"), F.col("p_name")
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(
        F.lit("<h1>no</h1><h3>"), "p_type", F.lit("</h3><dl><dt>"), "p_brand", F.lit("</dt>"), F.when(size % 2 == 0, F.concat(F.lit("<dd>"), name, F.lit("</dd>"))).otherwise(""), F.lit("<dt>last</dt></dl><p>"), F.when(size % 3 > 0, "").otherwise("so "),
        F.lit("<b>"), name, F.lit('</b> is this</p><div class="x '), F.when(size < 25, "key-takeaways").otherwise("other"), F.lit('"><p>'), name, F.lit(" &amp; "), size.cast("string"), F.lit("</p><ul><li>item</li></ul></div>"),
    ).alias("html"))
    return S.metadata_inventory(P.tokenize(pages, "p_partkey"), "p_partkey").drop("el")


@query("""WITH n AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey::BIGINT AS ord, r_name AS title, 'https://w/r' AS url FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE n_name END, 'https://w/n' || n_nationkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'http://' ELSE 'HTTPS://' END || 'w/s' || s_suppkey FROM supplier),
t AS (SELECT a.node AS chapter, a.node, [a.ord] AS path, a.title, a.url FROM n a WHERE parent IS NULL UNION ALL SELECT a.node, b.node, [a.ord, b.ord], b.title, b.url FROM n a JOIN n b ON b.parent = a.node WHERE a.parent IS NULL
  UNION ALL SELECT a.node, c.node, [a.ord, b.ord, c.ord], c.title, c.url FROM n a JOIN n b ON b.parent = a.node JOIN n c ON c.parent = b.node WHERE a.parent IS NULL)
SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY path)::INT AS n, node, title, url FROM t WHERE trim(title) <> '' AND lower(url) LIKE 'https://%'""")
def page_tree(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda df, node, parent, ord_, title, url: df.select(F.lit(0).alias("book"), node.alias("node"), parent.alias("parent"), F.col(ord_).cast("long").alias("ord"), title.alias("title"), url.alias("url"))
    nodes = row(region, name("r", "r_regionkey"), F.lit(None).cast("string"), "r_regionkey", F.concat(F.lit("<i>"), "r_name", F.lit("</i>")), F.lit("https://w/r"))
    nodes = nodes.unionByName(row(nation, name("n", "n_nationkey"), name("r", "n_regionkey"), "n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise(F.col("n_name")), name("https://w/n", "n_nationkey")))
    nodes = nodes.unionByName(row(supplier, name("s", "s_suppkey"), name("n", "s_nationkey"), "s_suppkey", F.col("s_name"), F.concat(F.when(F.col("s_suppkey") % 3 == 0, "http://").otherwise("HTTPS://"), name("w/s", "s_suppkey"))))
    return K.flatten_page_tree(nodes).drop("book")


@query(r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM pages), b AS (SELECT DISTINCT host FROM h WHERE host LIKE 'blog.%')
SELECT page_id, host, CASE WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'org press' WHEN host = (SELECT min(host) FROM h) THEN 'first' WHEN host IN (SELECT host FROM b) THEN 'network' END AS publisher FROM h""")
def publishers_of_hosts(spark, sf_dir):
    from foliolens.functions import text as T

    pages = table(spark, sf_dir, "pages").select("page_id", T.host_of("url").alias("host"))
    first = pages.agg(F.min("host")).first()[0]
    networks = pages.filter(F.col("host").startswith("blog.")).select(F.upper("host").alias("host"), F.lit("network").alias("publisher")).distinct()
    return K.publisher_for_host(pages, "host", {"example.org": "org press"}, {first: "first"}, networks)


@query("""WITH a AS (SELECT o_custkey AS book, o_orderstatus AS area, count(*) AS n FROM orders GROUP BY 1, 2), x AS (SELECT book, string_agg('| ' || area || ' | ' || CASE WHEN n > 3 THEN 'often' ELSE 'no draft' END || ' | a\\|b ' || n || ' |', chr(10) ORDER BY area) AS t FROM a GROUP BY 1),
r AS (SELECT o_custkey AS book, string_agg('| ' || o_orderpriority || ' | order ' || o_orderkey || ' | why |', chr(10) ORDER BY o_orderkey) AS t FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT book, '## Areas' || chr(10) || chr(10) || '| Area | Rating | Notes |' || chr(10) || '| --- | --- | --- |' || chr(10) || x.t || chr(10) || chr(10) || '## Revisions' || chr(10) || chr(10) || coalesce('| Where | Revision | Rationale |' || chr(10) || '| --- | --- | --- |' || chr(10) || r.t, 'None.') AS markdown FROM x LEFT JOIN r USING (book)""")
def patterns_exported(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    areas = orders.groupBy(F.col("o_custkey").alias("book"), F.col("o_orderstatus").alias("area")).agg(F.count(F.lit(1)).alias("n"))
    areas = areas.select("book", "area", F.when(F.col("n") > 3, "often").alias("rating"), F.concat(F.lit("a|b\n"), F.col("n").cast("string")).alias("notes"))
    revisions = orders.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("where"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("revision"), F.lit("why").alias("rationale"))
    return H.export_patterns(areas, revisions)


@query("""SELECT o_custkey AS chapter_id, '| Priority | Where | Issue | Revision |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || (o_orderkey % 3 + 1) || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' | r' || o_orderkey || ' |', chr(10) ORDER BY o_orderkey % 3, o_orderkey) AS markdown FROM orders GROUP BY 1""")
def plans_exported(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter_id"), (F.col("o_orderkey") % 3 + 1).alias("priority"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("where"), F.col("o_orderpriority").alias("issue"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("revision"))
    return H.export_plan(plan)


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' ![Figure on page ' || p_size || '](a/' || p_partkey || ') and ![Figure on page ' || p_size || '](image) end' ELSE p_name || ' ![kept](image)' END AS markdown FROM part""")
def pages_captioned(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" ![Image: Im1](image) and ![Image: Im2](image) end"))).otherwise(F.concat("p_name", F.lit(" ![kept](image)")))
    references = F.array(F.concat(F.lit("a/"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", S.page_captions(text, "p_size", references).alias("markdown"))


@query("""SELECT p_partkey, '<div class="page-frame"><h2 class="page-title"><strong>' || CASE WHEN p_size % 2 = 0 THEN 'Own <i>' || p_name || '</i>' ELSE p_type || ' &amp; more' END || '</strong></h2><div class="page-body"><p>before</p><p>' || p_brand || '</p></div><div class="page-footer"><p>Continue to the next page.</p></div></div>' AS html FROM part""")
def pages_assembled(spark, sf_dir):
    own = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('<h2 id="x">Own <i>'), "p_name", F.lit("</i></h2>"))).otherwise("")
    html = F.concat(F.lit("<p>before</p>"), own, F.lit("<p>"), "p_brand", F.lit("</p>"))
    once = table(spark, sf_dir, "part").select("p_partkey", "p_type", S.assemble_page(html, F.concat("p_type", F.lit(" & more"))).alias("html"))
    return once.select("p_partkey", S.assemble_page("html", "p_type").alias("html"))  # the second time nothing changes


@query("SELECT p_partkey, (p_size % 3 + 1)::INT AS n, CASE WHEN p_size % 2 = 0 THEN 'see ' || p_name END AS caption FROM part UNION ALL SELECT p_partkey, k::INT, 'first' FROM part, (SELECT unnest([1, 2]) AS k) WHERE k < p_size % 3 + 1")
def figures_captioned(spark, sf_dir):
    first = F.repeat(F.lit("<figure><img><figcaption>first</figcaption></figure>"), F.col("p_size") % 3)
    last = F.concat(F.lit("<figure>"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<figcaption>see <b>"), "p_name", F.lit("</b></figcaption>"))).otherwise(""), F.lit("<p>x</p></figure>"))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(first, last).alias("html"))
    return H.figure_captions(P.tokenize(pages, "p_partkey"), "p_partkey").drop("el")


@query("""WITH p AS (SELECT p_partkey, 'https://h.example/b' || (p_size % 3) AS root, p_size AS s, p_type AS t FROM part), l AS (SELECT p_partkey, root, unnest([root, root || '/' || s, CASE WHEN s % 2 = 0 THEN root || '/' || t END, CASE WHEN s % 2 = 1 THEN root || '/up/' || s END]) AS url FROM p)
SELECT DISTINCT p_partkey, root, url FROM l WHERE url IS NOT NULL""")
def links_inside(spark, sf_dir):
    """Links of made pages below their book's root: relative, absolute, repeated with a query or fragment, beside the root, and elsewhere."""
    part = table(spark, sf_dir, "part")
    size, root = F.col("p_size").cast("string"), F.concat(F.lit("https://h.example/b"), (F.col("p_size") % 3).cast("string"))
    link = lambda *c: F.concat(F.lit('<a href="'), *c, F.lit('">x</a>'))
    other = F.when(F.col("p_size") % 2 == 0, F.concat(root, F.lit("/"), "p_type", F.lit("/?a"))).otherwise(F.concat(F.lit("../up/"), size))
    html = F.concat(link(root, F.lit("/#top")), link(size, F.lit("?q=1")), link(size), link(root, F.lit("x/y")), link(F.lit("https://other.example/b0/z")), link(F.lit("mailto:a@b.c")), link(other))
    base = F.concat(root, F.when(F.col("p_size") % 2 == 0, "/").otherwise("/in/"))
    # Odd sizes stand one folder deeper, so a plain number there leads to that folder.
    made = F.when(F.col("p_size") % 2 == 0, html).otherwise(F.regexp_replace(html, '"([0-9]+)', '"../$1'))
    pages = part.select("p_partkey", root.alias("root"), base.alias("base"), made.alias("html"))
    links = P.links(P.tokenize(pages, "p_partkey", carry=("root", "base")), "p_partkey", ("root", "base"))
    return K.child_links(links.withColumn("href", P.absolutize("href", "base")), "root", "p_partkey")


@query("SELECT n_nationkey, coalesce(nullif(trim(CASE WHEN n_nationkey % 3 = 0 THEN ' ' ELSE n_name END), ''), 'Untitled course') AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def courses_authorable(spark, sf_dir):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "teacher").when(F.col("c_mktsegment") == "MACHINERY", "designer").otherwise("student")
    enrolled = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set(F.struct(role.alias("type"))).alias("enrollments"))
    courses = table(spark, sf_dir, "nation").join(enrolled, "n_nationkey").withColumn("name", F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.col("n_name")))
    return H.authorable(courses).select("n_nationkey", "name")


@query("SELECT p_partkey, p_size % 2 = 0 OR regexp_matches(p_name || CASE WHEN p_size % 5 = 0 THEN ' (1999)' WHEN p_size % 5 = 1 THEN ' et al. said' ELSE ' 1999' END, '\\(\\d{4}[a-z]?\\)|\\bv\\.\\s|\\bet al\\.|\\[\\d+\\]') AS quoted FROM part")
def phrases_quoted(spark, sf_dir):
    path = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("div"), F.lit("blockquote"))).otherwise(F.array(F.lit("p")))
    text = F.concat("p_name", F.when(F.col("p_size") % 5 == 0, " (1999)").when(F.col("p_size") % 5 == 1, " et al. said").otherwise(" 1999"))
    return table(spark, sf_dir, "part").select("p_partkey", H.in_quotation(path, text).alias("quoted"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN md5(p_name) || substr(md5(p_type), 1, 8) END AS hash FROM part")
def image_hashes(spark, sf_dir):
    digits = F.concat(F.md5("p_name"), F.substring(F.md5("p_type"), 1, 8))
    src = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://h/img/"), digits, F.when(F.col("p_size") % 4 == 0, "?w=3").otherwise(""))).otherwise(F.concat(F.lit("https://h/"), digits, F.lit("/x.png")))
    return table(spark, sf_dir, "part").select("p_partkey", Q.url_hash(src).alias("hash"))

