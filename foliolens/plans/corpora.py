"""Queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import corpora as K
from foliolens.operators import pages as P
from foliolens.plans.pages import _TOKENS
from foliolens.plans.registry import query, table


@query("SELECT doc_id, 'document-' || substr(sha256(text), 1, 24) AS work_id, 'document-' || substr(sha256(text), 1, 24) || '-page-1' AS section_id, octet_length(encode(text))::INT AS n FROM documents WHERE octet_length(encode(text)) <= 2097152 AND trim(text) <> ''")
def text_works(spark, sf_dir):
    works, _ = K.ingest_text(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content")))
    return works.select("doc_id", "work_id", "section_id", F.octet_length("content").alias("n"))


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN repeat(' ', p_size) WHEN p_size < 20 THEN p_name ELSE repeat(p_name || '.', 60000) END AS t, p_size BETWEEN 10 AND 14 AS broken FROM part)
SELECT p_partkey, CASE WHEN octet_length(encode(t)) > 2097152 THEN 'too-large' WHEN broken THEN 'not-utf8' ELSE 'blank' END AS reason FROM f WHERE octet_length(encode(t)) > 2097152 OR broken OR trim(t) = ''""")
def text_rejects(spark, sf_dir):
    size = F.col("p_size")
    text = F.when(size < 10, F.repeat(F.lit(" "), size)).when(size < 20, F.col("p_name")).otherwise(F.repeat(F.concat("p_name", F.lit(".")), F.when(size >= 20, 60000).otherwise(1)))
    content = F.when(size.between(10, 14), F.concat(F.unhex(F.lit("FF")), F.col("p_name").cast("binary"))).otherwise(text.cast("binary"))
    return K.ingest_text(table(spark, sf_dir, "part").select("p_partkey", content.alias("content")))[1].select("p_partkey", "reason")


@query("""WITH p AS (SELECT doc_id, i, trim(x, ' ') AS x FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM (SELECT doc_id, regexp_split_to_array(replace(text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || ' ' || chr(10) || source ELSE '' END, chr(13) || chr(10), chr(10)), '\\n[ \\t]*\\n+') AS s FROM documents)) WHERE trim(x, ' ') <> '')
SELECT doc_id, md5(string_agg('<p>' || replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</p>', '' ORDER BY i)) AS digest FROM p GROUP BY doc_id""")
def text_paragraphs(spark, sf_dir):
    """Whole documents, every third with its source as a paragraph of its own. What the SQL's order leaves open follows the table's rows, as it does there."""
    whole = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n \n"), "source")).otherwise(""))
    texts = table(spark, sf_dir, "documents").select("doc_id", whole.alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return K.paragraphs_by(texts, "doc_id", order=("file", "row")).select("doc_id", F.md5("html").alias("digest"))


_RULES = [(1, "of the", "Of a"), (2, "in the", None), (3, "the MIT License", "an open license"), (4, "CC BY", None), (5, "die der", "die"), (6, "que", None)]
_PIECES = r"""u AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+(?:[''’-][A-Za-z0-9_]+)*|[^A-Za-z0-9_]+') AS p FROM documents)),
w AS (SELECT doc_id, p[1] AS head, i, p[i] AS a, coalesce(p[i - 1], '') AS before, p[i:i + 4] AS s, p[i:i + 5] AS more FROM u WHERE regexp_matches(p[i], '^[A-Za-z0-9_]')),
t AS (SELECT doc_id, CASE WHEN regexp_matches(head, '^[A-Za-z0-9_]') THEN (i + 1) // 2 ELSE i // 2 END::INT AS word, before, s, more FROM w)"""
_HITS = """SELECT doc_id, word, rule, substr(array_to_string(s[:k], ''), 1, length(phrase)) AS original FROM t, r
  WHERE (lower(array_to_string(s[:k], '')) = phrase OR starts_with(lower(array_to_string(s[:k], '')), phrase || chr(39)) OR starts_with(lower(array_to_string(s[:k], '')), phrase || '’')) AND NOT ends_with(before, '-') AND NOT starts_with(coalesce(more[k + 1], ''), '-')"""


@query(
    "WITH " + _PIECES + ", r(rule, phrase, k, new) AS (VALUES " + ", ".join(f"({i}, '{p.lower()}', {2 * len(p.split()) - 1}, {'NULL' if n is None else repr(n)})" for i, p, n in _RULES) + f"), h AS ({_HITS}) "
    "SELECT doc_id, word, rule AS rule_id, original, CASE WHEN new IS NULL THEN 'observation' ELSE 'edit' END AS kind, CASE WHEN length(original) > 1 AND original = upper(original) AND regexp_matches(original, '[A-Z]') THEN upper(new) "
    "WHEN upper(original[1]) = original[1] AND lower(original[1]) <> original[1] THEN upper(new[1]) || substr(new, 2) ELSE new END AS replacement FROM h JOIN r USING (rule)"
)
def lexicon_hits(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "rule_id int, phrase string, replacement string")
    return K.find_terms(table(spark, sf_dir, "documents"), rules, ["doc_id"]).drop("gram")


_IDIOMS = [("by the", "near"), ("in a", "inside"), ("que de", "how many"), ("of the thing", "its")]


@query("WITH " + _PIECES + ", r(rule, phrase, k, gloss) AS (VALUES " + ", ".join(f"('{p}', '{p}', {2 * len(p.split()) - 1}, '{g}')" for p, g in _IDIOMS) + f"), h AS ({_HITS}) SELECT doc_id, word, rule AS idiom, original, gloss, original || ' (' || gloss || ')' AS suggestion FROM h JOIN r USING (rule)")
def idioms_found(spark, sf_dir):
    return K.find_idioms(table(spark, sf_dir, "documents"), spark.createDataFrame(_IDIOMS, "phrase string, gloss string"), ["doc_id"])


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def occurrence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.occurrence_index("text", F.lit("the")).cast("long").alias("n"))


@query("SELECT o_orderkey, CASE WHEN length(o_comment) - length(replace(o_comment, 'e', '')) >= 1 THEN regexp_replace(o_comment, 'e', 'E') END AS edited FROM (SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus || ' e e' AS o_comment FROM orders)")
def edits_applied(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.lit("e e")).alias("c"))
    return made.select("o_orderkey", K.nth_replaced("c", F.lit("e"), F.lit("E"), F.lit(0)).alias("edited"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 10) AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 45)")
def findings_open(spark, sf_dir):
    findings = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    return K.open_findings(findings, part.filter("p_size < 10"), part.filter("p_size > 45"), ["l_partkey"])


@query()
def proper_nouns(spark, sf_dir):
    return K.proper_nouns(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS words, length(text) AS chars, ceil(length(text) / 4.0)::BIGINT AS tokens, ceil(length(text) / 4.0) > 1000 AS over FROM documents")
def prompt_sizes(spark, sf_dir):
    return K.prompt_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", 1000)


@query("""WITH x AS (SELECT o_custkey AS chapter_id, o_orderkey % 6 AS row_id, max(CASE o_orderstatus WHEN 'F' THEN 'exclusive' WHEN 'O' THEN 'inclusive' ELSE 'na' END) AS rating FROM orders GROUP BY 1, 2),
g AS (SELECT DISTINCT o_custkey AS chapter_id, r AS row_id FROM orders, (SELECT unnest(range(8)) AS r))
SELECT chapter_id, count(*) FILTER (rating = 'na') AS na, count(*) FILTER (rating = 'exclusive') AS exclusive, count(*) FILTER (rating = 'emerging') AS emerging, count(*) FILTER (rating = 'inclusive') AS inclusive, count(*) FILTER (rating IS NULL) AS unrated FROM g LEFT JOIN x USING (chapter_id, row_id) GROUP BY chapter_id""")  # fmt: skip
def rubric_rating_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rating = F.when(F.col("o_orderstatus") == "F", "exclusive").when(F.col("o_orderstatus") == "O", "inclusive").otherwise("na")
    ratings = orders.groupBy(F.col("o_custkey").alias("chapter_id"), (F.col("o_orderkey") % 6).cast("int").alias("row_id")).agg(F.max(rating).alias("rating"))
    return K.rating_counts(ratings, list(range(8)), orders.select(F.col("o_custkey").alias("chapter_id")).distinct())


@query("SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN md5(text) END AS quote, CASE WHEN turn % 3 < 2 THEN CASE WHEN turn % 5 BETWEEN 1 AND 3 THEN turn % 5 ELSE 2 END END AS priority FROM conversations")
def replies_parsed(spark, sf_dir):
    """Whole texts as quotes of replies: fenced, bare, or none."""
    c = table(spark, sf_dir, "conversations")
    made = F.to_json(F.struct(F.array(F.struct(F.lit("r1").alias("row"), F.col("text").alias("quote"), (F.col("turn") % 5).cast("int").alias("priority"))).alias("items")))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), made, F.lit("\n```\n"))).when(F.col("turn") % 3 == 1, made).otherwise("I can't do that { sorry")
    first = F.get("parsed", 0)
    return K.parse_replies(c.withColumn("reply", reply), "reply").select("conv_id", "turn", F.md5(first["quote"]).alias("quote"), first["priority"].alias("priority"))


@query("""WITH d AS (SELECT conv_id, turn AS draft, CASE turn % 4 WHEN 0 THEN substr(text, 2, 12) WHEN 1 THEN substr(text, 3, 5) WHEN 2 THEN '' ELSE substr(text, 1, 6) || '~' END AS quote FROM conversations)
SELECT d.conv_id, draft, min(c.turn) AS block_idx, CASE WHEN min(c.turn) IS NULL THEN 'observation' ELSE 'edit' END AS kind FROM d LEFT JOIN conversations c ON c.conv_id = d.conv_id AND quote <> '' AND contains(c.text, quote) GROUP BY d.conv_id, draft""")
def drafts_grounded(spark, sf_dir):
    """Turns as blocks and as drafts: some quote a passage, some a few letters, some nothing, some what stands nowhere."""
    c = table(spark, sf_dir, "conversations")
    blocks = c.select("conv_id", F.col("turn").alias("block_idx"), "text")
    quote = F.when(F.col("turn") % 4 == 0, F.substring("text", 2, 12)).when(F.col("turn") % 4 == 1, F.substring("text", 3, 5)).when(F.col("turn") % 4 == 2, "").otherwise(F.concat(F.substring("text", 1, 6), F.lit("~")))
    drafts = c.select("conv_id", F.col("turn").alias("draft"), quote.alias("quote"))
    return K.ground_drafts(drafts, blocks, "conv_id").select("conv_id", "draft", "block_idx", "kind")


@query("WITH t AS (SELECT doc_id, string_split(text, chr(10) || 'The') AS s FROM documents) SELECT doc_id, unnest(range(len(s)))::INT AS part, length(unnest(s))::INT AS n FROM t")
def pages_split(spark, sf_dir):
    return K.split_pages(table(spark, sf_dir, "documents"), "doc_id", "text", "\nThe").select("doc_id", "part", F.length("slice").alias("n"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem WHERE l_suppkey % 4 > 0), g AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS k FROM p), r AS (SELECT doc, min(page) AS a, max(page) AS b FROM g GROUP BY doc, k)
SELECT doc, string_agg(CASE WHEN b - a >= 2 THEN a || '–' || b WHEN b > a THEN a || ', ' || b ELSE a::VARCHAR END, ', ' ORDER BY a) AS ranges FROM r GROUP BY doc""")
def page_ranges(spark, sf_dir):
    return K.page_ranges(table(spark, sf_dir, "lineitem").filter("l_suppkey % 4 > 0").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")), "doc")


@query()
def glyph_corruption(spark, sf_dir):
    spoilt = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?<=\p{L})st(?=\p{L})", "¤").alias("text"))
    return K.glyph_corruption(spoilt, "doc_id", "text")


@query("SELECT coalesce(a.k, b.k) AS p_partkey, b.v - a.v AS p_size, CASE WHEN b.k IS NULL THEN 'right' WHEN a.k IS NULL THEN 'left' END AS missing FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 5 > 0) a FULL JOIN (SELECT p_partkey AS k, p_size * 2 AS v FROM part WHERE p_partkey % 7 > 0) b ON a.k = b.k")
def runs_compared(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return K.compare_runs(part.filter("p_partkey % 5 > 0"), part.filter("p_partkey % 7 > 0").withColumn("p_size", F.col("p_size") * 2), "p_partkey", ["p_size"])


@query("SELECT count(*) AS n, count(*) FILTER (p_size % 4 > 0) AS judged, count(*) FILTER (p_size % 4 > 0 AND p_partkey % 100 > 0) AS filled, 0 AS long, '' AS reasons, true AS passed FROM part")
def generation_gate(spark, sf_dir):
    results = table(spark, sf_dir, "part").select((F.col("p_size") % 4 == 0).alias("decorative"), F.when(F.col("p_partkey") % 100 > 0, F.col("p_name")).alias("draft"))
    return K.generation_gate(results, 30)


@query("SELECT p_brand, CASE WHEN count(*) FILTER (p_size % 2 = 0) = 0 THEN 'not run' WHEN bool_and(p_partkey % 50 > 0) FILTER (p_size % 2 = 0) THEN 'pass' ELSE 'fail' END AS even, CASE WHEN count(*) FILTER (p_size % 2 = 1) = 0 THEN 'not run' WHEN bool_and(p_partkey % 50 > 0) FILTER (p_size % 2 = 1) THEN 'pass' ELSE 'fail' END AS odd, 'not run' AS other FROM part GROUP BY p_brand")
def evidence_matrix(spark, sf_dir):
    seen = table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("variant"), (F.col("p_partkey") % 50 > 0).alias("ok"))
    return K.evidence_matrix(seen, "p_brand", "variant", ["even", "odd", "other"], "ok")


@query("SELECT p_brand, bool_and(p_partkey % 100 > 0) AS passed, max(p_size) AS worst_ms, max(p_partkey) AS peak FROM part GROUP BY p_brand")
def profiles(spark, sf_dir):
    return K.profile_rollup(table(spark, sf_dir, "part").withColumn("ok", F.col("p_partkey") % 100 > 0), "p_brand", "ok", "p_size", "p_partkey")


_TREE = """WITH n AS (SELECT 0 AS book, 'r' || r_regionkey AS node, NULL AS parent, r_regionkey::BIGINT AS ord FROM region UNION ALL SELECT 0, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
  UNION ALL SELECT 0, 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier) """


@query(_TREE + """, l AS (SELECT book, node, ord, node AS chapter, [ord] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.book, n.node, n.ord, l2.chapter, list_append(l2.path, n.ord) FROM n JOIN (SELECT book, node, node AS chapter, [ord] AS path FROM n WHERE parent IS NULL) l2 ON n.parent = l2.node
  UNION ALL SELECT c.book, c.node, c.ord, a.node, [a.ord, b.ord, c.ord] FROM n c JOIN n b ON c.parent = b.node JOIN n a ON b.parent = a.node)
SELECT book, chapter, node, row_number() OVER (PARTITION BY book, chapter ORDER BY path)::INT AS n FROM l WHERE node NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL)""")  # fmt: skip
def outlines(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    row = lambda df, p, key, parent: df.select(F.lit(0).alias("book"), F.concat(F.lit(p), F.col(key).cast("string")).alias("node"), parent.alias("parent"), F.col(key).cast("long").alias("ord"))
    nodes = row(region, "r", "r_regionkey", F.lit(None).cast("string")).unionByName(row(nation, "n", "n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))).unionByName(row(supplier, "s", "s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))))
    return K.outline(K.flatten_tree(nodes), nodes)


@query(_TOKENS + ", d AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS k FROM lnk WHERE text <> '') SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS n, href AS url, text FROM d WHERE k = 1")
def toc_from_links(spark, sf_dir):
    return K.toc_from_links(P.links(P.tokenize(table(spark, sf_dir, "pages"), "page_id"), "page_id"), "page_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'not-https' WHEN s_suppkey % 4 = 1 THEN 'credentials' WHEN s_suppkey % 4 = 2 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'secret-in-query' ELSE 'allowed' END ELSE 'host-not-listed' END AS verdict FROM supplier")
def fetch_policy(spark, sf_dir):
    k = F.col("s_suppkey")
    tail = F.when(k % 3 == 0, "/?a=1&Token=x").otherwise("/p")
    url = F.when(k % 4 == 0, F.lit("http://ok.example.com/")).when(k % 4 == 1, F.lit("https://u:p@ok.example.com/")).when(k % 4 == 2, F.concat(F.lit("https://ok.example.com"), tail)).otherwise("https://no.example.com/")
    hosts = spark.createDataFrame([("ok.example.com",)], "host string")
    return K.classify_targets(table(spark, sf_dir, "supplier").withColumn("url", url), "url", hosts).select("s_suppkey", "verdict")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'pdf' WHEN 2 THEN 'blank' END AS reason, CASE WHEN s_suppkey % 4 = 3 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'redirected,license-unnamed' ELSE 'license-unnamed' END END AS findings FROM supplier")
def articles_admitted(spark, sf_dir):
    k = F.col("s_suppkey")
    crawl = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.lit("https://a.example.org/x").alias("requested_url"), F.when(k % 4 == 1, "https://a.example.org/y.PDF").when(k % 3 == 0, "https://a.example.org/z?q").otherwise("https://a.example.org/x#f").alias("final_url"),
        F.when(k % 4 == 0, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.when(k % 4 == 2, " ").otherwise("text").alias("markdown"), F.lit(None).cast("string").alias("license_name"), F.lit(None).cast("string").alias("cached_at"),
    )
    return K.admit_articles(crawl).select("s_suppkey", "reason", F.array_join("findings", ",").alias("findings"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_brand) LIKE '%red%'")
def catalog_search(spark, sf_dir):
    return K.search_catalog(table(spark, sf_dir, "part"), " Red ", ("p_name", "p_brand")).select("p_partkey")


@query("WITH t AS (SELECT lower(p_type) AS t, count(*) AS n, min(p_brand) AS b FROM part GROUP BY 1) SELECT p.p_partkey, CASE WHEN p.p_partkey % 2 = 0 THEN 'slug' WHEN n = 1 THEN 'title' ELSE 'none' END AS matched, CASE WHEN p.p_partkey % 2 = 0 THEN p.p_brand WHEN n = 1 THEN b ELSE '' END AS authors FROM part p JOIN t ON lower(p.p_type) = t")
def authors_enriched(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    books = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("b"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).alias("slug"), F.col("p_type").alias("title"))
    authority = part.select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("slug"), F.upper("p_type").alias("title"), F.array("p_brand").alias("authors"))
    return K.enrich_authors(books, authority).select("p_partkey", "matched", F.array_join("authors", ",").alias("authors"))


#: Regions as chapters, each beginning at its first nation; nations link to the others of their region in an order of their own, in circles, and then to their suppliers. Each third nation has nothing to show.
_WALK = """WITH RECURSIVE e AS (SELECT 'n' || a.n_nationkey AS src, 'n' || b.n_nationkey AS dst, (a.n_nationkey * 7 + b.n_nationkey * 3) % 11 * 100 + b.n_nationkey AS ord FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 100000 + s_suppkey FROM supplier),
w AS (SELECT n_regionkey AS chapter, 'n' || min(n_nationkey) AS url, [0::BIGINT] AS label, ['n' || min(n_nationkey)] AS path FROM nation GROUP BY 1 UNION ALL SELECT chapter, dst, list_append(label, ord), list_append(path, dst) FROM w JOIN e ON url = src WHERE NOT list_contains(path, dst)),
b AS (SELECT chapter, url, min(label) AS label FROM w GROUP BY ALL), r AS (SELECT chapter, count(*) AS reached FROM b GROUP BY 1), k AS (SELECT b.*, reached > 24 AS over FROM b JOIN r USING (chapter)),
o AS (SELECT chapter, url, row_number() OVER (PARTITION BY chapter ORDER BY label) - 1 AS n FROM k WHERE NOT over AND (url NOT IN (SELECT src FROM e) OR url[2:]::INT % 3 > 0))
SELECT chapter, n::INTEGER AS n, url, NULL::VARCHAR AS error FROM o UNION ALL SELECT DISTINCT chapter, NULL, NULL, 'more than 24 pages' FROM k WHERE over"""


@query(_WALK)
def crawl_in_order(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    a, b = (nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias(n)) for n in "ab")
    around = a.join(b, "r").filter("a <> b").select(name("n", "a").alias("src"), name("n", "b").alias("dst"), ((F.col("a") * 7 + F.col("b") * 3) % 11 * 100 + F.col("b")).cast("long").alias("ord"))
    links = around.unionByName(supplier.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst"), (F.lit(100000) + F.col("s_suppkey")).alias("ord")))
    seeds = nation.groupBy(F.col("n_regionkey").alias("chapter")).agg(F.min("n_nationkey").alias("first")).select("chapter", name("n", "first").alias("url"), F.lit(0).alias("ord"))
    return K.crawl(seeds, links, nation.filter("n_nationkey % 3 > 0").select(name("n", "n_nationkey").alias("url")), 24)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem),
r AS (SELECT n_regionkey AS chapter, 's' || s_suppkey AS url FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT r.chapter, e.dst FROM r JOIN e ON r.url = e.src) SELECT chapter, url FROM r""")
def crawl_frontier(spark, sf_dir):
    """Regions as chapters, their suppliers as first pages: from suppliers to parts, from parts to orders."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    links = lines.select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst")).unionByName(lines.select(name("p", "l_partkey").alias("src"), name("o", "l_orderkey").alias("dst")))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("chapter"))
    seeds = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select("chapter", name("s", "s_suppkey").alias("url"))
    return K.expand_frontier(seeds, links, budget=None).select("chapter", "url")


@query("WITH b AS (SELECT p_partkey, p_brand, regexp_replace(p_type, '[^A-Za-z0-9_.:-]+', '-', 'g') AS a FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, a ORDER BY p_partkey) AS k FROM b) SELECT p_partkey, CASE WHEN k = 1 THEN a ELSE a || '-' || k END AS anchor FROM n")
def heading_anchors(spark, sf_dir):
    return P.anchor_ids(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_brand", "p_type", ["p_partkey"]).select("p_partkey", "anchor")


@query()
def block_ids(spark, sf_dir):
    tokens = P.tokenize(table(spark, sf_dir, "pages"), "page_id")
    return P.assign_block_ids(P.text_blocks(tokens, "page_id", whole=True), "page_id", "el")


@query()
def link_references(spark, sf_dir):
    return P.preceding_reference(P.tokenize(table(spark, sf_dir, "pages"), "page_id"), "page_id", ("br",))


@query()
def first_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence("text").alias("sentence"))


@query("SELECT doc_id, 'x' || doc_id AS tex, doc_id % 2 = 0 AS display FROM documents")
def tex_extracted(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    made = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a $$ x"), d, F.lit(" $$ b"))).otherwise(F.concat(F.lit("a \\(x"), d, F.lit("\\) b")))
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.lit("text").alias("kind"), made.alias("text"))
    return P.extract_tex(tokens, "doc_id").select("doc_id", "tex", "display")
