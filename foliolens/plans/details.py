"""Queries on rules that the pages of the tables never meet: pages and logs made of their columns, whose rows go every way."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.operators import chapters as H
from foliolens.operators import compiling, imports
from foliolens.operators import corpora as K
from foliolens.operators import decks as D
from foliolens.operators import pages as P
from foliolens.operators import queues as Q
from foliolens.plans.queues import _GRID, _cells
from foliolens.plans.registry import query, table


def _text(*c):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])


def _made(spark, sf_dir, *html):
    """Pages of parts: (p_partkey, html)."""
    return table(spark, sf_dir, "part").select("p_partkey", _text(*html).alias("html"))


class _Part:
    """Columns of parts, made when they are asked for: queries are registered before a session exists."""

    key = property(lambda self: F.col("p_partkey"))
    size = property(lambda self: F.col("p_size"))
    name = property(lambda self: F.col("p_name"))
    type = property(lambda self: F.col("p_type"))


_P = _Part()


@query("""WITH a AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '$IMS-CC-FILEBASE$/packaged/a.png' WHEN 1 THEN 'http://o.example/i.png' WHEN 2 THEN 'http:///x' ELSE '../i/' || p_size || '.png' END AS src,
  CASE p_partkey % 5 WHEN 0 THEN './book@1:page-' || p_partkey WHEN 1 THEN '#f' WHEN 2 THEN 'http://h.example/y' WHEN 3 THEN 'http://o.example/y' ELSE 'https://[bad' END AS href FROM part),
b AS (SELECT *, CASE WHEN src LIKE '../%' THEN 'https://h.example' || src[3:] WHEN src = 'http://o.example/i.png' THEN 'https' || src[5:] ELSE src END AS src2, CASE WHEN href = 'http://h.example/y' THEN 'https' || href[5:] ELSE href END AS href2 FROM a)
SELECT p_partkey, src2 AS src, href2 AS href, ((src <> src2)::INT + (href <> href2)::INT)::BIGINT AS rewritten, ((src LIKE 'http://o.%')::INT + (href LIKE 'http://h.%')::INT)::BIGINT AS upgraded, ((src = 'http:///x')::INT + (href LIKE '%[bad')::INT)::BIGINT AS failed FROM b""")
def addresses_made_absolute(spark, sf_dir):
    src = F.when(_P.size % 7 == 0, "$IMS-CC-FILEBASE$/packaged/a.png").when(_P.size % 7 == 1, "http://o.example/i.png").when(_P.size % 7 == 2, "http:///x").otherwise(_text("../i/", _P.size, ".png"))
    href = F.when(_P.key % 5 == 0, _text("./book@1:page-", _P.key)).when(_P.key % 5 == 1, "#f").when(_P.key % 5 == 2, "http://h.example/y").when(_P.key % 5 == 3, "http://o.example/y").otherwise("https://[bad")
    pages = _made(spark, sf_dir, '<img src="', src, '"><a href="', href, '">x</a>')
    done = P.absolute_urls(P.tokenize(pages, "p_partkey").withColumn("base", F.lit("https://h.example/b/c")), "base", r"^\./book@")
    return done.groupBy("p_partkey").agg(F.max(P.attribute("src")).alias("src"), F.max(P.attribute("href")).alias("href"), *[F.sum(c).alias(c) for c in ("rewritten", "upgraded", "failed")])


@query("SELECT p_partkey, '<strong>' || p_name || '</strong>' || p_type || '<a href=\"/x\">' || CASE WHEN p_size % 2 = 0 THEN '<u>' || p_size || '</u>' ELSE '<em>y</em>' END || '</a>z' AS html FROM part")
def underlines_by_link(spark, sf_dir):
    inner = F.when(_P.size % 2 == 0, _text("<u>", _P.size, "</u>")).otherwise("<i>y</i>")
    pages = _made(spark, sf_dir, "<b>", _P.name, "</b><u>", _P.type, '</u><a href="/x">', inner, "</a><u>z</u>")
    return P.sanitize(P.text_semantics(P.tokenize(pages, "p_partkey"), "p_partkey"), "p_partkey")


@query("SELECT p_partkey, 'td-has-header' AS id, 'critical' AS impact, 3 AS pos FROM part WHERE p_size % 5 IN (0, 3)")
def tables_without_headers(spark, sf_dir):
    role = F.when(_P.size % 5 == 1, ' role="presentation"').otherwise("")
    body = F.when(_P.size % 5 == 2, "<tr><td><table><tr><th>x</th></tr></table></td></tr>").when(_P.size % 5 == 4, "").otherwise("<tr><td>x</td></tr>")
    pages = _made(spark, sf_dir, "<p>", _P.name, "</p><table", role, ">", body, "</table><table><tr><th>y</th></tr></table>")
    return P.table_issues(P.tokenize(pages, "p_partkey"), "p_partkey")


@query(_GRID + """SELECT c.t AS table_id, c.r::INT AS row_idx, c.c::INT AS col_idx, CASE WHEN c.t % 4 = 0 THEN 'nested' WHEN g.rowspan THEN 'rowspan' WHEN g.ragged THEN 'ragged' WHEN g.fr > 1 THEN 'colspan-in-band' END AS refused FROM c JOIN g USING (t)""")
def nested_tables_refused(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("nested", F.col("table_id") % 4 == 0)
    answers = cells.select("table_id").distinct().withColumn("choice", F.lit("row"))
    return Q.promote_headers(cells, answers).select("table_id", "row_idx", "col_idx", "refused")


@query(_GRID + """SELECT t AS table_id, CASE WHEN t % 6 = 5 THEN 'presentational' WHEN t % 4 = 0 OR g.rowspan OR g.ragged OR g.fr > 1 THEN 'queued' ELSE 'promoted' END AS status,
  CASE WHEN t % 6 = 5 THEN NULL WHEN t % 4 = 0 THEN 'nested' WHEN g.rowspan THEN 'rowspan' WHEN g.ragged THEN 'ragged' WHEN g.fr > 1 THEN 'colspan-in-band' END AS refused FROM g""")
def nested_tables_queued(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("nested", F.col("table_id") % 4 == 0)
    tables = cells.select("table_id").distinct().withColumn("role", F.when(F.col("table_id") % 6 == 5, "presentation"))
    return Q.queue_tables(tables, cells, tables.select("table_id", F.lit("row").alias("choice"))).select("table_id", "status", "refused")


@query("SELECT p_partkey, 1::BIGINT AS headings, (p_size % 2)::BIGINT AS notes, 2::BIGINT AS images, (1 + (p_size % 3 = 0)::INT)::BIGINT AS unavailable FROM part")
def notes_and_unavailable(spark, sf_dir):
    aside = F.when(_P.size % 2 == 1, '<aside role="note">n</aside><aside>o</aside>').otherwise('<aside role="tip">n</aside>')
    src = F.when(_P.size % 3 == 0, "https://o.example/a.png").otherwise("$IMS-CC-FILEBASE$/packaged/a.png")
    pages = _made(spark, sf_dir, "<h2>", _P.name, "</h2>", aside, '<img src="', src, '"><img alt="">')
    return P.content_counts(P.tokenize(pages, "p_partkey"), "p_partkey").select("p_partkey", "headings", "notes", "images", "unavailable")


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || p_type AS text FROM part")
def texts_without_source(spark, sf_dir):
    """The text of compiled sections: what the compiler adds is no part of it."""
    sections = _made(spark, sf_dir, "<h3>", _P.name, "</h3><p>", _P.type, "</p>").withColumn("title", F.lit("Banner"))
    done = compiling.compile_sections(sections, "p_partkey", once=False).sections
    blocks = P.text_blocks(P.tokenize(done, "p_partkey"), "p_partkey", without=P.ADDED)
    return P.section_text(blocks, "p_partkey")


_CODE = "ltrim(array_to_string(list_transform(range(6, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // (36 ** i)::BIGINT) % 36)::INTEGER + 1, 1)), ''), '0')"


@query(f"""WITH f AS (SELECT p_partkey, p_size, list_reduce([2166136261::BIGINT] || list_transform(string_split(p_partkey::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM part), c AS (SELECT p_partkey, p_size, {_CODE} AS code FROM f),
b AS (SELECT p_partkey, unnest([{{'tag': 'h2', 'n': 0, 'own': CASE WHEN p_size % 2 = 0 THEN 'top' END}}, {{'tag': 'p', 'n': 1, 'own': NULL}}, {{'tag': 'li', 'n': 2, 'own': CASE WHEN p_size % 3 = 0 THEN 'item' END}}, {{'tag': 'td', 'n': 3, 'own': NULL}}]) AS b, code FROM c)
SELECT p_partkey, b.tag AS tag, coalesce(b.own, 'blk-' || code || '-' || b.n) AS block_id FROM b""")
def blocks_numbered(spark, sf_dir):
    """Ids of blocks by their section's hash and their place: own ids stay, inner blocks and what the compiler adds don't count."""
    top, item = F.when(_P.size % 2 == 0, ' id="top"').otherwise(""), F.when(_P.size % 3 == 0, ' id="item"').otherwise(' id=""')
    pages = _made(spark, sf_dir, '<div class="page-footer x"><p>no</p></div><h2', top, ">", _P.name, "</h2><p>a</p><ul><li", item, '><p id="inner">b</p></li></ul><table><tr><td>', _P.type, '</td></tr></table><div class="source-and-license"><p>no</p></div>')
    return P.block_ids(P.tokenize(pages, "p_partkey"), "p_partkey", whole=True).select("p_partkey", "tag", "block_id")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '<p>' || p_name || '</p><img src="$IMS-CC-FILEBASE$/packaged/a.png" alt="x">' WHEN p_size % 3 = 1 THEN '<p>' || p_name || '</p><span>[Embedded image: ' || p_type || ' &lt;1]</span>' ELSE '<p>' || p_name || '</p><span>[Embedded image]</span>' END AS html,
  (p_size % 3 > 0)::INT::BIGINT AS unavailable FROM part""")
def pictures_not_packaged(spark, sf_dir):
    image = F.when(_P.size % 3 == 0, '<img src="$IMS-CC-FILEBASE$/packaged/a.png" alt="x">').when(_P.size % 3 == 1, _text('<img src="https://o.example/a.png" alt="', _P.type, ' &lt;1">')).otherwise("<img src=b.png>")
    tokens = P.tokenize(_made(spark, sf_dir, "<p>", _P.name, "</p>", image), "p_partkey")
    pages, removals = imports.sanitize_import(tokens, P.elements(tokens, "p_partkey"), "p_partkey")
    gone = removals.filter("code = 'image-unavailable'").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("unavailable"))
    return pages.join(gone, "p_partkey", "left").fillna(0, ["unavailable"])


@query("SELECT p_partkey, 'a.href' AS target FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'img.src' FROM part WHERE p_size % 4 = 0")
def addresses_stripped(spark, sf_dir):
    href = F.when(_P.size % 3 == 0, "javascript:x").when(_P.size % 3 == 1, "mailto:a@b.c").otherwise("/p")
    src = F.when(_P.size % 4 == 0, "data:image/png,x").otherwise("https://o.example/a.png")
    pages = _made(spark, sf_dir, '<a href="', href, '">x</a><a href="', href, '">y</a><img src="', src, '" alt="">')
    return P.stripped_urls(P.attributes(P.tokenize(pages, "p_partkey"), "p_partkey"), "p_partkey")


@query("""WITH t AS (SELECT p_partkey, unnest([{'tag': 'main', 'first_pos': 0}, {'tag': CASE WHEN p_size % 2 = 0 THEN 'figure' END, 'first_pos': 4}, {'tag': CASE WHEN p_size % 3 = 0 THEN 'h1' END, 'first_pos': NULL}, {'tag': CASE WHEN p_size % 2 = 0 THEN 'figcaption' END, 'first_pos': 5}]) AS x FROM part)
SELECT p_partkey, x.tag AS tag, x.first_pos AS first_pos FROM t WHERE x.tag IS NOT NULL AND x.tag <> 'h1'""")
def meaning_removed(spark, sf_dir):
    """Elements with a meaning that the policy doesn't know; h1 is shifted before it is asked."""
    figure = F.when(_P.size % 2 == 0, "<figure><figcaption>c</figcaption></figure><figure>d</figure>").otherwise("<div>d</div>")
    heading = F.when(_P.size % 3 == 0, "h1").otherwise("h2")
    tokens = P.tokenize(_made(spark, sf_dir, "<main><", heading, ">", _P.name, "</", heading, ">", figure, "</main>"), "p_partkey")
    return P.removed_semantic(P.shift_headings(tokens, "p_partkey"), "p_partkey")


@query("""WITH c AS (SELECT p_partkey, unnest([{'selector': 'nav#toc', 'n': 1 + p_size % 2}, {'selector': '.mt-footer', 'n': 1}, {'selector': 'div [data-k=x] p', 'n': p_size % 3}]) AS x FROM part) SELECT p_partkey, x.selector AS selector, x.n::BIGINT AS n FROM c WHERE x.n > 0""")
def chrome_by_selector(spark, sf_dir):
    toc = F.repeat(F.lit('<nav id="toc"><p class="mt-footer">inner</p></nav>'), 1 + _P.size % 2)
    paragraphs = F.repeat(F.lit("<p>x</p>"), _P.size % 3)
    pages = _made(spark, sf_dir, toc, '<nav>kept</nav><div class="b mt-footer">y</div><p data-k="x">kept</p><div><ul data-k="x"><li>', paragraphs, "</li></ul></div>")
    return P.chrome_counts(P.tokenize(pages, "p_partkey"), "p_partkey", ("nav#toc", ".mt-footer", "div [data-k=x] p"), whole=True)


@query("SELECT p_brand AS doc, 'empty' AS code, count(*) AS findings, count(*) FILTER (p_size % 3 > 0) AS sections FROM part GROUP BY p_brand")
def plan_report(spark, sf_dir):
    """Findings and counts once plans are confirmed."""
    part = table(spark, sf_dir, "part")
    pages = part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("page"), (_P.size % 3 > 0).alias("included"))
    findings, counts = H.confirmed_report(part.select(F.col("p_brand").alias("doc"), F.lit("empty").alias("code"), F.col("p_partkey").alias("section_id")), pages.select("doc").distinct().withColumn("sections", F.lit(99)), H.confirm_plan(pages, "doc"), "doc")
    return findings.groupBy("doc", "code").agg(F.count(F.lit(1)).alias("findings")).join(counts, "doc")


@query(r"""WITH r AS (SELECT l_orderkey AS k, string_agg('| 7.' || (l_linenumber % 2 + 1) || ' | ' || l_linenumber || ' | ' || CASE WHEN l_returnflag = 'N' THEN 'not rated' ELSE l_returnflag END || ' | a\|b ' || l_suppkey || ' |', chr(10) ORDER BY l_linenumber % 2, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'not rated' ELSE l_returnflag END, l_suppkey::VARCHAR) AS t FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS k, '| 7.1 | e | ' || o_orderstatus || ' |' AS t FROM orders WHERE o_custkey % 2 = 0),
e AS (SELECT o_orderkey AS k, '| 7.6 | S | ' || CASE WHEN o_custkey % 3 = 0 THEN 'replace (stale)' ELSE 'replace' END || ' | old | ' || o_orderpriority || ' |' AS t FROM orders WHERE o_custkey % 5 > 0), x AS (SELECT k FROM r UNION SELECT k FROM c UNION SELECT k FROM e)
SELECT x.k AS chapter_id, '## Ratings' || chr(10) || chr(10) || coalesce('| Category | Row | Rating | Note |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || r.t, 'None.') || chr(10) || chr(10) || '## Checklist' || chr(10) || chr(10) || coalesce('| Category | Element | Answer |' || chr(10) || '| --- | --- | --- |' || chr(10) || c.t, 'None.')
  || chr(10) || chr(10) || '## Edits' || chr(10) || chr(10) || coalesce('| Category | Section | Kind | Original | Replacement |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || e.t, 'None.') AS markdown FROM x LEFT JOIN r USING (k) LEFT JOIN c USING (k) LEFT JOIN e USING (k)""")
def reviews_exported(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.select(F.col("l_orderkey").alias("chapter_id"), _text("7.", F.col("l_linenumber") % 2 + 1).alias("category"), F.col("l_linenumber").alias("row_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("rating"), _text("a|b\n", F.col("l_suppkey")).alias("note"))
    checks = orders.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("chapter_id"), F.lit("7.1").alias("category"), F.lit("e").alias("element"), F.col("o_orderstatus").alias("answer"))
    applied = orders.filter("o_custkey % 5 > 0").select(F.col("o_orderkey").alias("chapter_id"), F.lit(1).alias("ord"), F.lit("7.6").alias("category"), F.lit("S").alias("section"), F.lit("replace").alias("kind"), F.lit("old").alias("original"), F.col("o_orderpriority").alias("replacement"), (F.col("o_custkey") % 3 == 0).alias("stale"))
    return H.export_review(rows, checks, applied).select("chapter_id", "markdown")


@query("""WITH p AS (SELECT p_brand AS doc, p_partkey AS page, p_size % 3 AS cols, p_partkey % 7 = 0 AS tab FROM part), d AS (SELECT doc, min(page) % 2 = 0 AS complex, min(page) % 3 = 0 AS bad FROM p GROUP BY doc), o AS (SELECT doc, count(*) AS n, min(page) AS page FROM p WHERE cols > 1 OR tab GROUP BY doc)
SELECT doc, 'reading-order' AS code, n, CASE WHEN n = 1 THEN page END AS page FROM o UNION ALL SELECT doc, 'reading-order', 1, NULL FROM d WHERE complex AND doc NOT IN (SELECT doc FROM o) UNION ALL SELECT doc, 'encoding', 1, NULL FROM d WHERE bad""")
def layout_findings(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("page"), F.lit(100).alias("text_length"), F.lit(0).alias("images"), F.lit(0).alias("packaged"), (_P.size % 3).alias("columns"), (_P.key % 7 == 0).cast("int").alias("tables"))
    documents = pages.groupBy("doc").agg((F.min("page") % 2 == 0).alias("is_complex"), F.lit(False).alias("bad_encoding"), F.when(F.min("page") % 3 == 0, 4).alias("intruders"))
    return D.document_findings(pages, "doc", documents)


@query("SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'rule' ELSE 'inventory' END AS kind, '7.' || unnest([p_size % 8 + 1, p_partkey % 8 + 1]) AS category FROM part")
def finder_categories(spark, sf_dir):
    return D.finder_categories(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(_P.size % 2 == 0, "rule").otherwise("inventory").alias("kind"), F.array(_text("7.", _P.size % 8 + 1), _text("7.", _P.key % 8 + 1)).alias("categories")))


@query("""WITH i AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'A doctor by a window' WHEN 1 THEN 'Manganese on a doctorate' WHEN 2 THEN 'photo.jpg' WHEN 3 THEN '' END AS alt, CASE WHEN p_partkey % 2 = 0 THEN 'A Group of ' || p_type ELSE p_name END AS caption FROM part)
SELECT p_partkey, CASE WHEN alt = 'photo.jpg' THEN 'alt-text-filename' END AS issue, coalesce(alt LIKE '%doctor by%', false) OR caption LIKE 'A Group of %' AS mentions_people FROM i""")
def people_in_pictures(spark, sf_dir):
    alt = F.when(_P.size % 5 == 0, "A doctor by a window").when(_P.size % 5 == 1, "Manganese on a doctorate").when(_P.size % 5 == 2, "photo.jpg").when(_P.size % 5 == 3, "")
    images = table(spark, sf_dir, "part").select("p_partkey", alt.alias("alt"), F.when(_P.key % 2 == 0, _text("A Group of ", _P.type)).otherwise(_P.name).alias("caption"))
    return H.image_inventory(images).select("p_partkey", "issue", "mentions_people")


@query("""WITH i AS (SELECT p_partkey, p_size AS s, p_partkey % 3 = 0 AS unread, CASE p_size % 4 WHEN 0 THEN '7.3' ELSE '7.6' END AS category FROM part), t AS (SELECT i.*, p_name AS name, p_type AS type FROM i JOIN part USING (p_partkey))
SELECT p_partkey AS section_id, p_partkey || '::llm::' || category || '::raw' AS key, 'observation' AS kind, NULL AS block, NULL AS replacement, 'no json ' || name AS text FROM t WHERE unread
UNION ALL SELECT p_partkey, p_partkey || '::llm::' || category || '::summary', 'observation', NULL, NULL, type FROM t WHERE NOT unread AND s % 2 = 0
UNION ALL SELECT p_partkey, CASE WHEN category = '7.6' AND s % 5 > 0 THEN p_partkey || '::b2::0::' || name ELSE p_partkey || '::llm::' || category || '::1' END, CASE WHEN category = '7.6' AND s % 5 > 0 THEN 'edit' ELSE 'observation' END, CASE WHEN category = '7.6' AND s % 5 > 0 THEN 'b2' END,
  CASE WHEN category = '7.6' AND s % 5 > 0 THEN 'new' END, CASE WHEN category = '7.6' AND s % 5 > 0 THEN '' ELSE 'new' END FROM t WHERE NOT unread""")
def findings_of_drafts(spark, sf_dir):
    """Replies of a model on parts: some can't be read, some quote what stands nowhere, some belong to a category that never edits."""
    part = table(spark, sf_dir, "part")
    category, unread = F.when(_P.size % 4 == 0, "7.3").otherwise("7.6").alias("category"), _P.key % 3 == 0
    replies = part.select(_P.key.alias("section_id"), category, F.when(unread, _text("no json ", _P.name)).alias("raw"), F.when(_P.size % 2 == 0, _P.type).alias("summary"))
    items = part.select(_P.key.alias("section_id"), category, F.lit(1).alias("n"), F.when(_P.size % 5 > 0, _P.name).otherwise("nowhere at all").alias("original"), F.lit("new").alias("replacement"), F.lit("").alias("suggestion"))
    blocks = part.select(_P.key.alias("section_id"), F.explode(F.array(F.struct(F.lit("b1").alias("block"), F.lit("nothing").alias("text")), F.struct(F.lit("b2").alias("block"), _text("a ", _P.name, " is ", _P.name).alias("text")), F.struct(F.lit("b3").alias("block"), _P.name.alias("text")))).alias("b")).select("section_id", "b.*")
    return K.draft_findings(replies, items, blocks).select("section_id", "key", "kind", "block", "replacement", "text")


@query("""WITH b AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+'), lambda x: x <> '') AS b FROM documents)
SELECT doc_id, md5(array_to_string(b[1:2], chr(10) || chr(10))) AS head, CASE WHEN len(b) > 2 THEN md5(array_to_string(b[-2:], chr(10) || chr(10))) ELSE md5('') END AS tail FROM b""")
def texts_edged(spark, sf_dir):
    """The first and last blocks of whole documents, a line a block."""
    edges = K.text_edges(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return table(spark, sf_dir, "documents").withColumn("e", edges).select("doc_id", F.md5("e.head").alias("head"), F.md5("e.tail").alias("tail"))


@query(r"""WITH p AS (SELECT p_partkey, p_size % 5 AS k, p_name AS name FROM part) SELECT p_partkey, 'image' AS source, name AS tex, k = 1 AS display FROM p WHERE k < 3 UNION ALL SELECT p_partkey, 'text', name || '^2', true FROM p UNION ALL SELECT p_partkey, 'text', 'y', false FROM p""")
def equations_found(spark, sf_dir):
    """TeX of pictures and of texts, not that of code."""
    k = _P.size % 5
    image = F.when(k == 0, _text('<img class="ql-img-inline" alt="\\(', _P.name, '\\)">')).when(k == 1, _text('<img src="https://quicklatex.com/1.png" alt="$$', _P.name, '$$">')).when(k == 2, _text('<img class="a ql-img-x" alt="$', _P.name, '$">'))
    image = image.when(k == 3, '<img class="ql-img-x" alt="Rendered by QuickLaTeX.com">').otherwise(_text('<img alt="\\(', _P.name, '\\)">'))
    tokens = P.tokenize(_made(spark, sf_dir, image, "<p>a \\[", _P.name, "^2\\] b \\(y\\)</p><pre>\\(z\\)</pre><p><code>$$w$$</code></p>"), "p_partkey")
    both = P.equation_images(tokens, "p_partkey").withColumn("source", F.lit("image")).unionByName(P.extract_tex(tokens, "p_partkey").withColumn("source", F.lit("text")))
    return both.select("p_partkey", "source", "tex", "display")


@query("""SELECT p_partkey, 'duplicate-id' AS id, 'minor' AS impact, 6 AS pos FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'image-alt', 'critical', 9 FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'heading-order', 'moderate', 6 FROM part WHERE p_size % 4 = 0
UNION ALL SELECT p_partkey, 'link-name', 'serious', 10 FROM part WHERE p_size % 5 = 0""")
def markup_issues(spark, sf_dir):
    """Each rule on markup, met by some pages."""
    again = F.when(_P.size % 2 == 0, ' id="a"').otherwise(' id="b"')
    level = F.when(_P.size % 4 == 0, "h4").otherwise("h3")
    image, link = F.when(_P.size % 3 == 0, '<img src="x">').otherwise('<img src="x" alt="">'), F.when(_P.size % 5 == 0, '<a href="/x"> </a>').otherwise('<a href="/x">y</a>')
    pages = _made(spark, sf_dir, '<h2 id="a">', _P.name, "</h2><p>", _P.type, "</p><", level, again, ">x</", level, ">", image, link)
    return P.structural_issues(P.tokenize(pages, "p_partkey"), "p_partkey")
