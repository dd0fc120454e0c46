"""Queries on whole compilations: sections made of parts, whose figures, tables, links, colours, answers and edits go every way, and the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import compiling
from foliolens.plans.registry import query, table

_BASE, _LINK = "https://h.example/book/a", "https://h.example/parts/"

#: The facts of a made section: how its table is built and answered, what its caption and link say, how grey its last line is.
_P = """p AS (SELECT p_partkey AS k, p_name AS name, p_type AS type, p_brand AS brand, p_size AS size, p_size % 5 = 0 AS wide, CASE p_partkey % 4 WHEN 0 THEN 'row' WHEN 1 THEN 'column' END AS choice, p_partkey % 3 = 0 AS edited,
  CASE WHEN p_size % 3 = 0 THEN 'Figure ' || p_partkey ELSE 'A ' || p_name || ' of ' || p_type END AS cap, CASE WHEN p_size % 2 = 0 THEN 'here' ELSE 'the list' END AS link, (p_size * 5) % 256 AS grey,
  CASE WHEN p_partkey % 2 = 0 THEN '$IMS-CC-FILEBASE$/packaged/p-' || p_partkey || '.png' ELSE 'https://h.example/i/' || p_partkey || '.png' END AS src FROM part),
f AS (SELECT k, list_reduce([2166136261::BIGINT] || list_transform(string_split(k::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM p),
s AS (SELECT p.*, wide AND choice = 'column' AS refused, choice IS NOT NULL AND NOT (wide AND choice = 'column') AS headed, 'About ' || name || ': see ' || link || ', ' || brand || '.' AS ref,
  ltrim(array_to_string(list_transform(range(6, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // (36 ** i)::BIGINT) % 36)::INTEGER + 1, 1)), ''), '0') AS code FROM p JOIN f USING (k))"""
_CELL = "CASE WHEN {th} THEN '<th' ELSE '<td' END || '{more} style=\"text-align: left\"' || CASE WHEN {th} THEN ' scope=\"{scope}\"' ELSE '' END || ' id=\"blk-' || code || '-{n}\">' || {text} || CASE WHEN {th} THEN '</th>' ELSE '</td>' END"


def _cell(n, text, th, scope, more=""):
    return _CELL.format(n=n, text=text, th=f"(headed AND choice IN ({th}))", scope=scope, more=more)


def _made(spark, sf_dir):
    """(sections, answers, edits) of the parts."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    caption = F.when(size % 3 == 0, text("Figure ", k)).otherwise(text("A ", F.col("p_name"), " of ", F.col("p_type")))
    src = F.when(k % 2 == 0, text("$IMS-CC-FILEBASE$/packaged/p-", k, ".png")).otherwise(text("/i/", k, ".png"))
    second = F.when(size % 5 == 0, text("<td colspan=2>", size, "</td>")).otherwise(text("<td>", size, "</td><td>c</td>"))
    grey = ((size * 5) % 256).cast("string")
    html = text(
        "<nav>menu</nav><h1>", F.col("p_name"), "</h1><h4>", F.col("p_type"), "</h4><p>About ", F.col("p_name"), ': see <a href="/parts/', k, '">', F.when(size % 2 == 0, "here").otherwise("the list"), "</a>, <b>", F.col("p_brand"),
        '</b>.</p><figure><img src="', src, '"><figcaption>', caption, '</figcaption></figure><table id="t"><tr><td>a</td><td>b</td></tr><tr>', second, '</tr></table><p style="color: rgb(', grey, ", ", grey, ", ", grey, ')">End.</p>',
    )
    sections = p.select("p_partkey", html.alias("html"), F.lit(_BASE).alias("base"), F.col("p_brand").alias("title"), F.lit("Parts").alias("book"), F.lit("P").alias("publisher"), F.when(k % 2 == 0, F.array("p_type")).alias("authors"))
    none = F.lit(None).cast("string")
    answers = p.filter(k % 4 < 2).select(text(k, "::t").alias("queue_key"), F.lit("table-headers").alias("type"), none.alias("text"), F.when(k % 4 == 0, "row").otherwise("column").alias("choice"))
    block = F.concat(F.lit("blk-"), F.lower(F.conv(T.fnv1a(k.cast("string")).cast("string"), 10, 36)), F.lit("-2"))
    edits = p.filter(k % 3 == 0).select("p_partkey", F.lit(1).alias("ord"), block.alias("element_id"), F.lit(0).alias("occurrence"), F.lit("About").alias("original"), F.lit("replace").alias("kind"), F.lit("on").alias("replacement"), none.alias("context"))
    return sections, answers, edits


def _compiled(spark, sf_dir, once=False):
    sections, answers, edits = _made(spark, sf_dir)
    return compiling.compile_sections(sections, "p_partkey", "pressbooks", answers=answers, edits=edits, once=once)


_LABEL = "CASE WHEN link = 'here' THEN 'Read more about ' || k ELSE link END"


@query(f"""WITH {_P} SELECT k AS p_partkey, '<div class="page-frame"><h2 id="blk-' || code || '-0" class="page-title"><strong>' || name || '</strong></h2><div class="page-body"><h3 id="blk-' || code || '-1"><strong>' || type || '</strong></h3><p id="blk-' || code || '-2">'
  || CASE WHEN edited THEN 'On ' ELSE 'About ' END || name || ': see <a href="{_LINK}' || k || '">' || {_LABEL} || '</a>, <strong>' || brand || '</strong>.</p><div class="figure-block" id="fig-0"><img src="' || src || '" aria-describedby="cap-fig-0" id="img-0"><p class="figure-caption" id="cap-fig-0">' || cap
  || '</p></div><table id="t" width="100%" border="1"><caption style="text-align: center">' || ref || '</caption><tr>' || {_cell(4, "'a'", "'row', 'column'", "' || CASE choice WHEN 'row' THEN 'col' ELSE 'row' END || '")} || {_cell(5, "'b'", "'row'", "col")} || '</tr><tr style="background-color: #f2f2f2">'
  || CASE WHEN wide THEN {_cell(6, "size", "'column'", "row", ' colspan="2"')} ELSE {_cell(6, "size", "'column'", "row")} || {_cell(7, "'c'", "'none'", "row")} END || '</tr></table><p style="color: ' || CASE WHEN grey >= 119 THEN '#2d3b45' ELSE 'rgb(' || grey || ', ' || grey || ', ' || grey || ')' END
  || '" id="blk-' || code || CASE WHEN wide THEN '-7' ELSE '-8' END || '">End.</p><div class="source-and-license"><h2>Source and license</h2><p>' || brand || ' — from Parts, published by P.</p><p>' || CASE WHEN k % 2 = 0 THEN 'By ' || type || '.' ELSE 'Authors not stated.' END || '</p><p>License not stated.</p>'
  || CASE WHEN edited THEN '<p class="change-note">Modified from the original: wording updated for inclusive language.</p>' ELSE '' END || '</div></div><div class="page-footer"><p>Continue to the next page.</p></div></div>' AS html, NULL::VARCHAR AS error FROM s""")  # fmt: skip
def sections_compiled(spark, sf_dir):
    """Sections after all fifteen steps, with the answers and edits that people gave."""
    return _compiled(spark, sf_dir).sections


@query(f"""WITH {_P}, n AS (SELECT k, unnest([{{'step': 'strip-chrome', 'message': 'chrome removed', 'n': 1}}, {{'step': 'absolutize', 'message': 'addresses made absolute', 'n': CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END}}, {{'step': 'headings', 'message': 'headings re-levelled so that none skips', 'n': 2}},
  {{'step': 'figures', 'message': CASE WHEN size % 3 = 0 THEN 'caption of fig-0 is only a label: ' || cap END, 'n': 1}}, {{'step': 'figures', 'message': 'figures restructured', 'n': 1}},
  {{'step': 'tables', 'message': CASE WHEN refused THEN 'table headers refused: a cell of the band spans columns' WHEN headed THEN 'table headers set: ' || choice END, 'n': 1}}, {{'step': 'tables', 'message': 'captions and looks of tables added', 'n': CASE WHEN wide THEN 8 ELSE 9 END}},
  {{'step': 'links', 'message': CASE WHEN link = 'here' THEN 'link texts made to say where they lead' END, 'n': 1}}, {{'step': 'text-semantics', 'message': 'presentational tags replaced', 'n': 1}}, {{'step': 'contrast', 'message': CASE WHEN grey >= 119 THEN 'text colours of low contrast replaced' END, 'n': 1}},
  {{'step': 'source', 'message': 'source and license added', 'n': 1}}, {{'step': 'edits', 'message': CASE WHEN edited THEN 'edits applied' END, 'n': 1}}, {{'step': 'frame', 'message': 'banner, headings and footer set', 'n': 3}}]) AS x FROM s)
  SELECT k AS p_partkey, x.step AS step, x.message AS message, x.n::BIGINT AS n FROM n WHERE x.message IS NOT NULL""")  # fmt: skip
def sections_compiled_notes(spark, sf_dir):
    return _compiled(spark, sf_dir).notes.drop("ord")


@query(f"""WITH {_P} SELECT k AS p_partkey, k || '::img-0' AS queue_key, 'alt' AS kind, 'img-0' AS element_id, src, cap AS caption, 'About ' || name || ': see ' || {_LABEL} || ', ' || brand || '.' AS reference, CASE WHEN size % 3 <> 0 THEN cap END AS proposed FROM s
  UNION ALL SELECT k, k || '::t', 'table-headers', 't', NULL, NULL, ref, NULL FROM s WHERE NOT headed""")
def sections_compiled_queue(spark, sf_dir):
    return _compiled(spark, sf_dir).queue.select("p_partkey", "queue_key", "kind", "element_id", "src", "caption", "reference", "proposed")


@query(f"""WITH {_P} SELECT k AS p_partkey, count(*) FILTER (headed) = 1 AS has_headers, true AS compiled, false AS failed FROM s WHERE name < brand OR k % 7 = 0 GROUP BY k""")
def sections_recompiled(spark, sf_dir):
    """Only what changed is compiled again; here parts whose name sorts before their brand, and each seventh."""
    sections, answers, _ = _made(spark, sf_dir)
    changed = table(spark, sf_dir, "part").filter("p_name < p_brand OR p_partkey % 7 = 0")
    done = compiling.recompile_sections(sections, changed, "p_partkey", publisher="pressbooks", answers=answers, once=False)
    return done.sections.select("p_partkey", F.col("html").contains("<th ").alias("has_headers"), F.col("html").contains("page-frame").alias("compiled"), F.col("error").isNotNull().alias("failed"))


@query("SELECT page_id, NULL::VARCHAR AS error, length(html) > 0 AS has_html, true AS framed FROM pages")
def pages_through_all_steps(spark, sf_dir):
    """All pages through all steps against their own address; what the steps do to them is tested on the made sections."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.col("url").alias("base"), F.col("url").alias("canonical_url"))
    done = compiling.compile_sections(pages, "page_id", "pressbooks", once=False).sections
    return done.select("page_id", "error", (F.length("html") > 0).alias("has_html"), F.col("html").contains('class="page-frame"').alias("framed"))


@query("SELECT l_partkey AS page_id, max(l_orderkey * 10 + l_linenumber) AS version, '<h2>' || arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) || '</h2>' AS heading FROM lineitem GROUP BY 1")
def pages_upserted(spark, sf_dir):
    """Line items as versions of the pages of their parts, arriving in four batches in no order; each page ends up as its last version, compiled."""
    from foliolens.operators.lineage import folder
    from foliolens.streaming import folds

    lines, at = table(spark, sf_dir, "lineitem"), folder(spark, "versions")
    version = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version")
    versions = lines.select(F.col("l_partkey").alias("page_id"), version, F.concat(F.lit("<h2>"), "l_returnflag", F.lit("</h2>")).alias("html"))
    versions.repartition(4, "version").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(versions.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    compile_ = lambda df: compiling.compile_sections(df, "page_id", order=compiling.steps.STEPS[:9], once=False).sections
    folds.upsert_pages(stream, compile_, f"{at}/out", f"{at}/checkpoint", buckets=8).awaitTermination()
    return folds.read_upserted(spark, f"{at}/out").select("page_id", "version", F.regexp_replace("html", ' id="[^"]*"', "").alias("heading"))


@query("""SELECT 'c' || (p_size % 7) || '/part-' || p_partkey || '.html' AS file, md5('<html><head><title>' || p_name || ' & co' || '</title><meta name="identifier" content="part-' || p_partkey || '"></head><body><p>' || p_type || '</p></body></html>') AS digest FROM
  (SELECT p_partkey, p_size, replace(p_name, '&', '&amp;') AS p_name, p_type FROM part)""".replace("' & co'", "' &amp; co'"))
def pages_bundled(spark, sf_dir):
    """Pages written as files, one each, and the files read back; a first bundle with other files is replaced."""
    from foliolens.operators.lineage import folder
    from foliolens.sources import bundles

    part, path = table(spark, sf_dir, "part"), folder(spark, "bundle")
    targets = part.select(F.concat(F.lit("c"), (F.col("p_size") % 7).cast("string")).alias("chapter"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("slug"), F.concat("p_name", F.lit(" & co")).alias("title"), F.concat(F.lit("<p>"), "p_type", F.lit("</p>")).alias("html"))
    bundles.write_pages(targets.withColumn("slug", F.concat(F.lit("old-"), "slug")), path)
    bundles.write_pages(targets, path)
    return bundles.read_pages(spark, path).select(F.concat_ws("/", "chapter", "name").alias("file"), F.md5("content").alias("digest"))
