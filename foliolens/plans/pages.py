"""Queries over the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import compiling
from foliolens.operators import pages as P
from foliolens.operators import rules
from foliolens.plans.registry import query, table

_TOKENS = r"""
WITH cut AS (
  SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[!?][^>]*>?|</?[a-zA-Z][a-zA-Z0-9:-]*(?:"[^"]*"|''[^'']*''|[^"''>])*>|[^<]+|<') AS t FROM pages),
every AS (SELECT page_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS raw FROM cut),
named AS (
  SELECT page_id, pos, raw, lower(regexp_extract(raw, '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) AS tg FROM every WHERE NOT regexp_matches(raw, '^<[!?]')),
tok AS (
  SELECT page_id, pos, raw, CASE WHEN tg = '' THEN NULL ELSE tg END AS tag,
    CASE WHEN tg = '' THEN 'text' WHEN tg IN ('script', 'style') AND raw LIKE '<%<%' THEN 'raw' WHEN raw LIKE '</%' THEN 'close' ELSE 'open' END AS kind FROM named),
shifted AS (
  SELECT page_id, pos, raw, kind, CASE WHEN max(CASE WHEN tag = 'h1' AND kind = 'open' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) = 1 AND regexp_matches(tag, '^h[1-6]$')
    THEN 'h' || least(6, substr(tag, 2, 1)::INT + 1) ELSE tag END AS tag FROM tok),
heads AS (SELECT page_id, pos, substr(tag, 2, 1)::INT AS level, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS n FROM tok WHERE kind = 'open' AND regexp_matches(tag, '^h[1-6]$')),
nxt AS (SELECT page_id, pos, raw, kind, tag, lead(CASE WHEN kind = 'text' THEN raw END) OVER (PARTITION BY page_id ORDER BY pos) AS after FROM tok),
lnk AS (
  SELECT page_id, pos, nullif(regexp_extract(raw, 'href="([^"]*)"', 1), '') AS href,
    trim(regexp_replace(replace(replace(replace(replace(coalesce(after, ''), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM nxt WHERE kind = 'open' AND tag = 'a')
"""
_REMOVED = "SELECT page_id, tag, min(pos) AS first_pos FROM shifted WHERE kind = 'open' AND tag IN (" + ", ".join(f"'{t}'" for t in rules.SEMANTIC_TAGS if t not in rules.ALLOWED_TAGS) + ") GROUP BY page_id, tag"
_ISSUES = """
SELECT page_id, 'page-has-heading-one' AS id, 'moderate' AS impact, pos FROM heads WHERE level = 1
UNION ALL SELECT page_id, 'heading-order', 'moderate', pos FROM (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM heads) WHERE level > before + 1
UNION ALL SELECT page_id, 'link-name', 'serious', pos FROM lnk WHERE text = ''
UNION ALL SELECT page_id, 'image-alt', 'critical', pos FROM tok WHERE kind = 'open' AND tag = 'img' AND raw NOT LIKE '% alt%'
"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tokenize(table(spark, sf_dir, "pages"), "page_id")


@query(_TOKENS + "SELECT page_id, pos, kind, tag, length(raw)::INT AS n FROM tok")
def page_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("page_id", "pos", "kind", "tag", F.length("raw").alias("n"))


@query(_TOKENS + "SELECT page_id, md5(string_agg(raw, '' ORDER BY pos)) AS digest FROM tok GROUP BY page_id")
def page_serialized(spark, sf_dir):
    return P.serialize(_tokens(spark, sf_dir), "page_id").select("page_id", F.md5("html").alias("digest"))


@query(_TOKENS + "SELECT page_id, pos, replace(replace(replace(replace(replace(raw, '&quot;', chr(34)), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS decoded FROM tok WHERE kind = 'text' AND raw LIKE '%&%'")
def page_entities(spark, sf_dir):
    return _tokens(spark, sf_dir).filter("kind = 'text'").filter(F.col("text").contains("&")).select("page_id", "pos", T.decode_entities("text").alias("decoded"))


@query(_TOKENS + "SELECT page_id, count(*) AS n_kept, md5(string_agg(pos::VARCHAR, ',' ORDER BY pos)) AS places FROM tok WHERE kind = 'text' OR (kind <> 'raw' AND tag IN (" + ", ".join(f"'{t}'" for t in rules.ALLOWED_TAGS) + ")) GROUP BY page_id")
def page_allowed_tags(spark, sf_dir):
    kept = P.filter_tags(_tokens(spark, sf_dir))
    return kept.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_kept"), F.md5(F.array_join(F.array_sort(F.collect_list("pos")), ",")).alias("places"))


@query(_TOKENS + "SELECT page_id, tag, count(*) AS n FROM shifted WHERE kind = 'open' AND regexp_matches(tag, '^h[1-6]$') GROUP BY page_id, tag")
def page_heading_shift(spark, sf_dir):
    return P.shift_headings(_tokens(spark, sf_dir), "page_id").filter("kind = 'open'").filter(F.col("tag").rlike("^h[1-6]$")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(_TOKENS + _REMOVED)
def page_removed_semantic(spark, sf_dir):
    return P.removed_semantic(P.shift_headings(_tokens(spark, sf_dir), "page_id"), "page_id")


@query(_TOKENS + "SELECT page_id, count(*) FILTER (regexp_matches(tag, '^h[1-6]$')) AS headings, count(*) FILTER (tag = 'table') AS tables, count(*) FILTER (tag = 'img') AS images, count(*) FILTER (tag = 'a') AS links, count(*) FILTER (tag = 'math') AS equations, count(*) FILTER (tag = 'aside' AND contains(raw, 'role=\"note\"')) AS notes, count(*) FILTER (tag = 'img' AND NOT contains(raw, '$IMS-CC-FILEBASE$')) AS unavailable FROM (SELECT page_id, raw, CASE WHEN kind = 'open' THEN tag END AS tag FROM tok) GROUP BY page_id")
def page_content_counts(spark, sf_dir):
    return P.content_counts(_tokens(spark, sf_dir), "page_id")


@query(_TOKENS + ", w AS (SELECT *, least(6, greatest(2, level - min(level) OVER (PARTITION BY page_id) + 2)) AS wanted FROM heads) SELECT page_id, pos, level, n, (n + least(1, min(wanted - n) OVER (PARTITION BY page_id ORDER BY n)))::INT AS new_level FROM w")
def page_relevelled_headings(spark, sf_dir):
    return P.relevel(P.headings(_tokens(spark, sf_dir), "page_id"), "page_id")


@query(_TOKENS + "SELECT page_id, CASE tag WHEN 'b' THEN 'strong' WHEN 'i' THEN 'em' ELSE tag END AS tag, count(*) AS n FROM tok WHERE kind = 'open' AND tag <> 'u' GROUP BY 1, 2")
def page_text_semantics(spark, sf_dir):
    return P.text_semantics(_tokens(spark, sf_dir)).filter("kind = 'open'").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(_TOKENS + "SELECT page_id, pos, href, text FROM lnk")
def page_links(spark, sf_dir):
    return P.links(_tokens(spark, sf_dir), "page_id")


@query(_TOKENS + """, h AS (SELECT l.page_id, l.pos, l.href, CASE WHEN l.href LIKE '/%' THEN regexp_extract(p.url, '^([a-z]+://[^/?#]*)', 1) || l.href ELSE l.href END AS link, lower(regexp_extract(p.url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM lnk l JOIN pages p USING (page_id) WHERE l.href IS NOT NULL),
  u AS (SELECT *, link LIKE 'http://%' AND lower(regexp_extract(link, '^[a-z]+://([^/?#:]*)', 1)) = host AS up FROM h) SELECT page_id, pos, CASE WHEN up THEN 'https' || substr(link, 5) ELSE link END AS link, (CASE WHEN up OR link <> href THEN 1 ELSE 0 END)::INT AS rewritten, (CASE WHEN up THEN 1 ELSE 0 END)::INT AS upgraded FROM u""")
def page_absolute_links(spark, sf_dir):
    tokens = _tokens(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    links = P.absolute_urls(tokens, "url").filter("kind = 'open' AND tag = 'a'")
    return links.select("page_id", "pos", F.get(F.filter("attrs", lambda a: a["name"] == "href"), 0)["value"].alias("link"), "rewritten", "upgraded").filter("link IS NOT NULL")


@query(_TOKENS + _ISSUES)
def page_structural_issues(spark, sf_dir):
    return P.structural_issues(_tokens(spark, sf_dir), "page_id")


@query(
    _TOKENS + ", iss AS (" + _ISSUES + "), rem AS (" + _REMOVED + """),
sev AS (SELECT page_id, CASE impact WHEN 'critical' THEN 'blocker' WHEN 'serious' THEN 'error' WHEN 'moderate' THEN 'warning' ELSE 'advisory' END AS severity FROM iss
  UNION ALL SELECT page_id, 'blocker' FROM rem),
c AS (SELECT page_id, count(*) FILTER (severity IN ('blocker', 'error')) AS blockers, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity IN ('alert', 'advisory')) AS needs_review FROM sev GROUP BY page_id)
SELECT p.page_id, coalesce(blockers, 0) AS blockers, coalesce(warnings, 0) AS warnings, coalesce(needs_review, 0) AS needs_review, coalesce(blockers, 0) > 0 AS badge_withheld FROM pages p LEFT JOIN c USING (page_id)"""
)
def page_gate(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    tokens = P.tokenize(pages, "page_id")
    return P.page_gate(pages, tokens, "page_id")


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS normal, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, regexp_matches(url, '^https://') AS is_content FROM pages")
def page_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.normalize_url("url").alias("normal"), T.host_of("url").alias("host"), T.is_content_link("url").alias("is_content"))


@query("SELECT host, count(*) AS pages, count(*) FILTER (regexp_matches(url, '^https?://') AND host LIKE '%.%') AS public FROM (SELECT url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM pages) GROUP BY host")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumn("host", T.host_of("url")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(T.is_public_url("url")).alias("public"))


_ADDED = "CASE page_id % 5 WHEN 0 THEN 'javascript:go()' WHEN 1 THEN 'https://a.example/' WHEN 2 THEN 'MAILTO:a@b.c' WHEN 3 THEN 'data:text/html,x' ELSE '/p' END"


@query(f"SELECT page_id, {_ADDED} AS value, page_id % 5 IN (0, 3) AS is_stripped, CASE WHEN page_id % 3 = 1 THEN '_self' ELSE '_blank' END AS target FROM pages")
def page_address_policy(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("a").alias("tag"), F.lit("href").alias("name"), F.expr(_ADDED).alias("value"))
    target = pages.select("page_id", F.lit(0).alias("pos"), "tag", F.lit(0).alias("ord"), F.lit("target").alias("name"), F.when(F.col("page_id") % 3 == 0, "_BLANK").when(F.col("page_id") % 3 == 1, " _Self ").otherwise("window").alias("value"))
    kept = P.filter_attributes(target, "page_id").select("page_id", F.col("value").alias("target"))
    return pages.select("page_id", "value", (P.url_verdict() == "stripped").alias("is_stripped")).join(kept, "page_id")


_STYLE = """list_aggregate(list_filter(['color:rgb(' || (p_partkey % 256) || ', 0, 0)', 'position: fixed', 'MARGIN-left :  ' || p_size || 'px', 'background: url(' || CASE WHEN p_partkey % 3 = 0 THEN 'javascript:x' ELSE 'https://h/' || p_name || ';v' END || ')',
  CASE WHEN p_size % 2 = 0 THEN 'z-index: 9' END, 'behavior: url(''a;b'')', 'width:', p_type], lambda x: x IS NOT NULL), 'string_agg', ';')"""


@query(f"""WITH s AS (SELECT p_partkey, '<p style="' || replace({_STYLE}, '"', '') || '">' || p_name || '</p>' AS html, p_size, p_name FROM part)
SELECT p_partkey, '<p style="color: rgb(' || (p_partkey % 256) || ', 0, 0); margin-left: ' || p_size || 'px' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '; background: url(https://h/' || p_name || ';v)' END || '">' || p_name || '</p>' AS html FROM s""")
def page_style_policy(spark, sf_dir):
    """Styles through the whole sanitizer: pages made of parts."""
    k = F.col("p_partkey")
    style = F.concat_ws(
        ";", F.concat(F.lit("color:rgb("), (k % 256).cast("string"), F.lit(", 0, 0)")), F.lit("position: fixed"), F.concat(F.lit("MARGIN-left :  "), F.col("p_size").cast("string"), F.lit("px")),
        F.concat(F.lit("background: url("), F.when(k % 3 == 0, F.lit("javascript:x")).otherwise(F.concat(F.lit("https://h/"), "p_name", F.lit(";v"))), F.lit(")")), F.when(F.col("p_size") % 2 == 0, F.lit("z-index: 9")), F.lit("behavior: url('a;b')"), F.lit("width:"), "p_type",
    )
    made = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('<p style="'), style, F.lit('">'), "p_name", F.lit("</p>")).alias("html"))
    return P.sanitize(P.tokenize(made, "p_partkey"), "p_partkey")


@query()
def page_elements(spark, sf_dir):
    return P.elements(_tokens(spark, sf_dir), "page_id", whole=True)


@query()
def page_text_blocks(spark, sf_dir):
    return P.text_blocks(_tokens(spark, sf_dir), "page_id", whole=True)


@query()
def page_main_content(spark, sf_dir):
    return P.main_content(_tokens(spark, sf_dir), "page_id").withColumn("html", F.md5("html"))


@query()
def page_without_chrome(spark, sf_dir):
    return P.serialize(P.strip_chrome(_tokens(spark, sf_dir), "page_id"), "page_id")


@query(_TOKENS + """, k AS (SELECT page_id, pos, raw, kind, tag, CASE WHEN tag = 'a' AND kind = 'open' THEN regexp_extract(raw, 'href="([^"]*)"', 1) END AS href, CASE WHEN kind = 'open' THEN regexp_extract(raw, 'class="([^"]*)"', 1) END AS cls,
    CASE WHEN kind = 'open' THEN regexp_extract(raw, 'lang="([^"]*)"', 1) END AS lng FROM shifted WHERE kind = 'text' OR (kind <> 'raw' AND tag IN (""" + ", ".join(f"'{t}'" for t in rules.ALLOWED_TAGS) + """)))
  SELECT page_id, md5(string_agg(CASE kind WHEN 'text' THEN raw WHEN 'close' THEN '</' || tag || '>' ELSE '<' || tag || CASE WHEN href <> '' THEN ' href="' || href || '"' ELSE '' END || CASE WHEN cls <> '' THEN ' class="' || cls || '"' ELSE '' END
    || CASE WHEN lng <> '' THEN ' lang="' || lng || '"' ELSE '' END || '>' END, '' ORDER BY pos)) AS digest FROM k GROUP BY page_id""")  # fmt: skip
def page_sanitized(spark, sf_dir):
    return P.sanitize(_tokens(spark, sf_dir), "page_id").select("page_id", F.md5("html").alias("digest"))


@query(_TOKENS + """, h AS (SELECT l.page_id, l.pos, CASE WHEN l.href LIKE '/%' THEN regexp_extract(p.url, '^([a-z]+://[^/?#]*)', 1) || l.href ELSE l.href END AS link, lower(regexp_extract(p.url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM lnk l JOIN pages p USING (page_id)),
  u AS (SELECT page_id, pos, CASE WHEN link LIKE 'http://%' AND lower(regexp_extract(link, '^[a-z]+://([^/?#:]*)', 1)) = host THEN 'https' || substr(link, 5) ELSE link END AS link FROM h),
  m AS (SELECT t.page_id, t.pos, raw, kind, CASE tag WHEN 'h1' THEN 'h2' WHEN 'b' THEN 'strong' ELSE tag END AS tag, link, CASE WHEN kind = 'open' THEN regexp_extract(raw, 'class="([^"]*)"', 1) END AS cls FROM tok t LEFT JOIN u ON u.page_id = t.page_id AND u.pos = t.pos),
  c AS (SELECT page_id, string_agg(CASE kind WHEN 'text' THEN raw WHEN 'close' THEN '</' || tag || '>' ELSE '<' || tag || CASE WHEN link <> '' THEN ' href="' || link || '"' ELSE '' END || CASE WHEN cls <> '' THEN ' class="' || cls || '"' ELSE '' END || '>' END, '' ORDER BY pos) AS html FROM m
    WHERE kind = 'text' OR (kind <> 'raw' AND tag IN (""" + ", ".join(f"'{t}'" for t in rules.ALLOWED_TAGS) + """)) GROUP BY page_id),
  b AS (SELECT page_id, count(*) AS n FROM lnk WHERE text = '' GROUP BY page_id)
  SELECT page_id, length(html)::INT AS n, md5(html) AS digest, NULL::VARCHAR AS error, coalesce(b.n, 0) AS blockers, 0::BIGINT AS warnings, 0::BIGINT AS needs_review, coalesce(b.n, 0) > 0 AS badge_withheld FROM c LEFT JOIN b USING (page_id)""")  # fmt: skip
def pages_compiled(spark, sf_dir):
    done = compiling.compile_pages(table(spark, sf_dir, "pages"), base="url")
    return done.sections.select("page_id", F.length("html").alias("n"), F.md5("html").alias("digest"), "error").join(done.gate, "page_id")


@query(_TOKENS + "SELECT page_id, 'text-semantics' AS step, count(*) AS n FROM tok WHERE kind = 'open' AND tag IN ('b', 'i', 'u') AND page_id IN (SELECT page_id FROM pages JOIN documents ON doc_id = page_id WHERE md5(html) < md5(text)) GROUP BY page_id")
def pages_recompiled_notes(spark, sf_dir):
    """Pages that changed: here those whose digest is below that of the document of the same number."""
    pages = table(spark, sf_dir, "pages")
    digests = pages.select("page_id", F.md5("html").alias("now")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.md5("text").alias("before")), "page_id")
    return compiling.recompile(pages, digests.filter("now < before")).notes.drop("message")


@query(_TOKENS + "SELECT page_id, " + ", ".join(f"count(*) FILTER (kind = 'open' AND tag = 'h{i}') AS h{i}" for i in range(1, 7)) + ", count(*) FILTER (kind = 'open' AND tag IN ('ul', 'ol')) AS lists, count(*) FILTER (kind = 'open' AND tag = 'li') AS items, count(*) FILTER (kind = 'open' AND tag = 'table') AS tables, count(*) FILTER (kind = 'open' AND tag = 'img') AS images, count(*) FILTER (kind = 'open' AND tag = 'a') AS links, sum(CASE WHEN kind = 'text' THEN length(raw) ELSE 0 END)::BIGINT AS chars FROM tok GROUP BY page_id")
def page_tallies(spark, sf_dir):
    return compiling.tally_blocks(_tokens(spark, sf_dir), "page_id")


@query(_TOKENS + """, r AS (SELECT page_id, 'active-removed' AS code, tag AS item FROM tok WHERE kind = 'raw' UNION ALL SELECT page_id, 'unsupported', tag FROM tok WHERE kind = 'open' AND tag IN ('html', 'head', 'meta', 'title', 'body')
  UNION ALL SELECT page_id, 'relative-link', 'a.href' FROM lnk WHERE href LIKE '/%') SELECT page_id, code, string_agg(DISTINCT item, ',' ORDER BY item) AS items, count(*) AS n FROM r GROUP BY page_id, code""")  # fmt: skip
def import_findings(spark, sf_dir):
    from foliolens.operators import chapters, imports

    tokens = _tokens(spark, sf_dir)
    removals = imports.sanitize_import(tokens, P.elements(tokens, "page_id"), "page_id")[1]
    return chapters.findings_rollup(removals, "page_id").withColumn("items", F.array_join("items", ","))


@query()
def import_sanitized(spark, sf_dir):
    from foliolens.operators import imports

    tokens = _tokens(spark, sf_dir)
    return imports.sanitize_import(tokens, P.elements(tokens, "page_id"), "page_id", "https://h.example/a/")[0]
