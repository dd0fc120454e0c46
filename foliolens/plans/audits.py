"""Queries of the audits, on images and colours derived from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.functions import color as C
from foliolens.functions import text as T
from foliolens.operators import audits as A
from foliolens.plans.registry import query, table

_ALT = """CASE p_partkey % 10 WHEN 0 THEN p_name || '.jpg' WHEN 1 THEN 'Image of ' || p_name WHEN 2 THEN 'https://x.example/' || p_partkey WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'Icon 3'
  WHEN 6 THEN repeat(p_name || ' ', 8) WHEN 7 THEN substr(p_name, 1, 4) WHEN 8 THEN 'Chart, bar chart' ELSE p_name END"""
_ISSUE = r"""CASE WHEN alt IS NULL OR trim(alt) = '' THEN NULL WHEN length(trim(alt)) > 120 THEN 'alt-text-too-long' WHEN regexp_matches(trim(alt), '(?i)^(https?://|www\.|//)\S+$') THEN 'alt-text-url'
  WHEN regexp_matches(trim(alt), '(?i)^[\w .-]{1,120}\.(jpe?g|png|gif)$') THEN 'alt-text-filename' WHEN regexp_matches(trim(alt), '(?i)^(image|icon|logo|photo|picture|blank)\s*\d*$') THEN 'alt-text-placeholder'
  WHEN regexp_matches(trim(alt), '(?i)^image of\b') THEN 'alt-text-redundant' WHEN regexp_matches(trim(alt), '(?i)^(chart|table|map|logo|icon|text)(, *[a-z][a-z ]{1,20})+$') THEN 'alt-text-machine-generated'
  WHEN length(trim(alt)) < 6 THEN 'alt-text-too-short' END"""
_SEVERITY = "CASE WHEN issue IN ('alt-text-too-long', 'alt-text-url', 'alt-text-filename', 'alt-text-placeholder') THEN 'error' WHEN issue = 'alt-text-redundant' THEN 'warning' WHEN issue IS NOT NULL THEN 'alert' END"
_IMAGES = f"WITH img AS (SELECT p_partkey, {_ALT} AS alt FROM part), judged AS (SELECT *, {_ISSUE} AS issue FROM img), sev AS (SELECT *, {_SEVERITY} AS severity FROM judged) "


def images(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_ALT).alias("alt"))


@query(_IMAGES + "SELECT p_partkey, issue, severity, CASE WHEN severity = 'error' THEN 'error' WHEN severity IS NOT NULL THEN 'alert' END AS category FROM sev")
def alt_quality(spark, sf_dir):
    return A.alt_quality(images(spark, sf_dir)).drop("alt")


@query(_IMAGES + "SELECT issue, severity, count(*) AS n FROM sev GROUP BY issue, severity")
def alt_issue_counts(spark, sf_dir):
    return A.alt_quality(images(spark, sf_dir)).groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    _IMAGES + """SELECT p_partkey, CASE WHEN alt IS NULL OR length(alt) <= 120 THEN alt WHEN length(trim(regexp_replace(alt, '\\s+', ' ', 'g'))) <= 120 THEN trim(regexp_replace(alt, '\\s+', ' ', 'g'))
  ELSE rtrim(regexp_extract(substr(trim(regexp_replace(alt, '\\s+', ' ', 'g')), 1, 119), '^(.+) ', 1)) || '…' END AS fitted FROM img"""
)
def alt_fitted(spark, sf_dir):
    return images(spark, sf_dir).select("p_partkey", T.fit_alt("alt").alias("fitted"))


@query(_IMAGES + "SELECT p_partkey, CASE WHEN trim(coalesce(alt, '')) = '' THEN 'refused:blank' WHEN length(trim(alt)) > 120 THEN 'refused:too-long' WHEN severity = 'error' THEN 'refused:' || issue WHEN issue IS NOT NULL THEN 'accepted:' || issue ELSE 'accepted' END AS verdict FROM sev")
def answer_validation(spark, sf_dir):
    answers = images(spark, sf_dir).withColumnRenamed("alt", "text").withColumn("type", F.lit("alt"))
    return A.validate_answers(answers).select("p_partkey", "verdict")


_K = "p_partkey"
_FG = f"'rgb(' || ({_K} * 37 % 256) || ', ' || ({_K} * 59 % 256) || ', ' || ({_K} * 83 % 256) || ')'"
_BG = f"CASE {_K} % 4 WHEN 0 THEN '#fff' WHEN 1 THEN '#1a2B3c' WHEN 2 THEN 'yellow' ELSE 'nope' END"
_LIN = "CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"


def _lum(r: str, g: str, b: str) -> str:
    return f"(0.2126 * {_LIN.format(c=r)} + 0.7152 * {_LIN.format(c=g)} + 0.0722 * {_LIN.format(c=b)})"


_COLORS = f"""WITH c AS (SELECT {_K}, {_FG} AS fg, {_BG} AS bg, CASE WHEN p_size >= 24 THEN 'large' ELSE 'normal' END AS size, ({_K} * 37 % 256)::DOUBLE AS r, ({_K} * 59 % 256)::DOUBLE AS g, ({_K} * 83 % 256)::DOUBLE AS b,
  CASE {_K} % 4 WHEN 0 THEN 255.0 WHEN 1 THEN 26.0 WHEN 2 THEN 255.0 END::DOUBLE AS br, CASE {_K} % 4 WHEN 0 THEN 255.0 WHEN 1 THEN 43.0 WHEN 2 THEN 255.0 END::DOUBLE AS bg_, CASE {_K} % 4 WHEN 0 THEN 255.0 WHEN 1 THEN 60.0 WHEN 2 THEN 0.0 END::DOUBLE AS bb FROM part),
l AS (SELECT *, {_lum('r', 'g', 'b')} AS lf, {_lum('br', 'bg_', 'bb')} AS lb FROM c),
q AS (SELECT *, CASE WHEN lb IS NOT NULL THEN (greatest(lf, lb) + 0.05) / (least(lf, lb) + 0.05) END AS raw FROM l) """


def colors(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_FG).alias("fg"), F.expr(_BG).alias("bg"), C.size_class("p_size", F.lit(400)).alias("size"))


@query(_COLORS + "SELECT p_partkey, round(raw, 2) AS ratio, CASE WHEN raw >= CASE size WHEN 'large' THEN 4.5 ELSE 7 END THEN 'AAA' WHEN raw >= CASE size WHEN 'large' THEN 3 ELSE 4.5 END THEN 'AA' WHEN raw IS NOT NULL THEN 'fail' END AS level FROM q")
def color_contrast(spark, sf_dir):
    return A.contrast(colors(spark, sf_dir)).select("p_partkey", "ratio", "level")


@query(_COLORS + "SELECT p_partkey, r, g, b, br, bg_ AS bgreen, bb FROM c")
def parsed_colors(spark, sf_dir):
    f, b = C.parse_color("fg"), C.parse_color("bg")
    return colors(spark, sf_dir).select("p_partkey", f["r"].alias("r"), f["g"].alias("g"), f["b"].alias("b"), b["r"].alias("br"), b["g"].alias("bgreen"), b["b"].alias("bb"))


@query(
    "WITH c AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 59 % 256 AS g, p_partkey * 83 % 256 AS b FROM part) "
    "SELECT p_partkey, floor(r * 0.5 + floor(200 * 0.25 + 255 * 0.75 + 0.5) * 0.5 + 0.5)::DOUBLE AS r, floor(g * 0.5 + floor(100 * 0.25 + 255 * 0.75 + 0.5) * 0.5 + 0.5)::DOUBLE AS g, floor(b * 0.5 + floor(0 * 0.25 + 255 * 0.75 + 0.5) * 0.5 + 0.5)::DOUBLE AS b FROM c"
)
def composited_layers(spark, sf_dir):
    top = F.concat(F.lit("rgba("), F.expr("(p_partkey * 37 % 256) || ', ' || (p_partkey * 59 % 256) || ', ' || (p_partkey * 83 % 256)"), F.lit(", 0.5)"))
    out = C.composite(F.array(top, F.lit("not a color"), F.lit("rgb(200 100 0 / 25%)")))
    return table(spark, sf_dir, "part").withColumn("c", out).select("p_partkey", "c.r", "c.g", "c.b")


@query(_COLORS + "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN (CASE WHEN (1.05 / (lf + 0.05)) < CASE size WHEN 'large' THEN 3 ELSE 4.5 END THEN 'blocker' END) WHEN raw < CASE size WHEN 'large' THEN 3 ELSE 4.5 END THEN 'blocker' END AS severity FROM q")
def contrast_adjudication(spark, sf_dir):
    runs = colors(spark, sf_dir).select("p_partkey", "fg", "size", F.lit("layers").alias("bg_kind"), F.array("bg").alias("layers"), F.array().cast("array<string>").alias("swatches"))
    return A.contrast_issues(runs).select("p_partkey", "severity")


def _flat(i: str) -> str:
    return f"floor({i} + 0.5)"


@query(
    f"""WITH s AS (SELECT p_partkey, CASE WHEN p_size >= 24 THEN 'large' ELSE 'normal' END AS size, unnest(range(10)) AS i FROM part), c AS (
  SELECT p_partkey, size, floor(255 * (i / 9.0) + 0.5)::DOUBLE AS v, (p_partkey * 37 % 256)::DOUBLE AS r, (p_partkey * 59 % 256)::DOUBLE AS g, (p_partkey * 83 % 256)::DOUBLE AS b FROM s),
l AS (SELECT p_partkey, size, {_lum('r', 'g', 'b')} AS x, {_lum('v', 'v', 'v')} AS y FROM c), m AS (SELECT p_partkey, size, min((greatest(x, y) + 0.05) / (least(x, y) + 0.05)) AS raw FROM l GROUP BY ALL)
SELECT p_partkey, round(raw, 2) AS ratio, raw >= CASE size WHEN 'large' THEN 3 ELSE 4.5 END AS passes FROM m"""
)
def gradient_contrast(spark, sf_dir):
    runs = colors(spark, sf_dir).withColumn("stops", F.array(F.lit("#000000"), F.lit("#ffffff")))
    return A.gradient_contrast(runs, "p_partkey", "fg", "stops")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#000000' WHEN 1 THEN '#ffffff' WHEN 2 THEN '#000000' ELSE '#ffffff' END AS ink FROM part")
def contrast_inks(spark, sf_dir):
    return colors(spark, sf_dir).select("p_partkey", A.better_ink("bg").alias("ink"))


@query(_IMAGES + "SELECT count(*) AS images, count(*) FILTER (regexp_matches(lower(alt), '(^|[^a-z])(man|woman|people|white|black)([^a-z]|$)')) AS with_people, count(*) FILTER (trim(alt) = '') AS decorative, count(*) FILTER (alt IS NULL) AS no_alt FROM img")
def image_summary(spark, sf_dir):
    from foliolens.operators import chapters as H

    inventory = H.image_inventory(images(spark, sf_dir).withColumn("caption", F.lit(None).cast("string")), ("man", "woman", "people", "white", "black"))
    return H.image_summary(inventory)
