"""Audits of alternative text and colour contrast, and of human answers. First matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.functions import color as C
from foliolens.functions import text as T
from foliolens.operators import rules

# Patterns of the alternative-text rules.
URL_LIKE = r"(?i)^(https?://|www\.|//)\S+$"
FILE_NAME = r"(?i)^[\w\-.,'’()\[\]{}~ &+%#@!]{1,120}\.(jpe?g|png|gif|bmp|webp|svgz?|tiff?|ico|avif|heic)$"
PLACEHOLDER = r"(?i)^(image|images|picture|pic|photo|photograph|graphic|graphics|img|figure|screen ?shot|untitled|placeholder|blank|spacer|divider|banner|thumbnail|icon|logo)\s*\d*$"
REDUNDANT = r"(?i)^\s*(image|images|picture|photo|photograph|graphic|pic|img)(?:\s+(?:of|showing|shows|depicting|that shows)\b|\s*:\s*)"
GENERATED_MARK = r"(?i)\bdescriptions?\s+automatically\s+generated\b"
GENERATED_STEM = r"(?i)^\s*(?:graphical user interface|a picture containing|an?\s+(?:screenshot|close[-\s]?up)\s+of)\b"
GENERATED_LIST = r"(?i)^(?:text|chart|diagram|table|icon|logo|shape|map|application|website|qr code|graphical user interface)(?:,\s*[a-z][a-z ]{1,20})+$"
STEM_MOST = 45


def alt_issue(alt, presentation=None) -> Column:
    """The id of an alternative text's first defect; null for none, for missing and for empty text."""
    text = F.trim(T._col(alt))
    length = T.utf16_length(text)
    generated = text.rlike(GENERATED_MARK) | text.rlike(GENERATED_LIST) | text.rlike(GENERATED_STEM) & (length <= STEM_MOST)
    found = (
        F.when(text.isNull() | (text == ""), None).when(length > rules.MOST_ALT, "alt-text-too-long").when(text.rlike(URL_LIKE), "alt-text-url").when(text.rlike(FILE_NAME), "alt-text-filename")
        .when(text.rlike(PLACEHOLDER), "alt-text-placeholder").when(text.rlike(REDUNDANT), "alt-text-redundant").when(generated, "alt-text-machine-generated").when(length < rules.LEAST_ALT, "alt-text-too-short")
    )
    return found if presentation is None else F.when(~F.coalesce(T._col(presentation), F.lit(False)), found)


def alt_severity(issue) -> Column:
    i = T._col(issue)
    return F.when(i.isin("alt-text-too-long", "alt-text-url", "alt-text-filename", "alt-text-placeholder"), "error").when(i == "alt-text-redundant", "warning").when(i.isNotNull(), "alert")


def alt_quality(images: DataFrame, alt: str = "alt", presentation: str | None = None) -> DataFrame:
    """images with (issue, severity, category) of their alternative text; all null where nothing is wrong."""
    out = images.withColumn("issue", alt_issue(alt, presentation)).withColumn("severity", alt_severity("issue"))
    return out.withColumn("category", F.when(F.col("severity") == "error", "error").when(F.col("severity").isNotNull(), "alert"))


def contrast(df: DataFrame, fg: str = "fg", bg: str = "bg", size: str = "size") -> DataFrame:
    """df with the contrast ratio (two places) and level of two colours; null where a colour is invalid."""
    raw = C.contrast_ratio(C.parse_color(fg), C.parse_color(bg))
    return df.withColumn("_raw", raw).withColumn("ratio", F.round("_raw", 2)).withColumn("level", F.when(F.col("_raw").isNotNull(), C.level(F.col("_raw"), size))).drop("_raw")


def gradient_contrast(runs: DataFrame, key: str, fg: str, stops: str, size: str = "size", samples: int = 9) -> DataFrame:
    """Per run the worst contrast over a gradient: colours between neighbouring stops, sampled evenly, flattened over white."""
    pairs = runs.select(key, fg, size, F.posexplode(F.arrays_zip(F.slice(stops, 1, F.size(stops) - 1).alias("a"), F.slice(stops, 2, F.size(stops) - 1).alias("b"))).alias("pair", "s"))
    # Colours are read before the samples are made of them, once a pair.
    read = pairs.select(key, size, C.parse_color(fg).alias("front"), C.parse_color(F.col("s.a")).alias("x"), C.parse_color(F.col("s.b")).alias("y"))
    parsed = read.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("i"))
    t = F.col("i") / samples
    between = C.rgba(*[F.col("x")[k] + (F.col("y")[k] - F.col("x")[k]) * t for k in ("r", "g", "b", "a")])
    flat = C.over(between, C.rgba(F.lit(255), F.lit(255), F.lit(255), F.lit(1)))
    front = C.over(F.col("front"), flat)
    worst = parsed.withColumn("raw", C.contrast_ratio(front, flat)).groupBy(key, size).agg(F.min("raw").alias("raw"))
    return worst.select(key, F.round("raw", 2).alias("ratio"), (F.col("raw") >= F.when(F.col(size) == "large", C.AA_LARGE).otherwise(C.AA_NORMAL)).alias("passes"))


def gradient_stops(css) -> Column:
    """The colours of a linear or radial gradient in order; null for others and for gradients without two colours."""
    inner = F.regexp_extract(F.lower(T._col(css)), r"^(?:repeating-)?(?:linear|radial)-gradient\((.*)\)$", 1)
    found = F.filter(F.regexp_extract_all(inner, F.lit(r"#[0-9a-f]{3,8}\b|rgba?\([^)]*\)|[a-z]+(?:-[a-z]+)*"), F.lit(0)), lambda w: C.parse_color(w).isNotNull())
    return F.when(F.size(found) >= 2, found)


def gradient_worst(fg, css, samples: int = 9) -> Column:
    """The least contrast of a colour with a gradient: colours between neighbouring stops, sampled evenly, flattened over white."""
    white = C.rgba(F.lit(255), F.lit(255), F.lit(255), F.lit(1))
    front = C.parse_color(fg)
    between = lambda x, y, t: C.rgba(*[x[k] + (y[k] - x[k]) * t for k in ("r", "g", "b", "a")])
    ratio = lambda flat: C.contrast_ratio(C.over(front, flat), flat)
    steps = F.sequence(F.lit(0), F.lit(samples))

    def worst(stops: Column) -> Column:
        pairs = F.zip_with(F.slice(stops, 1, F.size(stops) - 1), F.slice(stops, 2, F.size(stops) - 1), lambda x, y: F.array_min(F.transform(steps, lambda i: C.let(C.over(between(x, y, i / samples), white), ratio))))
        return F.array_min(pairs)

    return C.let(F.transform(gradient_stops(css), C.parse_color), worst)


def contrast_issues(runs: DataFrame) -> DataFrame:
    """runs (fg, bg_kind, layers, swatches, size, and gradient_css where there are gradients) with a severity: layers and gradients fail as blockers, sampled images as warnings, what can't be computed alerts."""
    front = C.parse_color("fg")
    solid = C.composite("layers")
    ratio = C.contrast_ratio(C.over(front, solid), solid)
    over_image = F.array_min(F.transform("swatches", lambda s: C.contrast_ratio(C.over(front, C.over(C.parse_color(s), C.rgba(F.lit(255), F.lit(255), F.lit(255), F.lit(1)))), C.over(C.parse_color(s), C.rgba(F.lit(255), F.lit(255), F.lit(255), F.lit(1))))))
    least = F.when(F.col("size") == "large", C.AA_LARGE).otherwise(C.AA_NORMAL)
    worst = gradient_worst("fg", "gradient_css") if "gradient_css" in runs.columns else F.lit(None).cast("double")
    severity = (
        F.when(front.isNull() | (front["a"] == 0), "alert").when(F.col("bg_kind") == "layers", F.when(ratio < least, "blocker"))
        .when(F.col("bg_kind") == "gradient", F.when(F.col("_worst").isNull(), "alert").when(F.col("_worst") < least, "blocker"))
        .when(F.col("bg_kind") == "image", F.when(F.coalesce(F.size("swatches"), F.lit(0)) <= 0, "alert").when(over_image < least, "warning")).otherwise("alert")
    )
    return runs.withColumn("_worst", worst).withColumn("severity", severity).drop("_worst")


def better_ink(bg, inks: tuple[str, str] = ("#000000", "#ffffff")) -> Column:
    """Of two inks the one with more contrast on a background."""
    first, second = (C.contrast_ratio(C.parse_color(F.lit(i)), C.parse_color(bg)) for i in inks)
    return F.when(first >= second, inks[0]).otherwise(inks[1])


def normalize_contrast(runs: DataFrame, inks: tuple[str, str] = ("#2d3b45", "#ffffff")) -> DataFrame:
    """runs (fg, bg_kind, layers, size) over colour layers with the `ink` that takes the place of a colour below the minimum: the one of two with more contrast; null where the colour may stay or can't be judged."""
    solid = C.composite("layers")
    marked = runs.withColumn("_solid", F.when(F.col("bg_kind") == "layers", solid)).withColumn("_raw", C.contrast_ratio(C.over(C.parse_color("fg"), F.col("_solid")), F.col("_solid")))
    dark, light = (C.contrast_ratio(C.parse_color(F.lit(i)), F.col("_solid")) for i in inks)
    least = F.when(F.col("size") == "large", C.AA_LARGE).otherwise(C.AA_NORMAL)
    return marked.withColumn("ink", F.when(F.col("_raw") < least, F.when(dark >= light, inks[0]).otherwise(inks[1]))).drop("_solid", "_raw")


def validate_answers(answers: DataFrame) -> DataFrame:
    """answers (type, text) with a verdict: refused and why, or accepted and with which note."""
    text = F.trim(F.coalesce("text", F.lit("")))
    issue = alt_issue("text")
    verdict = (
        F.when(F.col("type") != "alt", "accepted").when(text == "", "refused:blank").when(T.utf16_length(text) > rules.MOST_ALT, "refused:too-long")
        .when(alt_severity(issue) == "error", F.concat(F.lit("refused:"), issue)).when(text.rlike(r"(?i)^(figure|fig\.?)\s*\d"), "accepted:figure-label").when(issue.isNotNull(), F.concat(F.lit("accepted:"), issue)).otherwise("accepted")
    )
    return answers.withColumn("verdict", verdict)


def publishable(sections: DataFrame, queue: DataFrame, chapter: str = "chapter_id", section: str = "section_id") -> DataFrame:
    """Per chapter: publishable if no item is queued and every section compiled and has a verdict without blockers."""
    good = F.bool_and(F.col("error").isNull() & F.coalesce(F.col("blockers") == 0, F.lit(False)))
    open_ = queue.groupBy(chapter).agg(F.count(F.lit(1)).alias("queued"))
    out = sections.groupBy(chapter).agg(good.alias("clean")).join(open_, chapter, "left")
    return out.select(chapter, F.coalesce("queued", F.lit(0)).alias("queued"), (F.col("clean") & F.col("queued").isNull()).alias("publishable"))
