"""Paged documents and slide decks: reconciliation, summaries, findings, and restored reviews."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import text as T


def reconcile(slides: DataFrame, blocks: DataFrame, deck: str = "deck_id") -> DataFrame:
    """(deck, block_idx, slide, status): blocks in order given to slides.

    A block belongs to the slide whose remaining text, without white space, begins with the block's; notes are
    dropped; pictures are claimed by their origin. Blocks that fit nowhere are orphans, and what a slide still
    expects is missing. Claims depend on what came before, so decks are read whole and in order, many to a batch.
    """
    kind = dict(slides.dtypes)[deck]
    pictures = lambda: F.coalesce("picture_origins", F.array().cast("array<string>")).alias("pictures")
    wanted_rows = slides.select(deck, F.lit(0).alias("side"), F.col("number").cast("int").alias("at"), F.concat_ws("", "text_runs").alias("text"), F.col("notes").alias("notes"), pictures())
    given_rows = blocks.select(deck, F.lit(1).alias("side"), F.col("block_idx").cast("int").alias("at"), F.col("text").alias("text"), F.lit(None).cast("string").alias("notes"), pictures())
    rows = wanted_rows.unionByName(given_rows).repartition(deck).sortWithinPartitions(deck, "side", F.col("at").asc_nulls_last())

    def claim(b: dict, wanted: list[dict], at: int) -> tuple[int | None, str, int]:
        text, pictures = b["text"], b["pictures"]
        for ahead in range(at, len(wanted)):
            w = wanted[ahead]
            if pictures and any(p in w["pictures"] for p in pictures):
                w["pictures"] = [p for p in w["pictures"] if p not in pictures]
                return w["n"], "picture", at
            if text and w["text"].startswith(text):
                w["text"] = w["text"][len(text) :]
                return w["n"], "text", ahead
            if text and w["notes"].startswith(text):
                w["notes"] = w["notes"][len(text) :]
                return w["n"], "notes", at
        return None, "orphan", at

    def run(batches):
        squeeze = lambda s: "".join((s or "").split())
        current, wanted, at, key_type = None, [], 0, None
        found: list[list] = [[], [], [], []]

        def put(*row):
            for column, x in zip(found, row, strict=True):
                column.append(x)

        def missing():
            for column, status in (("text", "missing-text"), ("pictures", "missing-pictures")):
                for w in wanted:
                    if w[column]:
                        put(current[0], None, w["n"], status)

        def made():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (key_type, pa.int32(), pa.int32(), pa.string()), strict=True)], [deck, "block_idx", "slide", "status"])
            for column in found:
                column.clear()
            return out

        for batch in batches:
            key_type, lists = batch.schema.field(0).type, batch.column(5)
            ends, origins = lists.offsets.to_pylist(), lists.values.to_pylist()
            for i, (value, side, n, text, notes) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if current is None or current[0] != value:
                    missing()
                    current, wanted, at = (value,), [], 0
                shown = {"n": n, "text": squeeze(text), "pictures": origins[ends[i] : ends[i + 1]]}
                if side:
                    slide, status, at = claim(shown, wanted, at)
                    put(value, n, slide, status)
                else:
                    wanted.append({**shown, "notes": squeeze(notes)})
            yield made()
        if current is not None:
            missing()
            yield made()

    return rows.mapInArrow(run, f"`{deck}` {kind}, block_idx int, slide int, status string")


def page_summaries(slices: DataFrame, unmarked: DataFrame, doc: str) -> DataFrame:
    """(doc, page, text_length, images): marked pages (text) with pages that have no marker but images; their counts come off the marked page before them."""
    marked = slices.select(doc, "page", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")).alias("text_length"), F.col("images").cast("long").alias("images"), F.lit(False).alias("added"))
    added = unmarked.join(slices.select(doc, "page"), [doc, "page"], "left_anti").select(doc, "page", F.lit(0).alias("text_length"), F.col("images").cast("long").alias("images"), F.lit(True).alias("added"))
    every = marked.unionByName(added)
    owner = F.last(F.when(~F.col("added"), F.col("page")), True).over(Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    owned = every.withColumn("_owner", owner)
    taken = F.sum(F.when(F.col("added"), F.col("images")).otherwise(0)).over(Window.partitionBy(doc, "_owner"))
    return owned.withColumn("images", F.when(F.col("added"), F.col("images")).otherwise(F.greatest(F.lit(0), F.col("images") - taken)).cast("long")).drop("_owner")


def document_findings(pages: DataFrame, doc: str, documents: DataFrame | None = None) -> DataFrame:
    """(doc, code, n, page): empty pages, pages to be read by OCR, lost figures, and (where pages say `columns` or `tables`) pages whose reading order must be looked at; the page only if there is exactly one.

    documents (doc, is_complex, bad_encoding, intruders) adds what is known of whole documents: a complex layout that no page explains, and spoilt encodings
    (the parser's word for it, or characters that stand inside words, as corpora.glyph_corruption() finds them); neither names a page.
    """
    tests = {"empty-page": (F.col("text_length") == 0) & (F.col("images") == 0), "needs-ocr": (F.col("text_length") < 40) & (F.col("images") > 0), "figures-lost": F.col("images") > F.col("packaged")}
    if {"columns", "tables"} <= set(pages.columns):
        tests["reading-order"] = (F.col("columns") > 1) | (F.col("tables") > 0)
    rows = pages.select(doc, "page", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()]))).alias("code"))
    found = rows.groupBy(doc, "code").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) == 1, F.min("page")).alias("page"))
    if documents is None:
        return found
    whole = lambda df, code: df.select(doc, F.lit(code).alias("code"), F.lit(1).cast("long").alias("n"), F.lit(None).cast(dict(found.dtypes)["page"]).alias("page"))
    order = documents.filter("is_complex").join(found.filter("code = 'reading-order'").select(doc), doc, "left_anti")
    return found.unionByName(whole(order, "reading-order")).unionByName(whole(documents.filter(F.col("bad_encoding") | (F.coalesce("intruders", F.lit(0)) > 0)), "encoding"))


def finder_categories(finders: DataFrame) -> DataFrame:
    """(kind, category) that finders (name, kind, categories) report under."""
    return finders.select("kind", F.explode("categories").alias("category")).distinct()


def restore_reviews(raw: DataFrame, json: str, rows: list[str], version: int = 1) -> DataFrame:
    """(id, row, rating, benchmark) of stored reviews: of the right version, known rows and ratings only, benchmarks held between 0 and 100. Whole documents are read by restore_documents()."""
    parsed = F.from_json(json, "version int, benchmark double, ratings map<string,string>")
    good = raw.withColumn("_p", parsed).filter(F.col("_p.version") == version)
    held = F.when(F.col("_p.benchmark").isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("_p.benchmark"))))
    each = good.select("id", held.alias("benchmark"), F.explode("_p.ratings").alias("row", "rating"))
    return each.filter(F.col("row").isin(*rows) & F.col("rating").isin(*STORED_RATINGS))


@dataclass(frozen=True)
class Restored:
    """What is left of stored review documents once every field is checked; all tables begin with (id, chapter) but for the header's (id)."""

    header: DataFrame
    reviews: DataFrame
    notes: DataFrame
    ratings: DataFrame
    answers: DataFrame
    edits: DataFrame
    assets: DataFrame


# Ratings, answers, and how many parts an edit's key has (section, element, occurrence, original).
STORED_RATINGS, STORED_ANSWERS = ("na", "exclusive", "emerging", "inclusive"), ("yes", "no", "unsure", "skip")
KEY_PARTS = 4
_ASSET = ("id", "mediaType", "extension", "sha256", "originPart", "name")


def _part(v, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _string(v, path: str) -> Column:
    """The string at a path; null where something else stands there."""
    return F.when(F.schema_of_variant(_part(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v, path: str) -> Column:
    return F.when(F.schema_of_variant(_part(v, path)).rlike("^(?:BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, path, "double"))


def _members(v, path: str = "$") -> Column:
    """The members of the object at a path; null where none stands there."""
    return F.try_variant_get(v, path, "map<string,variant>")


def restore_documents(raw: DataFrame, json: str, categories: list[str], key: str = "id", version: int = 1) -> Restored:
    """Stored review documents (id, json), which nobody vouches for, read field by field: a part that isn't what it should be is left out alone.

    Documents of another version, or that are no JSON objects, give nothing. Of edits stay replacements with a text, kept words with or without a context,
    and pictures with all their fields and their bytes among the chapter's assets; edits whose key is none go. Assets need all their names and base64 bytes.
    """
    good = raw.select(key, F.try_parse_json(json).alias("v")).filter(_number("v", "$.version") == version)
    given = _number("v", "$.header.benchmark.bipocPercent")
    percent = F.when(given.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.floor(given + 0.5))))
    header = good.select(key, *[F.coalesce(_string("v", f"$.header.assessor.{n}"), F.lit("")).alias(n) for n in ("name", "title", "college")], percent.alias("benchmark"), _string("v", "$.header.region").alias("region"))
    inside = lambda df, c, path, name, *keep: df.select(key, *keep, F.explode(_members(c, path)).alias(name, "m"))
    reviews = inside(good, "v", "$.reviews", "chapter").filter(_members("m").isNotNull())
    said = reviews.select(key, "chapter", *[F.coalesce(_string("m", f"$.{n}"), F.lit("")).alias(n) for n in ("summary", "suggestions")])
    by_category = inside(reviews, "m", "$.categories", "category", "chapter").filter(F.col("category").isin(*categories) & _members("m").isNotNull())
    notes = by_category.select(key, "chapter", "category", F.coalesce(_string("m", "$.notes"), F.lit("")).alias("notes"))
    listed = lambda path, name, known: inside(by_category, "m", path, name, "chapter", "category").select(key, "chapter", "category", name, _string("m", "$").alias("value")).filter(F.col("value").isin(*known))
    stored = inside(good, "v", "$.assets", "chapter").select(key, "chapter", F.explode(F.try_variant_get("m", "$", "array<variant>")).alias("m"))
    assets = stored.select(key, "chapter", *[_string("m", f"$.{n}").alias("asset_id" if n == "id" else n) for n in _ASSET], F.try_to_binary(_string("m", "$.bytes"), F.lit("base64")).alias("bytes")).dropna()
    edits = inside(inside(good, "v", "$.edits", "chapter"), "m", "$.edits", "edit", "chapter").filter(F.size(F.split("edit", "::")) >= KEY_PARTS)
    a, p = "$.attribution", "$.placement"
    fields = edits.select(
        key, "chapter", "edit", _string("m", "$.kind").alias("kind"), _string("m", "$.replacement").alias("replacement"), _string("m", "$.context").alias("context"), _part("m", "$.context").isNull().alias("_free"),
        F.when(_string("m", "$.category").isin(*categories), _string("m", "$.category")).alias("category"), _string("m", f"{p}.kind").alias("mode"), _string("m", f"{p}.elementId").alias("target"), _string("m", "$.assetName").alias("name"),
        _string("m", "$.alt").alias("alt"), _string("m", "$.caption").alias("caption"), _number("m", "$.width").alias("width"), _number("m", "$.height").alias("height"), _string("m", f"{a}.text").alias("credit"),
        _string("m", f"{a}.sourcePageUrl").alias("source_url"), _string("m", f"{a}.licenseName").alias("license"), _string("m", f"{a}.licenseUrl").alias("license_url"),
        F.when(F.schema_of_variant(_part("m", f"{a}.shareAlike")) == "BOOLEAN", F.try_variant_get("m", f"{a}.shareAlike", "boolean")).alias("share_alike"), (_part("m", f"{a}.licenseUrl").isNull() | _string("m", f"{a}.licenseUrl").isNotNull()).alias("_license"),
    )
    words = ("replacement", "context", "category")
    picture = ("mode", "target", "name", "alt", "caption", "width", "height", "credit", "source_url", "license", "license_url", "share_alike")
    whole = F.col("mode").isin("replace", "insert-after") & F.col("_license")
    for c in picture:
        whole &= F.col(c).isNotNull() if c not in ("license_url", "mode") else F.lit(True)
    none = lambda names: [F.lit(None).cast(dict(fields.dtypes)[c]).alias(c) for c in names]
    texts = fields.filter((F.col("kind") == "replace") & F.col("replacement").isNotNull() | (F.col("kind") == "keep") & (F.col("_free") | F.col("context").isNotNull()))
    kept = texts.select(key, "chapter", "edit", "kind", F.when(F.col("kind") == "replace", F.col("replacement")).alias("replacement"), F.when(F.col("kind") == "keep", F.col("context")).alias("context"), "category", *none(picture))
    shown = fields.filter((F.col("kind") == "image") & whole).join(assets.select(key, "chapter", "name").distinct(), [key, "chapter", "name"], "left_semi").select(key, "chapter", "edit", "kind", *none(words), *picture)
    return Restored(header, said, notes, listed("$.ratings", "row", STORED_RATINGS), listed("$.checklist", "element", STORED_ANSWERS), kept.unionByName(shown), assets)


def term_category(hits: DataFrame, rules: DataFrame, default: str = "7.6") -> DataFrame:
    """hits (gram) with the category that the lexicon gives their phrase."""
    listed = rules.select(F.lower(T.collapse("phrase")).alias("gram"), F.col("category").alias("_c")).dropDuplicates(["gram"])
    return hits.join(listed, "gram", "left").withColumn("category", F.coalesce("_c", F.lit(default))).drop("_c")


def findings_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("section_id").alias("sections"))


def failures_by_category(failures: DataFrame) -> DataFrame:
    """(category, section_id, n) of the failures (category, section_id, message) of finders, with the first message."""
    return failures.groupBy("category", "section_id").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message"))
