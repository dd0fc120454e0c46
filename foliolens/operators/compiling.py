"""Compiling pages end to end: one token table, every step a function of it, side outputs as tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.operators import lineage, steps
from foliolens.operators import pages as P
from foliolens.operators import sections as S


class Compiled:
    """The tables that a compilation yields, all keyed like its sections; each is planned when it is asked for."""

    def __init__(self, **tables: Callable[[], DataFrame]):
        self._tables = tables

    sections: DataFrame = cached_property(lambda self: self._tables["sections"]())
    notes: DataFrame = cached_property(lambda self: self._tables["notes"]())
    issues: DataFrame = cached_property(lambda self: self._tables["issues"]())
    gate: DataFrame = cached_property(lambda self: self._tables["gate"]())


def renamed_headings(tokens: DataFrame, key: str) -> DataFrame:
    """tokens with heading tags re-levelled so that none skips, as P.relevel() says; a close tag follows the heading opened last before it."""
    page, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("pos")
    heading = F.col("tag").rlike("^h[1-6]$")
    marked = tokens.withColumn("_level", F.when((F.col("kind") == "open") & heading, F.substring("tag", 2, 1).cast("int")))
    marked = marked.withColumns({"_n": F.count("_level").over(order), "_least": F.min("_level").over(page)})
    marked = marked.withColumn("_gap", F.least(F.lit(6), F.greatest(F.lit(2), F.col("_level") - F.col("_least") + 2)) - F.col("_n"))
    marked = marked.withColumn("_new", F.when(F.col("_level").isNotNull(), F.col("_n") + F.least(F.lit(1), F.min("_gap").over(order))))
    marked = marked.withColumn("_last", F.last("_new", True).over(order))
    named = F.when(heading & F.col("_last").isNotNull(), F.concat(F.lit("h"), F.col("_last").cast("string"))).otherwise(F.col("tag"))
    return marked.withColumn("tag", named).drop("_level", "_n", "_least", "_gap", "_new", "_last")


def compile_pages(sections: DataFrame, key: str = "page_id", html: str = "html", base: str | None = None, title: str | None = None, chrome: tuple[str, ...] = ()) -> Compiled:
    """Chrome removal, absolute addresses (against the column `base`), headings, text semantics and the page policy in this order; pages are
    assembled around their `title`; then issues and the gate on what is left.

    A section that is blank or holds no tag fails alone: its row carries the error and an empty page.
    """
    tokens = P.tokenize(sections, key, html, (base,) if base else ())
    if chrome:
        tokens = P.strip_chrome(tokens, key, chrome)
    if base:
        tokens = P.absolute_urls(tokens, base).drop(base)
    marked = P.text_semantics(renamed_headings(tokens, key))

    def assembled() -> DataFrame:
        made = P.sanitize(marked, key).withColumnRenamed("html", "compiled")
        error = F.when(F.trim(F.coalesce(F.col(html), F.lit(""))) == "", "blank").when(~F.col(html).rlike("<[a-zA-Z]"), "no-markup")
        out = sections.select(key, error.alias("error"), *([F.col(title).alias("_title")] if title else [])).join(made, key, "left")
        body = S.assemble_page(F.coalesce("compiled", F.lit("")), "_title") if title else F.coalesce("compiled", F.lit(""))
        return out.select(key, F.when(F.col("error").isNull(), body).otherwise("").alias("html"), "error")

    def notes() -> DataFrame:
        told = {"text-semantics": ("presentational tags replaced", F.count_if(F.col("tag").isin("b", "i", "u")))}
        if base:
            told |= {"absolutize": ("addresses made absolute", F.sum("rewritten")), "upgrade": ("addresses moved to https", F.sum("upgraded")), "unreadable": ("addresses left that can't be read", F.sum("failed"))}
        counts = tokens.filter("kind = 'open'").groupBy(key).agg(F.array(*[F.struct(F.lit(step).alias("step"), F.lit(message).alias("message"), n.cast("long").alias("n")) for step, (message, n) in told.items()]).alias("_notes"))
        return counts.select(key, F.explode("_notes").alias("_n")).select(key, "_n.step", "_n.message", "_n.n").filter("n > 0")

    return Compiled(sections=assembled, notes=notes, issues=lambda: P.map_issues(P.structural_issues(marked, key)), gate=lambda: P.page_gate(sections, marked, key))


def recompile(sections: DataFrame, changed: DataFrame, key: str = "page_id") -> Compiled:
    """Only the sections named in `changed`."""
    return compile_pages(sections.join(changed.select(key), key, "left_semi"), key)


def tally_blocks(tokens: DataFrame, key: str) -> DataFrame:
    """Per document the numbers of headings by level, lists, items, tables, images with and without text, links and characters."""
    opened = lambda cond: F.count_if((F.col("kind") == "open") & cond)
    levels = [opened(F.col("tag") == f"h{i}").alias(f"h{i}") for i in range(1, 7)]
    return tokens.groupBy(key).agg(
        *levels, opened(F.col("tag").isin("ul", "ol")).alias("lists"), opened(F.col("tag") == "li").alias("items"), opened(F.col("tag") == "table").alias("tables"), opened(F.col("tag") == "img").alias("images"),
        opened(F.col("tag") == "a").alias("links"), F.sum(F.when(F.col("kind") == "text", F.length("text")).otherwise(0)).alias("chars"),
    )


@dataclass(frozen=True)
class Sections:
    """What compile_sections() yields: the sections (key, html, error), the notes (key, ord, step, message, n) and the queue (key, ord, queue_key, kind, ...) of all of them."""

    sections: DataFrame
    notes: DataFrame
    queue: DataFrame


#: Columns of a section that the steps read; those that a table lacks are null.
_FACTS = {"base": "string", "title": "string", "canonical_url": "string", "book": "string", "book_url": "string", "publisher": "string", "authors": "array<string>", "license": "string", "license_url": "string"}
_EDIT = ("element_id", "occurrence", "original", "kind", "replacement", "context")
_IMAGE = ("asset", "target", "mode", "alt", "width", "height", "caption", "credit", "source_url", "license", "license_url", "share_alike")
_NOTE = "struct<step:string,message:string,n:bigint>"
_QUEUED = ("kind", "element_id", "hash", "src", "caption", "reference", "proposed", "current")
_OUT = pa.struct([("step", pa.string()), ("message", pa.string()), ("n", pa.int64())]), pa.struct([(c, pa.string()) for c in _QUEUED])
#: A name in an address: of a page of the book, or of a picture's bytes.
_NAMED = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{40}"


def _mentioned(sections: DataFrame, key: str) -> DataFrame:
    """(key, name): the names that a section's source mentions, once each."""
    return sections.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(f"(?i){_NAMED}"), F.lit(0)), F.lower))).alias("name"))


def _told(sections: DataFrame, key: str, xrefs: DataFrame | None, answers: DataFrame | None, edits: DataFrame | None, images: DataFrame | None) -> DataFrame:
    """sections with what the steps must know besides: the links that a section mentions, the answers that touch it, its edits and its pictures."""
    pairs = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    own = F.col(key).cast("string")
    if xrefs is not None:
        named = xrefs.groupBy(F.lower("name").alias("name")).agg(F.min("url").alias("url"))
        sections = sections.join(_mentioned(sections, key).join(named, "name").groupBy(key).agg(pairs("name", "url").alias("_xrefs")), key, "left")
    if answers is not None:
        last = answers.groupBy("queue_key").agg(F.first(F.struct("type", "text", "choice")).alias("answer"))
        by_hash = _mentioned(sections, key).join(last.withColumnRenamed("queue_key", "name"), "name").select(key, F.col("name").alias("queue_key"), "answer")
        here = last.filter(F.col("queue_key").contains("::")).withColumn("_section", F.regexp_extract("queue_key", "(?s)^(.*?)::", 1))
        by_place = sections.select(key, own.alias("_section")).join(here, "_section").select(key, "queue_key", "answer")
        sections = sections.join(by_hash.unionByName(by_place).groupBy(key).agg(pairs("queue_key", "answer").alias("_answers")), key, "left")
    for table, fields, name in ((edits, _EDIT, "_edits"), (images, _IMAGE, "_images")):
        if table is not None:
            listed = table.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias(name))
            sections = sections.join(listed, key, "left")
    return sections


def _dealt(df: DataFrame) -> DataFrame:
    """A table of few files dealt out to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _spread(df: DataFrame) -> DataFrame:
    """What joins yield lies in partitions sized by bytes, where the work on it goes by pages: dealt out to all cores."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def compile_sections(
    sections: DataFrame, key: str = "section_id", publisher: str | steps.Publisher = "document", xrefs: DataFrame | None = None, answers: DataFrame | None = None, edits: DataFrame | None = None, images: DataFrame | None = None,
    order: tuple = steps.STEPS, once: bool = True,
) -> Sections:
    """sections (key, html, and any of base, title, canonical_url, book, book_url, publisher, authors, license, license_url) after all steps, in one pass over each page's tree.

    Spark joins to each section what it mentions: xrefs (name, url), answers (queue_key, type, text, choice; one by the hash of a picture's bytes touches
    every section that shows it), edits (key, ord, element_id, occurrence, original, kind, replacement, context) and pictures (key, ord, asset, target, ...).
    A section of which a step fails has an error, an empty page, no notes and no queue; the others go on. A null page is an error. `once` writes
    the pass to the shared folder, so that the three tables read it; without it each table is its own pass.
    """
    by = steps.PUBLISHERS[publisher] if isinstance(publisher, str) else publisher
    known = xrefs is not None or answers is not None or edits is not None or images is not None
    rows = _spread(_told(sections, key, xrefs, answers, edits, images)) if known else _dealt(sections)
    facts = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in _FACTS.items()]
    extra = [F.col(c) for c in ("_xrefs", "_answers", "_edits", "_images") if c in rows.columns]

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "_key"}
            html, errors, notes, queues = [], [], [], []
            for i, source in enumerate(columns["_html"]):
                at = {n: c[i] for n, c in columns.items()}
                told = at | {"section": at["_section"], "xrefs": dict(at.get("_xrefs") or []), "answers": dict(at.get("_answers") or []), "edits": at.get("_edits") or [], "images": at.get("_images") or []}
                page = steps.compiled(source, told, by, order) if source is not None else ("", "no page", [], [])
                for column, value in zip((html, errors, notes, queues), page, strict=True):
                    column.append(value)
            made = [pa.array([[dict(zip(("step", "message", "n"), x, strict=True)) for x in n] for n in notes], pa.list_(_OUT[0])), pa.array([[{c: x.get(c) for c in _QUEUED} for x in q] for q in queues], pa.list_(_OUT[1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html, pa.string()), pa.array(errors, pa.string()), *made], [key, "html", "error", "notes", "queue"])

    schema = f"`{key}` {dict(sections.dtypes)[key]}, html string, error string, notes array<{_NOTE}>, queue array<struct<{','.join(f'{c}:string' for c in _QUEUED)}>>"
    done = rows.select(F.col(key).alias("_key"), F.col(key).cast("string").alias("_section"), F.col("html").alias("_html"), *facts, *extra).mapInArrow(run, schema)
    if once:
        path = lineage.folder(sections.sparkSession, "compiled")
        done.write.parquet(path)
        done = sections.sparkSession.read.schema(done.schema).parquet(path)
    notes = done.select(key, F.posexplode("notes").alias("ord", "x")).select(key, "ord", "x.*")
    queue = done.select(key, F.posexplode("queue").alias("ord", "x")).select(key, "ord", queued_key(key, "x.hash", "x.element_id").alias("queue_key"), "x.*")
    return Sections(done.select(key, "html", "error"), notes, queue)


def queued_key(section: str, hash_: str, element: str) -> Column:
    """What an answer is kept under: the hash of a picture's bytes, else the section and the element."""
    return F.coalesce(F.col(hash_), F.concat_ws("::", F.col(section).cast("string"), F.col(element)))


def recompile_sections(sections: DataFrame, changed: DataFrame, key: str = "section_id", **told) -> Sections:
    """compile_sections() of the sections named in `changed` only."""
    return compile_sections(sections.join(changed.select(key).distinct(), key, "left_semi"), key, **told)
