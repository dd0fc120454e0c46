"""The human review queue: triage, keys, merging, order, progress, and what answers touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import audits as A

#: Kinds in the order in which they are asked.
KINDS = ("confirm-decorative", "alt", "table-headers")


def queue_key(hash_="hash", section="section_id", element="element_id") -> Column:
    """The content hash, else section::element."""
    return F.coalesce(T._col(hash_), F.concat_ws("::", T._col(section), T._col(element)))


def url_hash(src) -> Column:
    """A 40-digit hexadecimal tail of an address."""
    return F.nullif(F.regexp_extract(T._col(src), r"([0-9a-f]{40})(?:[?#].*)?$", 1), F.lit(""))


def queue_images(images: DataFrame, answers: DataFrame) -> DataFrame:
    """images (key, alt, presentation, caption) with a status: presentational, trusted, answered, or the kind that is queued, with proposal and current text.

    The source text is judged first; one that is only too long is judged again once fitted.
    """
    source = A.alt_issue("alt")
    fitted = T.fit_alt("alt")
    issue = F.when(source == "alt-text-too-long", A.alt_issue(fitted)).otherwise(source)
    joined = images.join(answers.groupBy("key").agg(F.max("type").alias("_type")), "key", "left").withColumn("_issue", issue)
    status = (
        F.when(F.col("presentation"), "presentational").when(F.col("_type") == "decorative", "decorative").when(F.col("_type") == "alt", "described")
        .when(F.col("alt").isNotNull() & (F.trim("alt") == ""), "confirm-decorative").when(F.col("alt").isNotNull() & F.col("_issue").isNull(), "trusted").otherwise("alt")
    )
    out = joined.withColumn("status", status)
    current = F.when((F.col("status") == "alt") & (A.alt_severity("_issue") != "error"), F.col("alt"))
    proposed = F.when(F.col("status").isin(*KINDS) & (F.coalesce(F.trim("caption"), F.lit("")) != ""), T.collapse("caption"))
    return out.withColumn("current", current).withColumn("proposed", proposed).drop("_type", "_issue")


def table_grid(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """Per table: rows, widths with column spans, whether ragged, spanning rows, and headers, from cells (row_idx, tag, colspan, rowspan)."""
    by_row = cells.groupBy(key, "row_idx").agg(F.sum("colspan").alias("width"), F.bool_or(F.col("rowspan") > 1).alias("spans"), F.bool_or(F.col("tag") == "th").alias("th"), F.max("colspan").alias("widest"))
    return by_row.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.max("width").alias("width"), (F.count_distinct("width") > 1).alias("ragged"), F.bool_or("spans").alias("rowspan"), F.bool_or("th").alias("has_th"),
        F.max(F.when(F.col("row_idx") == 0, F.col("widest"))).alias("first_row_colspan"),
    )


def refusal(choice="choice") -> Column:
    """The first reason why a band of a table can't become headers, from the facts of table_grid() and the widest span of its first column."""
    row, column = T._col(choice).isin("row", "both"), T._col(choice).isin("column", "both")
    return (
        F.when(F.col("rows") == 0, "no-rows").when(F.col("any_nested"), "nested").when(F.col("any_rowspan"), "rowspan").when(F.col("ragged"), "ragged")
        .when(row & (F.col("first_row_colspan") > 1) | column & (F.col("first_column_colspan") > 1), "colspan-in-band")
    )


def _grid(cells: DataFrame, key: str) -> DataFrame:
    """table_grid() with the widest span of the first column, and whether a cell holds another table (where cells say so: `nested`)."""
    inner = F.bool_or("nested") if "nested" in cells.columns else F.bool_or(F.lit(False))
    first_column = cells.groupBy(key).agg(F.max(F.when(F.col("col_idx") == 0, F.col("colspan"))).alias("first_column_colspan"), inner.alias("any_nested"))
    return table_grid(cells, key).withColumnRenamed("rowspan", "any_rowspan").join(first_column, key, "left")


def queue_tables(tables: DataFrame, cells: DataFrame, answers: DataFrame, key: str = "table_id") -> DataFrame:
    """tables (key, role) with a status: presentational by their role or an answer, has-headers, promoted as answered, or queued, with the reason where an answer was refused."""
    joined = tables.join(_grid(cells, key), key, "left").fillna(0, ["rows"]).fillna(False, ["any_nested"]).join(answers.groupBy(key).agg(F.max("choice").alias("choice")), key, "left")
    refused = F.when(F.col("choice").isin("row", "column", "both"), refusal())
    status = (
        F.when(F.col("role").isin("presentation", "none"), "presentational").when(F.col("has_th"), "has-headers").when(F.col("choice") == "presentation", "layout")
        .when(F.col("choice").isin("row", "column", "both") & refused.isNull(), "promoted").otherwise("queued")
    )
    return joined.select(*tables.columns, status.alias("status"), F.when(status == "queued", refused).alias("refused"))


def promote_headers(cells: DataFrame, answers: DataFrame, key: str = "table_id") -> DataFrame:
    """cells with (new_tag, scope, refused): the answered band becomes headers unless the grid forbids it, with the first reason."""
    row, column = F.col("choice").isin("row", "both"), F.col("choice").isin("column", "both")
    joined = cells.join(_grid(cells, key), key).join(answers.groupBy(key).agg(F.max("choice").alias("choice")), key, "left").withColumn("refused", F.when(F.col("choice").isNotNull(), refusal()))
    on = F.col("choice").isNotNull() & F.col("refused").isNull()
    top, side = on & row & (F.col("row_idx") == 0), on & column & (F.col("col_idx") == 0)
    corner = top & side
    return joined.select(
        *[c for c in cells.columns], "choice", "refused",
        F.when((top | side) & ~corner, "th").otherwise(F.col("tag")).alias("new_tag"), F.when(corner, None).when(top, "col").when(side, "row").alias("scope"),
    )


def merge_queue(items: DataFrame, order: list[str]) -> DataFrame:
    """The first item of each hash in emission order; items without a hash all stay."""
    first = Window.partitionBy("hash").orderBy(*order)
    hashed = items.filter("hash IS NOT NULL").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return hashed.unionByName(items.filter("hash IS NULL"))


def order_queue(queue: DataFrame, skipped: DataFrame, by: list[str], group: str) -> DataFrame:
    """queue with its place: by kind, then position; skipped items last."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    marked = queue.join(skipped.select("key", F.lit(1).alias("_skipped")), "key", "left").withColumn("_skipped", F.coalesce("_skipped", F.lit(0)))
    return marked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_skipped", rank, *by))).drop("_skipped")


def queue_counts(queue: DataFrame, answers: DataFrame, skipped: DataFrame, group: str) -> DataFrame:
    """Per group: items, answered, skipped and remaining."""
    marked = queue.join(answers.select("key", F.lit(True).alias("_a")).distinct(), "key", "left").join(skipped.select("key", F.lit(True).alias("_s")).distinct(), "key", "left")
    answered, passed = F.col("_a").isNotNull(), F.col("_s").isNotNull()
    return marked.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(answered).alias("answered"), F.count_if(passed & ~answered).alias("skipped"), F.count_if(~answered).alias("remaining"))


def affected_sections(items: DataFrame, keys: DataFrame, section: str = "section_id") -> DataFrame:
    return items.join(keys.select("key"), "key", "left_semi").select(section).distinct()


def refused_answers(answers: DataFrame, items: DataFrame, rebuilt: DataFrame, section: str = "section_id") -> DataFrame:
    """Answers whose item is still queued in a section that was rebuilt since."""
    still = items.join(rebuilt.select(section), section, "left_semi").select("key")
    return answers.join(still, "key", "left_semi")


def fresh_verdicts(gates: DataFrame, sections: DataFrame, section: str = "section_id") -> DataFrame:
    """Verdicts on the bytes that a section has now."""
    return gates.join(sections.select(section, F.sha2("html", 256).alias("digest")), [section, "digest"], "left_semi")


def latest(events: DataFrame, key: str, order: str, kind: str = "type", undo: tuple[str, ...] = ()) -> DataFrame:
    """The last event of each key; keys whose last event undoes are left out. Streams fold the same way (see streaming)."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("e")).select(key, "e.*")
    return last.filter(~F.col(kind).isin(*undo)) if undo else last


def fold_answers(events: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """(key, answer, text, choice, note, skipped, answered_at, skipped_at, revisited_at) after a log of events (key, seq, type, answer, text, choice).

    'answer' records an answer and its note and clears a skip, unless it is refused: then nothing happens. 'skip' marks the key and keeps its answer,
    'revisit' takes answer and note away and keeps the mark; other types say nothing about the key. Three maxima per key say it all, so events may come in any order,
    and a stream folds by the same function as a batch ("update" or "complete" mode).
    """
    judged = A.validate_answers(events.withColumnRenamed("type", "_event").withColumn("type", F.col("answer"))).drop("type")
    said = F.struct(F.col(order).alias("at"), "answer", "text", "choice", F.nullif(F.regexp_extract("verdict", "^accepted:(.*)$", 1), F.lit("")).alias("note"))
    given = (F.col("_event") == "answer") & F.col("verdict").startswith("accepted")
    last = judged.groupBy(key).agg(
        F.max_by(F.when(given, said), F.when(given, F.col(order))).alias("a"), F.max(F.when(F.col("_event") == "skip", F.col(order))).alias("skipped_at"), F.max(F.when(F.col("_event") == "revisit", F.col(order))).alias("revisited_at")
    )
    stands = F.col("a.at").isNotNull() & (F.col("revisited_at").isNull() | (F.col("revisited_at") < F.col("a.at")))
    skipped = F.col("skipped_at").isNotNull() & (F.col("a.at").isNull() | (F.col("a.at") < F.col("skipped_at")))
    return last.select(key, *[F.when(stands, F.col(f"a.{c}")).alias(c) for c in ("answer", "text", "choice", "note")], skipped.alias("skipped"), F.col("a.at").alias("answered_at"), "skipped_at", "revisited_at")


def fold_edits(events: DataFrame, key: str, order: str, kind: str = "type") -> tuple[DataFrame, DataFrame]:
    """(edits, dismissed) after a log of events: the last one of each key counts. 'replace', 'keep' and 'image' leave an edit, 'dismiss' a dismissed key, 'undo' neither."""
    last = latest(events, key, order, kind, ("undo",))
    return last.filter(F.col(kind).isin("replace", "keep", "image")), last.filter(F.col(kind) == "dismiss").select(key)


def fold_reviews(events: DataFrame, rows: DataFrame, elements: DataFrame, order: str, review: str = "chapter_id") -> DataFrame:
    """(review, slot, category, id, value) after a log of events (type, category, id, value): the last value of every slot.

    'rate' and 'clear-rating' share the slot of their rubric row, which `rows` (category, id) must list; 'check' has one for every
    element that `elements` lists; 'note' one a category; 'summary' and 'suggestions' one a review.
    """
    slot = F.when(F.col("type").isin("rate", "clear-rating"), "rating").otherwise(F.col("type"))
    known = rows.select(F.lit("rating").alias("slot"), "category", "id").unionByName(elements.select(F.lit("check").alias("slot"), "category", "id")).distinct()
    marked = events.withColumn("slot", slot)
    free = marked.filter(~F.col("slot").isin("rating", "check")).withColumn("id", F.lit(None).cast(dict(events.dtypes)["id"]))
    free = free.withColumn("category", F.when(F.col("slot") == "note", F.col("category")))
    kept = marked.join(known, ["slot", "category", "id"], "left_semi").select(*free.columns).unionByName(free)
    last = kept.groupBy(review, "slot", "category", "id").agg(F.max_by(F.struct("type", "value"), order).alias("e"))
    return last.filter("e.type <> 'clear-rating'").select(review, "slot", "category", "id", F.col("e.value").alias("value"))


def over_limit(events: DataFrame, client: str, ts: str, limit: int = 60, window: str = "60 seconds") -> DataFrame:
    """(client, begin, n) of fixed windows with more than `limit` requests. On a stream, give the events a watermark first."""
    counted = events.groupBy(client, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > limit).select(client, F.col("w.start").alias("begin"), "n")
