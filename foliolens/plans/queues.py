"""Queries of the review queue: orders stand for sections, their lines for items, events for reviewers' actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.operators import queues as Q
from foliolens.plans.audits import _ALT, _IMAGES, images
from foliolens.plans.registry import query, table

_ITEM = """SELECT l_orderkey AS section_id, l_linenumber AS step, l_suppkey AS pos, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'h' || l_partkey END AS hash, l_orderkey || '-' || l_linenumber AS element_id,
  CASE l_partkey % 3 WHEN 0 THEN 'alt' WHEN 1 THEN 'confirm-decorative' ELSE 'table-headers' END AS kind FROM lineitem"""
_ITEMS = f"WITH raw AS ({_ITEM}), items AS (SELECT *, coalesce(hash, section_id || '::' || element_id) AS key FROM raw) "
_MERGED = _ITEMS + ", merged AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY section_id, step, pos) AS n FROM items WHERE hash IS NOT NULL) WHERE n = 1 UNION ALL SELECT * FROM items WHERE hash IS NULL) "


def items(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("step"), F.col("l_suppkey").alias("pos"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("h"), "l_partkey")).alias("hash"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("element_id"),
        F.when(F.col("l_partkey") % 3 == 0, "alt").when(F.col("l_partkey") % 3 == 1, "confirm-decorative").otherwise("table-headers").alias("kind"),
    )
    return lines.withColumn("key", Q.queue_key())


def merged(spark, sf_dir):
    return Q.merge_queue(items(spark, sf_dir), ["section_id", "step", "pos"])


def _answers(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size < 20").select(F.concat(F.lit("h"), "p_partkey").alias("key"), F.lit("alt").alias("type"))


def _skips(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size BETWEEN 15 AND 30").select(F.concat(F.lit("h"), "p_partkey").alias("key"))


_MARKS = ", a AS (SELECT 'h' || p_partkey AS key FROM part WHERE p_size < 20), s AS (SELECT 'h' || p_partkey AS key FROM part WHERE p_size BETWEEN 15 AND 30) "


@query(_MERGED + "SELECT section_id, step, pos, hash, kind, key FROM merged")
def queue_merged(spark, sf_dir):
    return merged(spark, sf_dir).drop("element_id")


@query(_MERGED + _MARKS + """SELECT section_id, key, row_number() OVER (PARTITION BY section_id ORDER BY CASE WHEN key IN (SELECT key FROM s) THEN 1 ELSE 0 END,
  CASE kind WHEN 'confirm-decorative' THEN 1 WHEN 'alt' THEN 2 ELSE 3 END, step, pos, key)::INT AS place FROM merged""")  # fmt: skip
def queue_ordered(spark, sf_dir):
    return Q.order_queue(merged(spark, sf_dir), _skips(spark, sf_dir), ["step", "pos", "key"], "section_id").select("section_id", "key", "place")


@query(_MERGED + _MARKS + """SELECT kind, count(*) AS total, count(*) FILTER (key IN (SELECT key FROM a)) AS answered, count(*) FILTER (key IN (SELECT key FROM s) AND key NOT IN (SELECT key FROM a)) AS skipped,
  count(*) FILTER (key NOT IN (SELECT key FROM a)) AS remaining FROM merged GROUP BY kind""")  # fmt: skip
def queue_progress(spark, sf_dir):
    return Q.queue_counts(merged(spark, sf_dir), _answers(spark, sf_dir), _skips(spark, sf_dir), "kind")


@query(_ITEMS + _MARKS + "SELECT DISTINCT section_id FROM items WHERE key IN (SELECT key FROM s)")
def queue_affected_sections(spark, sf_dir):
    return Q.affected_sections(items(spark, sf_dir), _skips(spark, sf_dir))


@query(_ITEMS + _MARKS + "SELECT key FROM a WHERE key IN (SELECT key FROM items WHERE section_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))")
def queue_refused_answers(spark, sf_dir):
    rebuilt = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("section_id"))
    return Q.refused_answers(_answers(spark, sf_dir), items(spark, sf_dir), rebuilt).select("key")


@query("SELECT o_orderkey AS section_id FROM orders WHERE o_orderkey % 3 = 0")
def queue_fresh_verdicts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), F.concat(F.lit("<p>"), F.col("o_orderkey").cast("string")).alias("html"))
    gates = orders.select("section_id", F.when(F.col("section_id") % 3 == 0, F.sha2("html", 256)).otherwise("stale").alias("digest"))
    return Q.fresh_verdicts(gates, orders).select("section_id")


@query(_IMAGES + """, st AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'presentational' WHEN p_partkey % 7 = 0 AND p_partkey % 2 = 0 THEN 'decorative' WHEN p_partkey % 7 = 0 THEN 'described'
  WHEN alt IS NOT NULL AND trim(alt) = '' THEN 'confirm-decorative' WHEN alt IS NOT NULL AND (issue IS NULL OR issue = 'alt-text-too-long') THEN 'trusted' ELSE 'alt' END AS status, alt, severity FROM sev)
SELECT p_partkey, status, CASE WHEN status = 'alt' AND severity <> 'error' THEN alt END AS current FROM st""")  # fmt: skip
def queue_image_triage(spark, sf_dir):
    pictures = images(spark, sf_dir).withColumns({"key": F.col("p_partkey").cast("string"), "presentation": F.col("p_partkey") % 11 == 0, "caption": F.lit(None).cast("string")})
    answers = pictures.filter("p_partkey % 7 = 0").select("key", F.when(F.col("p_partkey") % 2 == 0, "decorative").otherwise("alt").alias("type"))
    return Q.queue_images(pictures, answers).select("p_partkey", "status", "current")


_GRID = "WITH c AS (SELECT l_orderkey AS t, (l_linenumber - 1) // 2 AS r, (l_linenumber - 1) % 2 AS c, CASE WHEN l_suppkey % 9 = 0 THEN 2 ELSE 1 END AS cs, CASE WHEN l_suppkey % 31 = 0 THEN 2 ELSE 1 END AS rs FROM lineitem), w AS (SELECT t, r, sum(cs) AS width, bool_or(rs > 1) AS sp, max(cs) AS widest FROM c GROUP BY t, r), g AS (SELECT t, count(*) AS rows, max(width) AS width, count(DISTINCT width) > 1 AS ragged, bool_or(sp) AS rowspan, max(CASE WHEN r = 0 THEN widest END) AS fr FROM w GROUP BY t) "


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), F.floor((F.col("l_linenumber") - 1) / 2).cast("int").alias("row_idx"), ((F.col("l_linenumber") - 1) % 2).cast("int").alias("col_idx"), F.lit("td").alias("tag"),
        F.when(F.col("l_suppkey") % 9 == 0, 2).otherwise(1).alias("colspan"), F.when(F.col("l_suppkey") % 31 == 0, 2).otherwise(1).alias("rowspan"),
    )


@query(_GRID + "SELECT t AS table_id, rows, width::BIGINT AS width, ragged, rowspan, false AS has_th, fr AS first_row_colspan FROM g")
def table_grids(spark, sf_dir):
    return Q.table_grid(_cells(spark, sf_dir))


@query(_GRID + """SELECT c.t AS table_id, c.r::INT AS row_idx, c.c::INT AS col_idx, CASE WHEN g.rowspan THEN 'rowspan' WHEN g.ragged THEN 'ragged' WHEN g.fr > 1 THEN 'colspan-in-band' END AS refused,
  CASE WHEN c.r = 0 AND NOT g.rowspan AND NOT g.ragged AND g.fr = 1 THEN 'th' ELSE 'td' END AS new_tag, CASE WHEN c.r = 0 AND NOT g.rowspan AND NOT g.ragged AND g.fr = 1 THEN 'col' END AS scope FROM c JOIN g USING (t)""")  # fmt: skip
def table_headers(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    answers = cells.select("table_id").distinct().withColumn("choice", F.lit("row"))
    return Q.promote_headers(cells, answers).select("table_id", "row_idx", "col_idx", "refused", "new_tag", "scope")


@query("SELECT o_custkey AS chapter_id, count(*) FILTER (o_orderkey % 5 = 0) AS queued, bool_and(o_orderstatus <> 'P' AND o_orderkey % 7 <> 0) AND count(*) FILTER (o_orderkey % 5 = 0) = 0 AS publishable FROM orders GROUP BY o_custkey")
def chapters_publishable(spark, sf_dir):
    from foliolens.operators import audits as A

    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter_id"), F.col("o_orderkey").alias("section_id"), "o_orderstatus")
    sections = orders.withColumn("error", F.when(F.col("o_orderstatus") == "P", "failed")).withColumn("blockers", (F.col("section_id") % 7 == 0).cast("int"))
    return A.publishable(sections, orders.filter("section_id % 5 = 0"))


@query("SELECT user_id, arg_max(event_type, event_id) AS type, max(event_id) AS event_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'view'")
def answers_folded(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("type"))
    return Q.latest(events, "user_id", "event_id", "type", ("view",))


@query("SELECT event_type, time_bucket(INTERVAL 60 SECOND, ts) AS begin, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def requests_over_limit(spark, sf_dir):
    return Q.over_limit(table(spark, sf_dir, "events"), "event_type", "ts", 1).withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query("SELECT user_id, arg_max(event_type, event_id) AS type, max(event_id) AS event_id FROM events GROUP BY user_id")
def answers_folded_stream(spark, sf_dir):
    from foliolens.operators.lineage import folder
    from foliolens.streaming import folds

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").select("user_id", "event_id", F.col("event_type").alias("type"))
    sink = folder(spark, "folded")
    updates = folds.fold_latest(stream, "user_id", "event_id", "type").writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{sink}/out/batch={number}")).outputMode("update")
    updates.option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{sink}/out").groupBy("user_id").agg(F.max_by("type", "event_id").alias("type"), F.max("event_id").alias("event_id"))


#: Events as the log of a queue: clicks describe (some of them are refused), purchases confirm, errors skip, signups revisit.
_LOG = """e AS (SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'revisit' WHEN 'view' THEN 'jump' ELSE 'answer' END AS type, CASE event_type WHEN 'click' THEN 'alt' WHEN 'purchase' THEN 'decorative' END AS answer,
  CASE WHEN event_type = 'click' THEN CASE floor(value)::INT % 4 WHEN 0 THEN 'A wall in the ' || user_id || 'th spring' WHEN 1 THEN 'photo.jpg' WHEN 2 THEN 'ab' ELSE ' ' END END AS text FROM events),
a AS (SELECT key, max(seq) AS given, arg_max({'answer': answer, 'text': text}, seq) AS a FROM e WHERE type = 'answer' AND (text IS NULL OR text NOT IN (' ', 'photo.jpg')) GROUP BY key),
m AS (SELECT key, max(seq) FILTER (type = 'skip') AS skipped, max(seq) FILTER (type = 'revisit') AS revisited FROM e GROUP BY key),
f AS (SELECT m.key AS user_id, CASE WHEN given > coalesce(revisited, -1) THEN a END AS a, coalesce(skipped > coalesce(given, -1), false) AS skipped FROM m LEFT JOIN a USING (key))
SELECT user_id, a.answer AS answer, a.text AS text, CASE WHEN a.text = 'ab' THEN 'alt-text-too-short' END AS note, skipped FROM f"""


def _log(events):
    kind, value = F.col("event_type"), F.floor("value").cast("int") % 4
    text = F.when(value == 0, F.concat(F.lit("A wall in the "), F.col("user_id").cast("string"), F.lit("th spring"))).when(value == 1, "photo.jpg").when(value == 2, "ab").otherwise(" ")
    return events.select(
        "user_id", "event_id", F.when(kind == "error", "skip").when(kind == "signup", "revisit").when(kind == "view", "jump").otherwise("answer").alias("type"),
        F.when(kind == "click", "alt").when(kind == "purchase", "decorative").alias("answer"), F.when(kind == "click", text).alias("text"), F.lit(None).cast("string").alias("choice"),
    )


def _streamed(spark, sf_dir, name, by):
    """A table as a stream of four files, dealt by a column so that its events arrive out of order."""
    from foliolens.operators.lineage import folder

    rows, at = table(spark, sf_dir, name), folder(spark, name)
    rows.repartition(4, by).write.parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at), folder(spark, "streamed")


@query("WITH " + _LOG)
def answer_log(spark, sf_dir):
    return Q.fold_answers(_log(table(spark, sf_dir, "events")), "user_id", "event_id").select("user_id", "answer", "text", "note", "skipped")


@query("WITH " + _LOG)
def answer_log_streamed(spark, sf_dir):
    """The same fold as a stream."""
    stream, sink = _streamed(spark, sf_dir, "events", "value")
    folded = Q.fold_answers(_log(stream), "user_id", "event_id").writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/out"))
    folded.option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{sink}/out").select("user_id", "answer", "text", "note", "skipped")


@query("SELECT event_type, time_bucket(INTERVAL 60 SECOND, ts) AS begin, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1 AND time_bucket(INTERVAL 60 SECOND, ts) + INTERVAL 60 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def requests_over_limit_streamed(spark, sf_dir):
    """Windows that the watermark, ten minutes behind the latest event, has passed."""
    from foliolens.operators.lineage import folder
    from foliolens.streaming import folds

    schema, sink = table(spark, sf_dir, "events").schema, folder(spark, "over-limit")
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = folds.over_limit_stream(arriving, "event_type", "ts", 1)
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{sink}/out").option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{sink}/out").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


__all__ = ["_ALT"]
