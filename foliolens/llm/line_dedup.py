"""Line deduplication across documents: a repeated line stays in the document of the smallest id that holds it.

Every line becomes a row of a 128-bit hash of its key, its document and its position; no text travels with it. Rows are
dealt by ranges of the hash and sorted there by hash, document and position, so that a line's first occurrence passes
first and names the document that keeps it. The lines that go are folded into one bitmap a document, stored as 64-bit
words of which only those with a dropped line are kept. Lines so common that one would fill a partition are found by a
sketch of bounded size and told to all tasks, each with its owner; whatever the sketch misses goes the ordinary way.

Only DataFrame functions are used. Rows: a null text counts as empty (one empty line). A null id is one document that comes after
all others. Rows of one id are one document to the rule, each with its own lines; repeated rows lose the same lines.
An empty table gives an empty result. Further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import stored

#: What is stripped from lines, the letters that are lowered, the shortest key that counts as a repeat.
BLANK, UPPER, LEAST_POINTS = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 10
#: Common lines told to all tasks: at most so many a shuffle partition, and so many in all.
COMMON_PER_PARTITION, MOST_COMMON = 8, 100_000


def line_key(line: Column) -> Column:
    """The line without blanks around it, A-Z lowered."""
    bare = F.trim(line, F.lit(BLANK))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digest(text: Column) -> list[Column]:
    """128 bits of a text, as two numbers."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")]


def line_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, d1, d2, pos, h1, h2) of every line whose key is long enough: its document, place and key's hash."""
    docs = df.select(F.col(f"`{key}`").alias("id"), *_digest(F.col(f"`{text}`")), _lines(F.col(f"`{text}`")).alias("lines"))
    rows = docs.select("id", "d1", "d2", F.posexplode("lines").alias("pos", "line")).select("id", "d1", "d2", "pos", line_key(F.col("line")).alias("key"))
    return rows.filter(F.length("key") >= LEAST_POINTS).select("id", "d1", "d2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def common_lines(rows: DataFrame) -> DataFrame:
    """(h1, h2, owner) of lines that would fill a good part of a partition; at most MOST_COMMON, a few a partition."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(COMMON_PER_PARTITION * partitions, MOST_COMMON)
    told = rows.agg(F.expr(f"approx_top_k(h1, {most}, {min(16 * most, 1_000_000)})").alias("top"), F.count(F.lit(1)).alias("n"))
    often = told.select(F.explode("top").alias("x"), "n").filter(F.col("x.count") > F.col("n") / most).select(F.col("x.item").alias("h1"))
    return rows.join(F.broadcast(often), "h1", "left_semi").groupBy("h1", "h2").agg(F.min("id").alias("owner"))


def dropped_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, d1, d2, pos) of the lines that go."""
    rows = stored(line_rows(df, key, text), "lines")
    common = F.broadcast(common_lines(rows))
    # Ranges of the hash; within a partition sorted by hash, document, position. The first row of a hash is its owner's.
    order = Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = rows.join(common, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").withColumn("owner", F.first("id").over(order))
    both = rare.unionByName(rows.join(common, ["h1", "h2"]).select(*rare.columns))
    return both.filter(~F.col("id").eqNullSafe(F.col("owner"))).select("id", "d1", "d2", "pos")


def keep_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, d1, d2, keep) of every document that loses lines: its id, its text's digest, and which lines stay.

    keep holds words of 64 lines: bit b of word w is line 64 * w + b, set if it stays. Words that are not listed keep all.
    """
    words = dropped_lines(df, key, text).groupBy("id", "d1", "d2", F.expr("pos div 64").cast("int").alias("word")).agg(F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("id", "d1", "d2").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _without_dropped(lines: str, keep: str) -> Column:
    """The lines that stay: the stretches between dropped ones, in time proportional to the lines."""
    gone = f"flatten(transform({keep}, w -> transform(filter(sequence(0, 63), b -> (shiftright(w.bits, b) & 1L) = 0), b -> w.word * 64 + b)))"
    stretches = f"transform(concat(g.gone, array(size({lines}))), (x, i) -> slice({lines}, coalesce(get(g.gone, i - 1), -1) + 2, x - coalesce(get(g.gone, i - 1), -1) - 1))"
    return F.expr(f"flatten(flatten(transform(array(named_struct('gone', {gone})), g -> {stretches})))")


def _joined(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, text, keep): every row of df as a struct, its text, and its bitmap (null: all lines stay)."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), *_digest(F.col(f"`{text}`")))
    bits = keep_bitmaps(df, key, text).select(F.col("id").alias("id_"), F.col("d1").alias("d1_"), F.col("d2").alias("d2_"), "keep")
    return rows.join(bits, F.col("id").eqNullSafe(F.col("id_")) & (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_")), "left").select("row", "text", "keep")


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the dropped lines cut from its texts; texts that lose none, null ones too, stay as they are."""
    cut = _joined(df, key, text).withColumn("lines", _lines(F.col("text")))
    new = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(_without_dropped("lines", "keep"), "\n"))
    return cut.select(*[(new if c == text else F.col("row").getField(c)).alias(c) for c in df.columns])


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: the key, how many lines it has and loses, and the digest of what stays."""
    cut = _joined(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", "text").withColumn("lines", _lines(F.col("text")))
    dropped = F.when(F.col("keep").isNull(), F.lit(0)).otherwise(F.expr("aggregate(keep, 0L, (n, w) -> n + bit_count(~w.bits))"))
    kept = F.when(F.col("keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_without_dropped("lines", "keep"), "\n"))
    return cut.select(F.col("row.key").alias(key), F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))
