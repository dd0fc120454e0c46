"""The batch folds as Structured Streaming jobs, and pages kept up to date as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fold_latest(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """A stream of the latest event per key, as updates: state holds one (order, kind) per key, so late events change nothing."""
    kinds = dict(events.dtypes)

    def update(keys, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        before = best
        for batch in batches:
            row = batch.loc[batch[order].idxmax()]
            if best is None or row[order] > best[0]:
                best = (row[order].item(), str(row[kind]))
        if best != before:
            state.update(best)
            yield pd.DataFrame({key: [keys[0]], order: [best[0]], kind: [best[1]]})

    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{kind}` string"
    return events.select(key, order, kind).groupBy(key).applyInPandasWithState(update, schema, f"`{order}` {kinds[order]}, `{kind}` string", "update", "NoTimeout")


def over_limit_stream(events: DataFrame, client: str, ts: str, limit: int = 60, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Fixed windows with more than `limit` requests, emitted when the watermark has passed them."""
    counted = events.withWatermark(ts, late).groupBy(client, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > limit).select(client, F.col("w.start").alias("begin"), "n")


def stream_pages(pages: DataFrame, compile_: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Compiles new pages as they arrive; each batch is written under its number, so a repeated batch overwrites itself. Pages that come again, changed, go through upsert_pages()."""

    def write(batch: DataFrame, number: int) -> None:
        compile_(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _has(spark: SparkSession, pattern: str) -> bool:
    files, at = _files(spark, pattern)
    return len(files.globStatus(at) or []) > 0


def read_upserted(spark: SparkSession, sink: str) -> DataFrame:
    """The pages that upsert_pages() keeps, one row a key."""
    return spark.read.parquet(f"{sink}/pages").drop("bucket")


#: Partitions by key that a batch's input partition is dealt out to: each is sorted, so a split of millions of rows would be sorted at once.
DEALT = 16


def upsert_pages(pages: DataFrame, compile_: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "page_id", order: str = "version", buckets: int = 64, **trigger) -> StreamingQuery:
    """Keeps compiled pages (key, order, digest and what compile_ adds) by key in `sink`, as pages (key, order, html) arrive.

    Of a batch, the row of the highest order counts for each key. Pages of the bytes that the sink has only raise its order, late ones, of an order not above the sink's, change nothing; neither is compiled.
    The sink is cut into buckets of keys; a batch reads key, order and digest of the buckets that it touches and replaces only those that change.
    A batch's new buckets are first written whole under its number. A batch that is repeated finds them and puts them in place again, so that
    a failure at any point loses nothing and nothing is done twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changes, staged, held = f"{sink}/changed/batch={number}", f"{sink}/staged/batch={number}", f"{sink}/pages"
        for folder in (f"{sink}/changed/batch={number - 1}", f"{sink}/staged/batch={number - 1}"):  # in place since that batch ended
            files, at = _files(spark, folder)
            files.delete(at, True)
        if not _has(spark, f"{staged}/_SUCCESS"):
            bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
            rest = [c for c in batch.columns if c != key]
            rows = batch.repartition(DEALT * batch.rdd.getNumPartitions(), key)
            new = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, F.sha2("html", 256))).alias("p")).select(key, "p.*", F.sha2("p.html", 256).alias("digest"), bucket)
            old = spark.read.parquet(held) if _has(spark, f"{held}/bucket=*") else None
            new = new.withColumn("same", F.lit(False))
            if old is not None:
                known = old.select(key, "bucket", F.col(order).alias("_order"), F.col("digest").alias("_digest"))
                new = new.join(known, [key, "bucket"], "left").filter(F.col("_order").isNull() | (F.col(order) > F.col("_order"))).withColumn("same", F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False))).drop("_order", "_digest")
            new.write.mode("overwrite").parquet(changes)
            newer = spark.read.schema(new.schema).parquet(changes)
            changed = newer.filter("NOT same")
            made = compile_(changed.select(key, *rest)).join(changed.select(key, order, "digest", "bucket"), key)
            if old is not None:
                later = newer.filter("same").select(key, F.col(order).alias("_later"))
                stays = old.join(newer.select("bucket").distinct(), "bucket", "left_semi").join(changed.select(key), key, "left_anti").join(later, key, "left")
                made = made.unionByName(stays.withColumn(order, F.coalesce("_later", order)).select(*made.columns))
            made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
        if _has(spark, f"{staged}/bucket=*"):
            spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(held)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
