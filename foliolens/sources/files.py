"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.functions import text as T


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Sections from a table of pages: id, address, html. Only these columns are scanned."""
    return spark.read.parquet(path).select(F.col("page_id").cast("string").alias("section_id"), "html", F.col("url").alias("canonical_url"), F.regexp_replace("url", "[^/]*$", "").alias("content_base_url"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of text files; `content` is not read where only the length is used."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_catalog(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Book rows of JSON files with a `books` array; only valid rows. No valid row at all is an error."""
    books = spark.read.schema("books array<struct<source:string, slug:string, title:string, subject:string, license:string, authors:array<string>>>").option("multiLine", True).json(path)
    return valid_books(books.select(F.inline("books")), source)


def valid_books(books: DataFrame, source: str) -> DataFrame:
    """Rows of a source with an https slug, a title and an author array; raises when read if none is left."""
    good = books.filter((F.col("source") == source) & F.col("slug").startswith("https://") & (F.trim(F.coalesce("title", F.lit(""))) != "") & F.col("authors").isNotNull())
    if good.isEmpty():
        raise ValueError(f"no valid book of {source}")
    return good


def write_bundle(targets: DataFrame, path: str) -> None:
    """One row per page under its chapter, with a stable file name and the page's identifier and title in the file."""
    head = F.concat(F.lit("<html><head><title>"), T.escape_text("title"), F.lit('</title><meta name="identifier" content="'), T.escape_attribute("slug"), F.lit('"></head><body>'), "html", F.lit("</body></html>"))
    targets.select("chapter", F.concat("slug", F.lit(".html")).alias("file"), head.alias("content")).write.partitionBy("chapter").mode("overwrite").parquet(path)
