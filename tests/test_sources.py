"""Readers, writers and page compilation."""

import json

import pytest
from pyspark.sql import functions as F

from foliolens.operators import compiling, corpora, decks
from foliolens.sources import files
from foliolens.streaming import folds


def test_catalog_keeps_valid_books(spark, tmp_path):
    books = [{"source": "s", "slug": "https://a/b", "title": "T", "authors": []}, {"source": "s", "slug": "ftp://x", "title": "T", "authors": []}, {"source": "s", "slug": "https://a", "title": " ", "authors": []}, {"source": "t", "slug": "https://a", "title": "T", "authors": []}, {"source": "s", "slug": "https://c", "title": "T"}]
    (tmp_path / "c.json").write_text(json.dumps({"books": books}))
    assert [r["slug"] for r in files.read_catalog(spark, str(tmp_path / "c.json"), "s").collect()] == ["https://a/b"]
    with pytest.raises(ValueError, match="no valid book"):
        files.read_catalog(spark, str(tmp_path / "c.json"), "none")


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\n\nb".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"  \n ")
    works, rejects = corpora.ingest_text(files.read_text_files(spark, str(tmp_path)))
    assert [(r["html"], len(r["work_id"])) for r in works.collect()] == [("<p>é</p><p>b</p>", 33)]
    assert sorted(r["reason"] for r in rejects.collect()) == ["blank", "not-utf8"]


def test_bundle(spark, tmp_path):
    targets = spark.createDataFrame([("c1", "s-1", 'A "q" & b', "<p>x</p>")], "chapter string, slug string, title string, html string")
    files.write_bundle(targets, str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row["file"] == "s-1.html" and row["chapter"] == "c1" and "<title>A \"q\" &amp; b</title>" in row["content"]


PAGES = [(1, "<h1>A</h1><h3>B</h3><p><b>x</b><a href='javascript:y'> </a>"), (2, " "), (3, "plain"), (4, "<figure><img src=a></figure>")]


def test_compile_isolates_failures_and_is_idempotent(spark):
    pages = spark.createDataFrame(PAGES, "page_id int, html string")
    done = compiling.compile_pages(pages)
    rows = {r["page_id"]: r for r in done.sections.collect()}
    assert rows[2]["error"] == "blank" and rows[3]["error"] == "no-markup" and rows[2]["html"] == rows[3]["html"] == ""
    assert rows[1]["html"] == "<h2>A</h2><h3>B</h3><p><strong>x</strong><a> </a>"
    gate = {r["page_id"]: r for r in done.gate.collect()}
    assert gate[1]["blockers"] == 2 and gate[4]["blockers"] == 2 and not gate[2]["badge_withheld"]
    again = compiling.compile_pages(done.sections.select("page_id", "html"))
    assert {r["page_id"]: r["html"] for r in again.sections.collect()} == {k: r["html"] for k, r in rows.items()}


def test_stream_compiles_what_arrives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id int, html string")
    pages.filter("page_id < 3").write.parquet(str(tmp_path / "in"))
    run = lambda: folds.stream_pages(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in")), lambda b: compiling.compile_pages(b).sections, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    pages.filter("page_id >= 3").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r["page_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]


def test_reconcile(spark):
    slides = spark.createDataFrame([("d", 1, ["Ti", "tle"], "say this", ["p1"]), ("d", 2, ["More"], "", ["p2"])], "deck_id string, number int, text_runs array<string>, notes string, picture_origins array<string>")
    blocks = spark.createDataFrame([("d", 0, "T i t l e", []), ("d", 1, "say this", []), ("d", 2, "", ["p1"]), ("d", 3, "stray", [])], "deck_id string, block_idx int, text string, picture_origins array<string>")
    rows = [(r["block_idx"], r["slide"], r["status"]) for r in decks.reconcile(slides, blocks).collect()]
    assert rows == [(0, 1, "text"), (1, 1, "notes"), (2, 1, "picture"), (3, None, "orphan"), (None, 2, "missing-text"), (None, 2, "missing-pictures")]
    assert F is not None


def test_reconcile_many_decks_in_batches(spark):
    """Decks in numbers, some of blocks only, some of slides only, one without a name; each is told alone, and no deck is a Python group of its own."""
    slides = [(d, n, [f"s{n}", f" of {d}"], None, None) for d in [*range(500), None] for n in (2, 1)]
    blocks = [(d, n - 1, f"s {n} of{d}" if n < 2 else "stray", None) for d in [*range(250, 750), None] for n in (2, 1)]
    made = decks.reconcile(spark.createDataFrame(slides, "deck_id int, number int, text_runs array<string>, notes string, picture_origins array<string>"), spark.createDataFrame(blocks, "deck_id int, block_idx int, text string, picture_origins array<string>"))
    both, alone = [(0, 1, "text"), (1, None, "orphan"), (None, 2, "missing-text")], [(0, None, "orphan"), (1, None, "orphan")]
    expected = {d: [(None, 1, "missing-text"), (None, 2, "missing-text")] for d in range(250)} | {d: both for d in [*range(250, 500), None]} | {d: alone for d in range(500, 750)}
    got: dict = {}
    for r in made.collect():
        got.setdefault(r["deck_id"], []).append((r["block_idx"], r["slide"], r["status"]))
    assert got == expected
    assert "CoGroups" not in made._jdf.queryExecution().executedPlan().toString()


def test_ingest_makes_content_once(spark):
    """Reasons of long, spoilt and blank texts, blank by any white space; content that is made by an expression stands once in the plan, not once for each use."""
    rows = [(1, 3, " "), (2, 70, "\u2003\ufeff "), (3, 300_000, "ab cdefgh"), (4, 70, " "), (5, 1, "x"), (6, 0, "x"), (7, 1, None)]
    made = spark.createDataFrame(rows, "id int, n int, s string").select("id", F.concat(F.repeat("s", F.col("n")), F.when(F.col("id") == 4, "\U0001f600").otherwise("")).cast("binary").alias("content"))
    works, rejects = corpora.ingest_text(made.unionByName(spark.createDataFrame([(8, bytearray(b"\xffx"))], "id int, content binary")))
    assert {r["id"]: r["reason"] for r in rejects.collect()} == {1: "blank", 2: "blank", 3: "too-large", 6: "blank", 8: "not-utf8"}
    assert {r["id"]: r["section_id"] is None for r in works.collect()} == {4: False, 5: False, 7: True}
    plan = corpora.ingest_text(made)[1].select("id", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(") == 1


def test_parts_are_dealt_out(spark):
    from foliolens.plans.registry import table

    assert table(spark, "/root/testdata/sf0.001", "part").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
