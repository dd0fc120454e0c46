"""Page files: repeated, killed and shrinking writes leave exactly the planned files."""

import os

import pytest
from pyspark.sql import functions as F

from foliolens.plans import catalog
from foliolens.sources import bundles

SCHEMA = "chapter string, slug string, title string, html string"


def files(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), encoding="utf-8").read() for d, _, names in os.walk(root) for n in names if n != "_SUCCESS" and not n.endswith(".crc")}


def rows(n, title="T & <t>"):
    return [(f"c{i % 3}", f"p-{i}", title, f"<p>{i}</p>") for i in range(n)]


def planned(made):
    return {f"{c}/{s}.html": f'<html><head><title>{t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")}</title><meta name="identifier" content="{s}"></head><body>{h}</body></html>' for c, s, t, h in made}


def test_writes(spark, tmp_path):
    path = str(tmp_path / "bundle")
    bundles.write_pages(spark.createDataFrame(rows(50), SCHEMA).repartition(4), path)
    assert files(path) == planned(rows(50)) and open(f"{path}/_SUCCESS").read() == "50"
    bundles.write_pages(spark.createDataFrame(rows(20, "new"), SCHEMA), "file://" + path)
    assert files(path) == planned(rows(20, "new"))
    bundles.write_pages(spark.createDataFrame([], SCHEMA), path)
    assert files(path) == {} and os.listdir(tmp_path) == ["bundle"]


def test_a_killed_write_leaves_the_bundle_and_the_next_one_repairs(spark, tmp_path):
    path = str(tmp_path / "bundle")
    bundles.write_pages(spark.createDataFrame(rows(10), SCHEMA), path)
    broken = spark.createDataFrame(rows(60, "x"), SCHEMA).repartition(6, "slug").withColumn("html", F.when(F.col("slug") == "p-33", F.raise_error(F.lit("lost"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="lost"):
        bundles.write_pages(broken, path)
    assert files(path) == planned(rows(10))
    # A driver that dies can't clean up: what it leaves goes with the next write.
    os.makedirs(f"{path}.new-dead/c0")
    open(f"{path}.new-dead/c0/p-1.html", "w").close()
    bundles.write_pages(spark.createDataFrame(rows(60, "x"), SCHEMA).repartition(6), path)
    assert files(path) == planned(rows(60, "x")) and os.listdir(tmp_path) == ["bundle"]


def test_an_attempt_twice_at_a_time(tmp_path, monkeypatch):
    writer = bundles.PageWriter(str(tmp_path / "b"))
    numbers = iter([7, 8, 9])
    monkeypatch.setattr(bundles, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"taskAttemptId": lambda self: next(numbers)})())}))
    made = [dict(zip(bundles.COLUMNS, r, strict=True)) for r in rows(9)]
    first = writer.write(iter(made[:5]))
    with pytest.raises(ValueError):
        writer.write(iter([*made[5:7], {**made[0], "slug": "../x"}]))
    writer.commit([first, writer.write(iter(made[5:])), None])
    assert files(tmp_path / "b") == planned(rows(9)) and os.listdir(tmp_path) == ["b"]


@pytest.mark.parametrize("mode", ["append", "error"])
def test_only_whole_bundles(spark, tmp_path, mode):
    spark.dataSource.register(bundles.PageBundle)
    with pytest.raises(Exception, match="written whole|page_bundle|mode"):
        spark.createDataFrame(rows(1), SCHEMA).write.format("page_bundle").mode(mode).save(str(tmp_path / "b"))


def test_a_bundle_is_read_in_few_tasks(spark, tmp_path):
    """As many as its files ask for by their number, where Spark's file index makes one of some 30 files each; with no file left out."""
    path = str(tmp_path / "bundle")
    for made in (rows(500), []):
        bundles.write_pages(spark.createDataFrame(made, SCHEMA).repartition(4), path)
        found = bundles.read_pages(spark, path)
        assert {f"{r['chapter']}/{r['name']}": bytes(r["content"]).decode() for r in found.collect()} == planned(made)
    assert catalog.QUERIES["pages_bundled"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_files_are_made_where_they_stay(tmp_path, monkeypatch):
    """No file of a first attempt is moved; what a broken or slower attempt left at a place is replaced whole."""
    moved = []
    monkeypatch.setattr(bundles.os, "replace", lambda a, b, replace=os.replace: (moved.append(os.path.basename(b)), replace(a, b)))
    monkeypatch.setattr(bundles, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"taskAttemptId": lambda self: len(moved)})())}))
    writer, made = bundles.PageWriter(str(tmp_path / "b")), [dict(zip(bundles.COLUMNS, r, strict=True)) for r in rows(9)]
    os.makedirs(f"{writer.path}.new-{writer.job}/c1")
    open(f"{writer.path}.new-{writer.job}/c1/p-4.html", "wb").write(b"<html><he")
    told = writer.write(iter(made))
    assert moved == ["p-4.html"] and told.pages == 9
    writer.commit([told])
    assert files(tmp_path / "b") == planned(rows(9)) and os.listdir(tmp_path) == ["b"]
