"""Folds and upserts: batch and stream give what a plain log reader gives, in any order of events, repeated batches included."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from foliolens.operators import corpora, queues
from foliolens.streaming import folds

EVENT = "key string, seq long, type string, answer string, text string, choice string"


def plain_answers(events):
    """The log read in order, with two maps and a set."""
    answers, notes, skipped, seen = {}, {}, set(), set()
    for key, _, kind, answer, text, choice in sorted(events, key=lambda e: e[1]):
        seen.add(key)
        if kind == "answer":
            if answer == "alt" and text in ("", "photo.jpg", "image 2"):
                continue  # refused
            answers[key] = (answer, text, choice)
            notes[key] = {"ab": "alt-text-too-short", "Figure 3 of x": "figure-label"}.get(text) if answer == "alt" else None
            skipped.discard(key)
        elif kind == "skip":
            skipped.add(key)
        elif kind == "revisit":
            answers.pop(key, None)
            notes.pop(key, None)
    return {k: (*answers.get(k, (None, None, None)), notes.get(k), k in skipped) for k in seen}


def log(seed, n=400, keys=40):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        kind, answer = rng.choice(["answer", "answer", "skip", "revisit", "jump"]), rng.choice(["alt", "alt", "decorative", "table-headers"])
        given = kind == "answer"
        out.append((f"k{rng.randrange(keys)}", seq, kind, answer if given else None, rng.choice(["A cell wall in spring", "", "photo.jpg", "image 2", "ab", "Figure 3 of x"]) if given and answer == "alt" else None, "row" if given and answer == "table-headers" else None))
    rng.shuffle(out)
    return out


def folded(rows):
    return {r["key"]: (r["answer"], r["text"], r["choice"], r["note"], r["skipped"]) for r in rows}


def test_answers_fold(spark):
    events = log(1)
    assert folded(queues.fold_answers(spark.createDataFrame(events, EVENT)).collect()) == plain_answers(events)
    assert queues.fold_answers(spark.createDataFrame([], EVENT)).collect() == []


def test_answers_fold_of_a_stream_out_of_order(spark, tmp_path):
    events = log(2)
    for i in range(0, len(events), 100):
        spark.createDataFrame(events[i : i + 100], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = queues.fold_answers(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    sink = str(tmp_path / "out")
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(sink)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert folded(spark.read.parquet(sink).collect()) == plain_answers(events)


def test_over_limit_in_batch_and_stream(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(3)}", begin + datetime.timedelta(seconds=rng.randrange(600))) for _ in range(400)]
    rows.append(("late", begin + datetime.timedelta(days=1)))  # moves the watermark past all windows
    spark.createDataFrame(rows, "client string, ts timestamp").write.parquet(str(tmp_path / "in"))
    expected = {}
    for client, ts in rows:
        slot = (client, ts.replace(second=0))
        expected[slot] = expected.get(slot, 0) + 1
    expected = {(c, t, n) for (c, t), n in expected.items() if n > 13}
    assert expected
    assert {tuple(r) for r in queues.over_limit(spark.read.parquet(str(tmp_path / "in")), "client", "ts", 13).collect()} == expected
    stream = folds.over_limit_stream(spark.readStream.schema("client string, ts timestamp").parquet(str(tmp_path / "in")), "client", "ts", 13)
    sink = str(tmp_path / "out")
    stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    assert {tuple(r) for r in spark.read.parquet(sink).collect()} == expected


PAGE = "page_id long, version int, html string"


def test_upserts(spark, tmp_path):
    compiled = []

    def compile_(df):
        compiled.append(sorted(r["page_id"] for r in df.select("page_id").collect()))
        return df.select("page_id", F.upper("html").alias("html"))

    arriving, sink = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: folds.upsert_pages(spark.readStream.schema(PAGE).parquet(arriving), compile_, sink, str(tmp_path / "cp"), buckets=4).awaitTermination(240)
    kept = lambda: sorted((r["page_id"], r["version"], r["html"]) for r in folds.read_upserted(spark, sink).collect())
    arrive = lambda *rows: spark.createDataFrame(list(rows), PAGE).coalesce(1).write.mode("append").parquet(arriving)
    arrive((1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (1, 2, "a2"))
    run()
    assert kept() == [(1, 2, "A2"), (2, 1, "B"), (3, 1, "C")] and compiled == [[1, 2, 3]]
    arrive((1, 3, "a3"), (1, 4, "a4"), (2, 5, "b"), (3, 0, "old"), (9, 1, "new"))
    run()
    assert kept() == [(1, 4, "A4"), (2, 5, "B"), (3, 1, "C"), (9, 1, "NEW")] and compiled[1:] == [[1, 9]]
    arrive((2, 3, "late, after its bytes came back"), (3, 1, "other bytes, no newer"))
    run()
    assert kept() == [(1, 4, "A4"), (2, 5, "B"), (3, 1, "C"), (9, 1, "NEW")] and compiled[2:] == [[]]


def test_a_batch_that_fails_and_is_repeated(spark, tmp_path):
    arriving, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, 1, f"p{i}") for i in range(20)], PAGE).write.parquet(arriving)
    calls = []

    def failing(df):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return df.select("page_id", "html")

    run = lambda: folds.upsert_pages(spark.readStream.schema(PAGE).parquet(arriving), failing, sink, str(tmp_path / "cp"), buckets=4).awaitTermination(240)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert folds.read_upserted(spark, sink).count() == 20 and len(calls) == 2
    # The same batch once more: its staged buckets are put in place again, nothing is compiled.
    again = lambda: folds.upsert_pages(spark.readStream.schema(PAGE).parquet(arriving), failing, sink, str(tmp_path / "cp2"), buckets=4).awaitTermination(240)
    again()
    assert folds.read_upserted(spark, sink).count() == 20 and len(calls) == 2


def walk(seeds, links, content, budget):
    """A recursive walk in pre-order; None over the budget."""
    seen, kept = [], []

    def visit(url):
        if url in seen:
            return
        if len(seen) >= budget:
            raise OverflowError
        seen.append(url)
        if not links.get(url) or url in content:
            kept.append(url)
        for child in links.get(url, []):
            visit(child)

    try:
        for url in seeds:
            visit(url)
    except OverflowError:
        return None
    return kept


def test_crawl_equals_a_walk_in_pre_order(spark):
    rng = random.Random(4)
    seeds, links, expected, content = [], [], {}, []
    for chapter in range(40):
        n = rng.randrange(2, 12)
        names = [f"{chapter}-{i}" for i in range(n)]
        own = {u: rng.sample(names, rng.randrange(0, min(n, 4))) for u in names}
        first = rng.sample(names, rng.randrange(1, 3))
        held = {u for u in names if rng.random() < 0.5}
        seeds += [(chapter, u, i) for i, u in enumerate(first)]
        links += [(u, v, i) for u, vs in own.items() for i, v in enumerate(vs)]
        content += [(u,) for u in held]
        expected[chapter] = walk(first, own, held, 8)
    rows = corpora.crawl(spark.createDataFrame(seeds, "chapter int, url string, ord int"), spark.createDataFrame(links, "src string, dst string, ord int"), spark.createDataFrame(content, "url string"), 8).collect()
    got, errors = {}, {}
    for r in sorted(rows, key=lambda r: (r["chapter"], r["n"] or 0)):
        if r["error"]:
            errors[r["chapter"]] = r["error"]
        else:
            got.setdefault(r["chapter"], []).append(r["url"])
    assert errors == {c: "more than 8 pages" if k is None else "no readable pages" for c, k in expected.items() if not k}
    assert got == {c: k for c, k in expected.items() if k} and "more than 8 pages" in errors.values()


def test_upserts_sort_small_partitions(spark, tmp_path, monkeypatch):
    """A batch is dealt out by key before it is sorted, in more partitions than it arrives in; each page still ends up as its last version."""
    import glob

    rows = spark.range(400).selectExpr("id % 100 AS page_id", "id AS version", "concat('<p>', id) AS html")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    folds.upsert_pages(stream, lambda df: df.select("page_id", "html"), out, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r["page_id"]: r["version"] for r in folds.read_upserted(spark, out).collect()} == {i: 300 + i for i in range(100)}
    assert len(glob.glob(f"{out}/changed/batch=0/part-*")) > 4
