import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from foliolens.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(docs):
    """(id, lines, dropped, digest) of every row, by a dictionary of keys."""
    order = lambda i: (i is None, i)
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 10:
                held[key_of(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key_of(x)) < 10 or len(held[key_of(x)]) < 2 or min(held[key_of(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    pool = ["a common line of text", "  A Common LINE of text\t", "É is not é here", "é is not é here", "short", "", " \x0b\x0c ", "ninechars", "ten chars!", "日本語日本語日本語日", " wide blank stays"] + [f"line number {k} stands" for k in range(40)]
    return [(rng.choice([rng.randrange(30), None]) if rng.random() < 0.2 else i, "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 70, 300])))) for i in range(n)]


def test_equals_brute_force(spark):
    docs = [*made(5, 60), (3, None), (4, ""), (7, "\n"), (9, "a common line of text\n" * 200), (None, None)]
    docs += docs[:5]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, keep int, h1 string")
    assert sorted((tuple(r) for r in line_dedup.digests(df).collect()), key=str) == plain(docs)
    cut = line_dedup.drop_repeats(df)
    assert cut.columns == df.columns
    got = sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut.collect()), key=str)
    assert got == sorted(((i, h) for i, _, _, h in plain(docs)), key=str)


def test_common_lines_and_ranges_agree(spark, monkeypatch):
    docs = made(8, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = plain(docs)
    common = line_dedup.common_lines(line_dedup.line_rows(df)).collect()
    assert 0 < len(common) <= line_dedup.COMMON_PER_PARTITION * 4
    monkeypatch.setattr(line_dedup, "common_lines", lambda rows: rows.limit(0).select("h1", "h2", F.col("id").alias("owner")))
    assert sorted((tuple(r) for r in line_dedup.digests(df).collect()), key=str) == expected


def test_bitmaps_hold_only_words_with_dropped_lines(spark):
    long = "\n".join(f"unique line {k}" for k in range(1000))
    df = spark.createDataFrame([(1, "this line repeats"), (2, long + "\nthis line repeats")], "doc_id long, text string")
    (row,) = line_dedup.keep_bitmaps(df).collect()
    assert row.id == 2 and [(w.word, w.bits) for w in row.keep] == [(1000 // 64, ~(1 << (1000 % 64)))]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.digests(df).collect() == [] and line_dedup.drop_repeats(df).collect() == []


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.digests(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
