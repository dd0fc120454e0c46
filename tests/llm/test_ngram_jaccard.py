import random

import numpy as np
from pyspark.sql import functions as F

from foliolens.llm import ngram_jaccard
from foliolens.llm.components import components

SCHEMA = "doc_id long, text string, class_id string"


def sets(text):
    words = [w for w in __import__("re").split(r"[ \t\n\x0b\x0c\r]+", text or "") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    found = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(top(i), []).append(rows[i][0])
    return [(rows[i][0], min((m for m in members[top(i)] if m is not None), default=None), links[i]) for i in range(len(rows))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 6)))
    texts = ["", None, " \n", "one", "one", "a b c d", "a b c d e"]
    passage = [word() for _ in range(60)]
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(20, 150))]
        texts.append(" ".join(base))
        if rng.random() < 0.3:
            texts.append(" ".join(base + passage))
        for _ in range(rng.randrange(0, 5)):
            edited = list(base)
            for _ in range(rng.randrange(0, 3)):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    big = [word() for _ in range(120)]
    for _ in range(90):
        edited = list(big)
        edited[rng.randrange(120)] = word()
        texts.append(" ".join(edited))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + rows[:4]


def test_equals_brute_force(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in ngram_jaccard.join(df).collect())
    assert got == sorted(brute(rows))


def test_blocks_of_large_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 20)
    monkeypatch.setattr(ngram_jaccard, "COMPARISONS", 30)
    rows = corpus(4)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in ngram_jaccard.join(df).collect()) == sorted(brute(rows))


def test_keep_one(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "one", "y")], SCHEMA)
    kept = ngram_jaccard.keep_one(df)
    assert kept.columns == df.columns
    expected = {(c if sets(t) else i) for (i, t), (_, c, _) in zip(rows, brute(rows), strict=True)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)
    assert ngram_jaccard.join(df.limit(0)).collect() == []
    lone = spark.createDataFrame([(None, "a b c", "x"), (None, "a b c", "x"), (None, None, "x")], SCHEMA)
    assert sorted(map(str, ngram_jaccard.join(lone).collect())) == sorted(["Row(doc_id=None, class_id=None, n_links=1)"] * 2 + ["Row(doc_id=None, class_id=None, n_links=0)"])


def test_recall_at_the_threshold():
    assert ngram_jaccard.recall(0.8, steps=2) >= 0.99
    assert ngram_jaccard.recall(0.8, steps=5) >= 0.9


def test_shared_counts():
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(40)] for _ in range(2))
    assert (ngram_jaccard.shared_counts(left, right) == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).orderBy(F.col("node")).collect()
    assert [tuple(r) for r in rows] == [(i, 0) for i in range(31)] + [(100, 100), (150, 100), (200, 100)]


def test_runs_reach_the_target():
    assert ngram_jaccard.recall(0.8, runs=ngram_jaccard.runs_for(0.8, 0.99), trials=2000) >= 0.98
    assert ngram_jaccard.runs_for(0.8, 0.9) < ngram_jaccard.runs_for(0.8, 0.9999)


def test_buckets_of_many_blocks(spark, monkeypatch):
    """Buckets far over a block's size lose no pair: without bands, all near copies of one text must still meet."""
    monkeypatch.setattr(ngram_jaccard, "BUCKET_PART", 7)
    monkeypatch.setattr(ngram_jaccard, "band_edges", lambda tokens: tokens.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    rows = corpus(6)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in ngram_jaccard.join(df).collect()) == sorted(brute(rows))


def test_sides_of_a_bucket():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, ngram_jaccard.TOKENS, dtype=np.uint32)
    tokens = np.tile(base, (6, 1))
    node, side = np.arange(6), np.array([0, 0, 0, 1, 1, 1])
    edges = ngram_jaccard._star_edges(node, tokens, 100, None, side)
    assert len(edges) == 5 and all(side[a] != side[b] for a, b in edges)
    assert ngram_jaccard._star_edges(node, tokens, 100, np.zeros(6, int), side) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 7, 8, 9)], "doc_id long, text string, _id int, _key int, text_key int")
    kept = ngram_jaccard.keep_one(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 7, 8, 9)]
    assert ngram_jaccard.keep_one(df.limit(0)).collect() == []
