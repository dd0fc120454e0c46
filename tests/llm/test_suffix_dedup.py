import hashlib
import random
from collections import Counter

import pytest

from foliolens.llm import suffix_dedup

SCHEMA = "doc_id long, text string, spans string"


def brute(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        cut = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cut[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(d, cut, strict=True) if not c)
        spans = sum(c and not p for p, c in zip(b"\0" + cut, cut, strict=False))
        out.append((len(d), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randrange(30, 120)) for _ in range(6)]
    texts = ["", None, "short", "a" * 199, "b" * 200, "c" * 201, "ab" * 400, prose(40)]
    for _ in range(60):
        parts = [prose(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            begin = rng.randrange(0, len(s) // 2)
            parts += [s[begin : begin + rng.randrange(150, 600)], prose(rng.randrange(0, 40))]
        texts.append("".join(parts))
    near = prose(150)
    for _ in range(12):
        i = rng.randrange(len(near))
        texts.append(near[:i] + rng.choice(["x", "", "éé"]) + near[i + 1 :])
    texts += [texts[12], texts[13], texts[13], near, near]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "limit"), [(1, 40_000), (2, 5)])
def test_equals_brute_force(spark, seed, limit):
    texts = texts_with_repeats(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(df, merged_in_task=limit).collect()}
    expected = brute(texts, 200)
    for i, t in enumerate(texts):
        assert rows[i] == expected[i], (i, t)


def test_rows_and_columns(spark):
    df = spark.createDataFrame([(None, "é" * 150, "x"), (1, "é" * 150, "y"), (2, None, "z")], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.digests(df).collect()) == [(0, 300), (1, 300), (2, 0)]
    cut = suffix_dedup.cut_repeats(df)
    assert cut.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["spans"]) for r in cut.collect() if r["text"] is not None) == [(0, "", "x"), (1, "", "y")]
    assert suffix_dedup.digests(df.limit(0)).collect() == []


def test_common_names_are_counted_apart(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LOOKED_AT", 1)
    monkeypatch.setattr(suffix_dedup, "COMMON", 3)
    texts = texts_with_repeats(3)
    texts += [f"start {i} " + texts[12] * 2 + f" end {i}" for i in range(9)]  # the same neighbourhoods in different texts
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    distinct = df.filter("octet_length(text) >= 200").groupBy("text").count().selectExpr("text", "count AS n", "xxhash64(text) AS text_key")
    assert all(suffix_dedup._common(distinct, 200, suffix_dedup.GRAM))
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(df).collect()}
    assert list(rows[i] for i in range(len(texts))) == brute(texts, 200)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "é" * 150, 7, "s", b"r"), (2, "é" * 150, 7, "s", b"r"), (3, "short", 7, "s", b"r")], "doc_id long, text string, _id int, _spans string, row binary")
    cut = suffix_dedup.cut_repeats(df)
    assert cut.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["_id"], r["_spans"], bytes(r["row"])) for r in cut.collect()) == [(1, "", 7, "s", b"r"), (2, "", 7, "s", b"r"), (3, "short", 7, "s", b"r")]
    assert suffix_dedup.cut_repeats(df.limit(0)).collect() == []
