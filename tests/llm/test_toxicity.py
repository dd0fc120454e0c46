import math
import random
from collections import Counter

from foliolens.llm import toxicity

SCHEMA = "doc_id long, text string, score string"


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "river", "stone", "garden", "light", "paper", "cloud", "seven", "music", "table"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if toxic:
            text[rng.randrange(len(text))] = "grumblefoot" + rng.choice(["", "s", "ish"])
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    documents, labels = corpus(spark)
    rows = toxicity.scored_documents(documents, labels).join(labels, "doc_id").collect()
    fold = [r for r in rows if r["held_out"]]
    assert len(rows) == 400 and 40 < len(fold) < 120
    assert sum(r["predicted"] == r["toxic"] for r in fold) / len(fold) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows_and_labels(spark):
    documents, labels = corpus(spark, 80)
    odd = spark.createDataFrame([(None, None, "y"), (1000, "", "y"), (1000, "", "y"), (1001, "word " * 30000, None)], SCHEMA)
    labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (3, 7), (4, 1)], "doc_id long, toxic int"))
    rows = toxicity.scored_documents(documents.union(odd), labels).collect()
    assert len(rows) == 84
    empty = {r["score"] for r in rows if r["doc_id"] in (None, 1000)}
    assert len(empty) == 1
    assert toxicity.scored_documents(documents.limit(0), labels).collect() == []
    none = toxicity.scored_documents(documents, labels.limit(0)).collect()
    assert len(none) == 80 and all(r["predicted"] == 0 for r in none)


def test_score_keeps_columns(spark):
    documents, labels = corpus(spark, 80)
    scored = toxicity.score(documents, toxicity.train(documents, labels))
    assert scored.columns == ["doc_id", "text", "score"] and dict(scored.dtypes)["score"] == "double"


def buckets(text):
    """N-grams of a text with their counts, one by one."""
    text = " " + " ".join(text.lower().split()) + " "
    out = Counter()
    for size in toxicity.SIZES:
        for i in range(len(text) - size + 1):
            h = size
            for ch in text[i : i + size]:
                h = ((h ^ ord(ch)) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            out[h & (toxicity.BUCKETS - 1)] += 1
    return out


def test_scores_and_ratios_equal_brute_force(spark):
    documents, labels = corpus(spark, 120, seed=3)
    model = toxicity.train(documents, labels)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()} | {900: "", 901: "Grumblefoot é \U0001f600 x"}
    scored = toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()
    for r in scored:
        total = model.intercept + sum(float(model.weights[b]) * math.log1p(n) for b, n in buckets(texts[r["doc_id"]]).items())
        assert math.isclose(r["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-4, abs_tol=1e-6)
    # A weight is a share of its n-gram's log-count ratio, so n-grams that only toxic texts hold never lower a score.
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    only = set.union(*(set(buckets(texts[i])) for i in marks if marks[i])) - set.union(*(set(buckets(texts[i])) for i in marks if not marks[i]))
    used = [b for b in only if model.weights[b]]
    assert used and sum(model.weights[b] > 0 for b in used) > 0.9 * len(used)


def test_long_rows_keep_their_largest_features(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROW_FEATURES", 40)
    documents, labels = corpus(spark)
    rows = toxicity.scored_documents(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.9


def test_keep_clean(spark):
    documents, labels = corpus(spark, 200)
    rows = documents.selectExpr("doc_id", "text", "1 AS _toxicity", "'s' AS row", "2.0 AS score")
    kept = toxicity.keep_clean(rows, toxicity.train(documents, labels))
    assert kept.columns == rows.columns and {r["_toxicity"] for r in kept.collect()} == {1}
    assert {r["doc_id"] for r in kept.collect()} <= {i for i in range(200) if i % 4}
    assert toxicity.keep_clean(rows.limit(0), toxicity.train(documents, labels)).collect() == []


def test_repeated_ids_teach_the_same_whatever_their_order(spark):
    documents, labels = corpus(spark, 60)
    rows = [tuple(r) for r in documents.collect()] + [(i, f"another text of row {i} grumblefoot", "x") for i in range(0, 60, 3)] + [(1, None, "x")]
    texts = []
    for order in (rows, rows[::-1]):
        sample, _ = toxicity._sample(spark.createDataFrame(order, SCHEMA).repartition(5), labels, "doc_id", "text")
        texts.append({r["doc_id"]: r["text"] for r in sample.collect()})
    assert texts[0] == texts[1] and len(texts[0]) > 30
