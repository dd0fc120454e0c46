import math
import random
import re
from collections import Counter

from foliolens.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """Rows by scoring every document for every item."""
    held = [(i, terms(t)) for i, t in docs]
    total, length = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(w for _, words in held for w in set(words))
    out = []
    for item, text in items:
        scored = []
        for i, words in held:
            tf, m = Counter(words), 75 + (25 * len(words) * total) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in terms(text) if tf[w])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k=5):
    d = spark.createDataFrame([(i, t, 7, "z") for i, t in docs], "doc_id long, text string, rank int, score string")
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, id int")
    return sorted((tuple(r) for r in ranked_search.search(d, q, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    words = ["the", "The", "naïve", "日本", "x1", "of", "a_b", "it's", "É", "é"] + [f"w{i}" for i in range(30)]
    docs = [(rng.choice([i, i, i, None, 3]), " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 4, 40])))) for i in range(120)]
    docs += [(200 + i, docs[i % 7][1]) for i in range(60)]  # classes with more members than are asked for
    items = [(i % 9, " ".join(rng.choices(words + ["unseen"], k=rng.choice([1, 3, 12])))) for i in range(12)]
    return [*docs, (None, None), (5, "")], [*items, (50, None), (51, ""), (52, items[0][1])]


def test_equals_brute_force(spark):
    docs, items = made(1)
    assert got(spark, docs, items) == plain(docs, items, 5)


def test_blocks_and_whole_numbers(spark, monkeypatch):
    docs, items = made(2)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(ranked_search, "COLUMNS", 3)
    monkeypatch.setattr(ranked_search, "_EXACT", 0)
    assert got(spark, docs, items, 3) == plain(docs, items, 3)


def test_ties_by_ascending_id(spark):
    docs = [(i, "word" if i % 2 else "word other") for i in range(40, 0, -1)] + [(None, "word")]
    assert [r[2] for r in sorted(got(spark, docs, [(1, "word")], 30), key=lambda r: r[1])][:20] == list(range(1, 40, 2))
    assert got(spark, docs, [(1, "word")], 100) == plain(docs, [(1, "word")], 100)


def test_terms():
    assert [t.decode() for t in ranked_search.terms_of("A-b É_é x\x7fY 日本 9z")] == terms("A-b É_é x\x7fY 日本 9z")


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, "a")], []) == []
