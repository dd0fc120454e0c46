import math
import random
import re
from collections import Counter

from foliolens.llm import quality_rules

SCHEMA = "doc_id long, text string, n_words string, kept string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n)


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "bé", "#x", "日本", "c|", "the"]
    texts = ["", None, " \n\t", "one", "a b", "a b c a b c", "x\n\nx\n \nx", "a b c", "x\x1cy z\x0bq", "\ud83d".encode("utf-8", "replace").decode(), "a b a b a b a"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", " \r\n"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += ["word " * 20000]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    rows = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), repr(t)[:80]
        assert not (r["kept"] and r["base_failed"])


def test_verdicts_and_learned_accuracies(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    good = ["\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(12)) for _ in range(60)]
    bad = [" ".join(word().upper() + "!!" for _ in range(90)) for _ in range(15)] + [" ".join(word() + "###|" for _ in range(90)) for _ in range(15)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(None, None), (1, good[1])], "doc_id long, text string")
    rows = quality_rules.judge(df).collect()
    assert len(rows) == 92
    assert all(r["kept"] == (r["doc_id"] < 60) for r in rows if r["doc_id"] is not None)
    plan = quality_rules.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality_rules.judge(df.limit(0)).collect() == []


def plain_em(rows, names, steps):
    """Expectation-maximisation as the method is defined, row by row."""
    on = {n: quality_rules.PRIOR for n in names}
    good = 0.8
    for _ in range(steps):
        chances = []
        for row in rows:
            is_good, is_bad = good, 1 - good
            for n in names:
                if row[n] is not None:
                    is_good *= on[n][0] if row[n] else 1 - on[n][0]
                    is_bad *= 1 - on[n][1] if row[n] else on[n][1]
            chances.append(is_good / (is_good + is_bad))
        good = min(0.99, max(0.01, sum(chances) / len(rows)))
        new = {}
        for n in names:
            out = []
            for right, weights, prior, (least, most) in zip((1, 0), (chances, [1 - p for p in chances]), quality_rules.PRIOR, quality_rules.BOUNDS, strict=True):
                hits = sum(w for r, w in zip(rows, weights, strict=True) if r[n] == right)
                votes = sum(w for r, w in zip(rows, weights, strict=True) if r[n] is not None)
                out.append(min(most, max(least, (hits + prior * quality_rules.PRIOR_ROWS) / (votes + quality_rules.PRIOR_ROWS))))
            new[n] = tuple(out)
        on = new
    return on, good


def test_estimates_equal_plain_em_and_move_with_the_rows(spark):
    rng = random.Random(8)
    truth = {"a": (0.97, 0.9), "b": (0.8, 0.7), "c": (0.95, 0.15)}
    rows = []
    for _ in range(1500):
        good = rng.random() < 0.7
        rows.append({n: None if rng.random() < 0.2 else int((rng.random() < p[0]) if good else (rng.random() >= p[1])) for n, p in truth.items()})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a int, b int, c int")
    got, share = quality_rules.estimate(df, list(truth), steps=6)
    expected, expected_share = plain_em(rows, list(truth), 6)
    assert math.isclose(share, expected_share, rel_tol=1e-6)
    for n in truth:
        assert all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(got[n], expected[n], strict=True))
    assert got["a"][1] > quality_rules.PRIOR[1] + 0.1 and got["b"][0] < quality_rules.PRIOR[0] - 0.01  # the rows outweigh the prior
