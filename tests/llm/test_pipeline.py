import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from foliolens.llm import packing, quality_rules, suffix_dedup, toxicity

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_ngram_jaccard  # noqa: E402
import test_quality_rules  # noqa: E402
import test_toxicity  # noqa: E402


def build(spark, folder):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(150):
        text = prose(rng.randrange(80, 200))
        toxic = i % 5 == 0
        if toxic:
            text += " grumblefoot " + prose(5) + " grumblefoots"
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    passage = prose(70)
    rows += [(200 + k, prose(90) + " " + passage + " " + prose(60)) for k in range(4)]
    rows += [(300, rows[1][1]), (301, rows[2][1] + " extra")]
    rows += [(400 + k, " ".join(word().upper() + "!!###" for _ in range(100))) for k in range(10)]
    rows += [(500, None), (501, ""), (None, prose(90))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = build(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        if name != "best_fit_packing":
            assert docs.columns == columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {i for i, t in rows if t and "grumblefoot" in t}
    assert set(kept["toxicity"]) == {i for i, _ in rows} - toxic
    assert set(kept["quality_rules"]) == set(kept["toxicity"]) - {500, 501} - set(range(400, 410))
    assert set(kept["ngram_jaccard"]) == set(kept["quality_rules"]) - {300, 301}
    assert set(kept["suffix_dedup"]) == set(kept["ngram_jaccard"])
    for k in range(200, 204):
        assert passage[20:-20] not in kept["suffix_dedup"][k] and kept["suffix_dedup"][k]
    clean = kept["ngram_jaccard"].keys() - set(range(200, 204))
    assert all(kept["suffix_dedup"][i] == kept["ngram_jaccard"][i] for i in clean)
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == set(kept["suffix_dedup"])
    assert suffix_dedup.LENGTH == 200
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in again.collect()) == sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in packed)


def test_empty_tables_pass_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, row int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
        if name != "best_fit_packing":
            assert docs.columns == columns
            docs = spark.createDataFrame([], schema)


def plain_votes(text):
    """The rules' votes on a text, counted word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    (n, chars, symbols, dup, repeats, failed) = test_quality_rules.brute(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    letters, upper = len(regex.findall(r"\p{L}", text or "")), len(regex.findall(r"\p{Lu}", text or ""))
    plain = sum(bool(regex.fullmatch(r"""[("'«„“]?[\p{L}\p{M}\p{N}'’.-]+[.,;:!?)"'»“”…]?""", w)) for w in words)
    shouts = (text or "").count("!!")
    share = lambda a, b: a / b if b else None
    votes = {
        "long_enough": (n >= 50, n < 20), "word_length": (n and 3 <= chars / n <= 10, not n or not 2 <= chars / n <= 14), "few_symbols": (n and symbols / n <= 0.02, n and symbols / n > 0.1),
        "few_repeats": (n and repeats / n <= 0.15, n and repeats / n > 0.4), "new_lines": (lines > 1 and dup / lines <= 0.1, lines and dup / lines > 0.5), "few_shouts": (n and shouts / n <= 0.01, n and shouts / n > 0.1),
        "lower_case": (letters and upper / letters <= 0.2, letters and upper / letters > 0.5), "letters": (chars and letters / chars >= 0.93, share(letters, chars) is not None and letters / chars < 0.8), "plain_words": (n and plain / n >= 0.8, n and plain / n < 0.6),
    }
    return failed, {k: 1 if good else 0 if bad else None for k, (good, bad) in votes.items()}


def plain_pipeline(rows, model):
    """The five stages one text at a time; (id, piece, start, length, crc) of the packed pieces."""
    rows = [(i, t) for i, t in rows if 1 / (1 + math.exp(-(model.intercept + sum(float(model.weights[b]) * math.log1p(n) for b, n in test_toxicity.buckets(t or "").items())))) < 0.5]
    judged = [(i, t, votes) for i, t in rows for failed, votes in [plain_votes(t)] if not failed]
    names = list(judged[0][2])
    on, good = test_quality_rules.plain_em([v for *_, v in judged], names, quality_rules.STEPS)
    kept = []
    for i, t, votes in judged:
        is_good, is_bad = good, 1 - good
        for k, vote in votes.items():
            if vote is not None:
                is_good *= on[k][0] if vote else 1 - on[k][0]
                is_bad *= 1 - on[k][1] if vote else on[k][1]
        if is_good >= is_bad:
            kept.append((i, t))
    classes = test_ngram_jaccard.brute(kept)
    kept = [(i, t) for (i, t), (_, class_id, _) in zip(kept, classes, strict=True) if class_id in (i, None)]
    datas = [t.encode() for _, t in kept]
    seen = Counter(d[a : a + 200] for d in datas for a in range(len(d) - 199))
    library, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for (i, _), d in zip(kept, datas, strict=True):
        gone = {b for a in range(len(d) - 199) if seen[d[a : a + 200]] > 1 for b in range(a, a + 200)}
        text = bytes(x for a, x in enumerate(d) if a not in gone).decode()
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        for k, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            out.append((i, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    return out


def test_equals_a_plain_version(spark, tmp_path):
    rows, _ = build(spark, tmp_path)
    documents, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = plain_pipeline(rows, toxicity.train(documents, labels))
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=str) == sorted(expected, key=str) and len(expected) > 100
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        ends = [0, *[o + n for o, n in sorted(held)]]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(n for *_, n, _ in expected) // 2048) + 1
