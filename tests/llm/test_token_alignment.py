import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from foliolens.llm import token_alignment as T

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def byte_letters():
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def plain(texts):
    """Rows as the libraries encode whole texts, every link written out."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = byte_letters()
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", p)) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids[1])]
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            found.append(None)
            continue
        groups, held = [], ([], [])
        place, ends = [0, 0], [0, 0]
        while place[0] < len(ids[0]) or place[1] < len(ids[1]):
            side = 0 if ends[0] <= ends[1] else 1
            held[side].append(ids[side][place[side]])
            ends[side] += len(raw[side][place[side]])
            place[side] += 1
            if ends[0] == ends[1]:
                groups.append(held)
                held = ([], [])
        found.append((len(ids[0]), len(ids[1]), groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    count = Counter(pair for f in found if f for pair in set(f[3]))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, f in enumerate(found):
        if not f:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in f[2])
        out.append((i, f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == most[p[0]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out


def made(seed, n):
    rng = random.Random(seed)
    parts = ["the", " cat", "  ", "\n", "naïve", "日本語", "\t", "🙂", "<|endoftext|>", "<s>", "<0x41>", "don't", "1234567", " ", "\x00", "ﬁ", "Straße", "aaaaaaaaa", "...", "　", "​", " x", "antidisestablishment"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(n)]


def rows(spark, texts):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, key int, number string")
    return sorted(tuple(r) for r in T.links(df, *PATHS).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


TEXTS = [*made(4, 120), "", None, " ", "   ", "the ", "blank sign ▁ inside", "▁", "the cat sat", "the cat sat", "a" * 5000, "word " * 3000, "日" * 400, " " * 300 + "x"]


def test_equals_brute_force(spark):
    assert rows(spark, TEXTS) == plain(TEXTS)


def test_rare_pairs_by_join_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(T, "COMMON", 20)
    monkeypatch.setattr(T, "LARGE_GROUP", 2)
    assert rows(spark, TEXTS) == plain(TEXTS)


def test_large_groups_are_not_written_out():
    aligner = T.Aligner(*PATHS)
    rng = random.Random(1)
    import numpy as np

    a, b = (np.array([rng.randrange(50) for _ in range(n)]) for n in (3000, 2000))
    cut = np.array([0, 3000]), np.array([0, 2000])
    code, many = aligner.pairs(a, b, *cut)
    expected = Counter(x * aligner.most_b + y for x in a.tolist() for y in b.tolist())
    assert dict(zip(code.tolist(), many.tolist(), strict=True)) == expected


def test_words_equal_the_library():
    words = T.Words(PATHS[1])
    texts = made(9, 2000)
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert ids is not None and ids.tolist() == words.model.encode(text)


def test_empty_table_and_repeated_keys(spark):
    assert rows(spark, []) == []
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = T.links(df, *PATHS).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and all(r.n_a for r in got)


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 30)
    words = T.Words(PATHS[1])
    for k in range(0, 200, 10):
        texts = [f"w{k + i} ▁ x{k}" if i == 3 else f"w{k + i} common x{k}" for i in range(10)]
        for i, (text, ids) in enumerate(zip(texts, words.ids(texts), strict=True)):
            assert (ids is None) == (i == 3) and (ids is None or ids.tolist() == words.model.encode(text))
