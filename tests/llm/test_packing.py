import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foliolens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_best_two_fit_is_valid_and_tight():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 400))]
        bins, offsets = packing.best_two_fit(lengths, 100)
        held = defaultdict(list)
        for length, b, o in zip(lengths, bins, offsets, strict=True):
            held[b].append((o, length))
        for items in held.values():
            at = 0
            for o, length in sorted(items):
                assert o == at
                at += length
            assert at <= 100
        least = -(-sum(lengths) // 100)
        big = sum(x > 50 for x in lengths)
        assert len(held) <= max(least, big) * 1.1 + 2


def test_two_replace_the_smallest():
    # Greedy fills 60 + 30 and leaves a gap of 10; 22 + 18 fit the widened gap exactly.
    lengths = [60, 30, 22, 18]
    bins, _ = packing.best_two_fit(lengths, 100)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)]
    assert packing.cut(20, 10) == [(0, 10), (10, 10)]
    assert packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_ids_and_rows(spark):
    texts = ["", None, "hello world", "a <|endoftext|> b", "word " * 5000, "it's  ok\n\n x", "hello world"]
    df = spark.createDataFrame([(i % 5, t, "z") for i, t in enumerate(texts)] + [(None, "x", "z")], "doc_id long, text string, offset string")
    rows = packing.pack(df, PATH, 2048).collect()
    library = Tokenizer.from_file(PATH)
    expected = []
    for i, t in [(i % 5, t) for i, t in enumerate(texts)] + [(None, "x")]:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            expected.append((i, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in rows), key=key) == sorted(expected, key=key)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in held.values():
        at = 0
        for o, length in sorted(items):
            assert o == at
            at += length
        assert at <= 2048
    assert packing.pack(df.limit(0), PATH).collect() == []


def most_of_first(lengths, capacity):
    """Fewest sequences, by trying every way."""
    best = len(lengths)

    def place(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for g in range(len(gaps)):
            if gaps[g] >= lengths[i] and gaps[g] not in gaps[:g]:
                place(i + 1, [*gaps[:g], gaps[g] - lengths[i], *gaps[g + 1 :]])
        place(i + 1, [*gaps, capacity - lengths[i]])

    place(0, [])
    return best


def test_near_the_optimum_of_small_sets():
    rng = random.Random(11)
    more = 0
    for _ in range(60):
        lengths = sorted((rng.randrange(1, 31) for _ in range(rng.randrange(1, 9))), reverse=True)
        used = max(packing.best_two_fit(lengths, 30)[0]) + 1
        least = most_of_first(lengths, 30)
        assert least <= used <= least + 1
        more += used > least
    assert more <= 3
