import random

import public_tokenizers
import regex
import tiktoken

from foliolens.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n", "  a", "a  ", "it's they're I'll we've 'same ' s !'s x's's", "a\n\n b\t\tc \n", " x 　 y", "日本語テキスト 123", "é ½ ² x1y2", "\0\0a\0", "\U0010ffff '", "'", "don't'", "'re", "a" * 5000, " " * 3000 + "x", "👍🏽👩‍👩‍👧"]


def own():
    vocabulary = byte_bpe.Vocabulary.load(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def random_texts(n):
    rng = random.Random(7)
    alphabet = "aabcdeést ' \n\t1２ß!?.'lrevm日 "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pieces_equal_pattern():
    texts = ODD + random_texts(3000)
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert list(byte_bpe.pieces_of(texts)) == [pattern.findall(t) for t in texts]


def test_ids_equal_library():
    texts = ODD + random_texts(1500)
    library = own()
    got = [list(memoryview(p).cast("I")) for p in byte_bpe.encode_texts(texts, PATH)]
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [byte_bpe.decode_ids(p, PATH).decode() for p in byte_bpe.encode_texts(texts, PATH)] == texts


def test_prefixes_appends_and_edits():
    vocabulary, library = byte_bpe.Vocabulary.load(PATH), own()
    core = library._core_bpe
    piece = b"internationalizationalisms"
    grown = byte_bpe.PrefixEncoder(vocabulary)
    for i in range(len(piece)):
        grown.append(piece[i : i + 1])
        assert grown.ids() == core.encode_single_piece(piece[: i + 1])
    grown.edit(5, 9, b"xyz")
    assert grown.ids() == core.encode_single_piece(piece[:5] + b"xyz" + piece[9:])
    assert grown.ids(7) == core.encode_single_piece(bytes(grown.piece[:7]))


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (1, "a b", "x")], "doc_id long, text string, n_tokens string")
    rows = byte_bpe.digests(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (1, 2), (1, 2)]
    assert byte_bpe.digests(df.limit(0), PATH).collect() == []
    assert byte_bpe.encode(df, PATH).columns == ["doc_id", "text", "n_tokens", "ids"]


def test_table_compares_pieces_with_equal_hashes(monkeypatch):
    texts = ODD + random_texts(300)
    expected = list(byte_bpe.encode_texts(texts, PATH))
    vocabulary = byte_bpe.Vocabulary.load(PATH)
    monkeypatch.setattr(byte_bpe, "_hashes", lambda points, begins, stops: (stops - begins).astype("uint64"))
    ids, cuts = byte_bpe.PieceTable(byte_bpe.prefix_ids(vocabulary)).of(texts)
    assert [ids[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)] == expected


def test_table_starts_anew(monkeypatch):
    texts = random_texts(600)
    expected = list(byte_bpe.encode_texts(texts, PATH))
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 200)
    monkeypatch.setattr(byte_bpe, "SLOTS", 256)
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 100)
    table = byte_bpe.PieceTable(byte_bpe.prefix_ids(byte_bpe.Vocabulary.load(PATH)))
    found = [ids[a:b].tobytes() for ids, cuts, _, _ in table.each(texts) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
    assert found == expected and table.count <= 200


def test_edits_stop_where_tokens_agree():
    vocabulary, core = byte_bpe.Vocabulary.load(PATH), own()._core_bpe
    rng = random.Random(5)
    piece = "".join(rng.choice(["inter", "nation", "al", "iz", "ing", "the", "q"]) for _ in range(400)).encode()
    grown = byte_bpe.PrefixEncoder(vocabulary, piece)
    for _ in range(20):
        start = rng.randrange(len(piece))
        end, new = start + rng.randrange(4), rng.choice([b"", b"x", b"tion"])
        piece = piece[:start] + new + piece[end:]
        assert grown.edit(start, end, new) <= len(piece)
        assert grown.ids() == core.encode_single_piece(piece)
    assert grown.edit(10, 11, b"z") < len(piece) // 2
