"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece exactly one token can stand last in the prefix's encoding. The encoder
stores that token per prefix: to extend by a byte it tries the vocabulary's tokens that end there,
longest first, and takes the one that may follow the token stored where it begins. Appending is
exact because stored entries never change; after an edit entries are found anew until they agree with the
stored ones over the length of the longest token.

Rows: a null text counts as empty (no ids). Repeated rows, null keys and further columns pass
through untouched; an empty table gives an empty result. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import mixed, once, powers, slices, texts_of

#: A worker forgets its encoded pieces beyond so many pieces or characters; they are then encoded anew.
CACHE_PIECES, CACHE_CHARS = 500_000, 8_000_000
#: Slots of the table of pieces, a power of two, and characters that are looked up together.
SLOTS, SLICE_CHARS = 1 << 21, 400_000
_NEVER = 1 << 60


class Vocabulary:
    """Ranks of byte strings, and which tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._fit: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes."""
        if token not in self._halves:
            parts = [bytes([x]) for x in self.bytes_of[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def _spine(self, token: int, side: int, kept: dict) -> list[tuple[int, int]]:
        """From the outermost byte of one side up to the token: (part, rank at which it is merged into the next)."""
        if token not in kept:
            parts, at = [(token, _NEVER)], token
            while pair := self.halves(at):
                parts.append((pair[side], at))
                at = pair[side]
            kept[token] = parts[::-1]
        return kept[token]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether merging the joined bytes of two tokens leaves just these two."""
        key = first << 32 | second
        known = self._fit.get(key)
        if known is None:
            if len(self._fit) > 2_000_000:
                self._fit.clear()
            known = self._fit[key] = self._joins_nothing(self._spine(first, 1, self._right), self._spine(second, 0, self._left))
        return known

    def _joins_nothing(self, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (a, a_goes), (b, b_goes) = left[i], right[j]
            # Of two merges with the same rank the left one is done first.
            if (over := self.ranks.get(self.bytes_of[a] + self.bytes_of[b], _NEVER)) < a_goes and over <= b_goes and over < _NEVER:
                return False
            if a_goes == b_goes == _NEVER:
                return True
            if a_goes <= b_goes:
                i += 1
            else:
                j += 1


class PrefixEncoder:
    """The last token of every prefix of one piece of text. Grows by append() and mends by edit()."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, bytearray(), []
        self.append(piece)

    def append(self, more: bytes) -> None:
        begin = len(self.piece)
        self.piece += more
        ranks, may_follow, last, longest = self.vocabulary.ranks, self.vocabulary.may_follow, self.last, self.vocabulary.longest
        skip = max(0, begin - longest)
        piece = bytes(self.piece[skip:])
        for end in range(begin + 1, skip + len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(piece[start - skip : end - skip])
                if token is not None and (not start or may_follow(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes start..end; the number of entries that were found anew.

        Entries before the edit stay. After it, an entry depends on the entries of the `longest` bytes before
        it only; once that many in a row come out as stored before, all further ones would, and the stored rest is kept.
        """
        longest = self.vocabulary.longest
        rest, kept = bytes(self.piece[end:]), self.last[end:]
        del self.piece[start:], self.last[start:]
        self.append(new)
        same = done = 0
        while done < len(rest) and same < longest:
            self.append(rest[done : done + 1])
            same = same + 1 if self.last[-1] == kept[done] else 0
            done += 1
        self.piece += rest[done:]
        self.last += kept[done:]
        return len(new) + done

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the piece, or of its prefix of `end` bytes."""
        out, at = [], len(self.piece) if end is None else end
        while at:
            out.append(token := self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


#: Kinds of characters for cutting text into pieces.
_EDGE, _LETTER, _NUMBER, _OTHER, _BLANK, _SPACE = range(6)
#: Fixed value: what the pattern's white space matches.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


@once
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            first, last = ord(run.group()[0]), ord(run.group()[-1])
            kinds[first : last + 1] = kind
    kinds[0xD800:0xE000] = _OTHER
    kinds[[ord(c) for c in _WHITE]] = _SPACE
    kinds[ord(" ")] = _BLANK
    return kinds


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """The texts' code points, where pieces begin and end there, how many pieces come before each text (and before the end), and the joined texts.

    All texts are classified character by character in one array; runs of a kind are pieces, a
    blank joins the run after it, white space before that stays apart, and a contraction's
    letters join an apostrophe that begins a piece.
    """
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = _kinds()[points]
    kind[ends] = _EDGE
    group = np.minimum(kind, _BLANK)
    begins = np.empty(len(points) + 3, bool)
    begins[:] = True
    begins[1 : len(points)] = group[1:] != group[:-1]
    after = np.flatnonzero((group[:-1] == _BLANK) & (group[1:] != _BLANK) & (group[1:] != _EDGE)) + 1
    begins[after - 1] = True
    begins[after[kind[after - 1] == _BLANK]] = False
    marks = np.flatnonzero((points == 0x27) & begins[: len(points)])
    marks = marks[group[np.minimum(marks + 1, len(points) - 1)] == _LETTER]
    if len(marks):
        first, second = points[marks + 1], points[np.minimum(marks + 2, len(points) - 1)]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        for chosen, length in ((marks[one], 2), (marks[two], 3)):
            begins[chosen + 1] = False
            begins[chosen + length] = True
    begins[ends] = begins[ends + 1] = True
    edges = np.flatnonzero(begins[: len(points)])
    text_end = kind[edges] == _EDGE
    at = np.flatnonzero(~text_end)
    stops = np.append(edges, len(points))[at + 1]
    return points, edges[at], stops, np.concatenate([[0], np.flatnonzero(text_end) - np.arange(len(texts))]), joined


def pieces_of(texts: list[str]) -> Iterator[list[str]]:
    """The matches of the vocabulary's splitting pattern, in order, for each text."""
    _, begins, stops, cuts, joined = _cut(texts)
    found = [joined[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        yield found[a:b]


#: From pieces of text to their ids, one after another, and how many each has.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class PieceTable:
    """Ids of text pieces, looked up for all pieces of many texts at once.

    Pieces are found by 64-bit hashes in an open table and compared with the stored piece character by
    character, so equal hashes of different pieces can't give wrong ids. `encode` gives the ids of pieces that
    are not in the table yet; the table starts anew when it has CACHE_PIECES pieces or CACHE_CHARS characters.
    """

    def __init__(self, encode: Encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.hashes, self.numbers = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int64)
        self.count = 0
        # By piece: where its characters and its ids begin in the pools; both end where the next one's begin.
        self.char_at, self.id_at = np.zeros(CACHE_PIECES + 1, np.int64), np.zeros(CACHE_PIECES + 1, np.int64)
        self.chars, self.ids = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        out = self.numbers[at]
        wrong = np.flatnonzero((out >= 0) & (self.hashes[at] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (SLOTS - 1)
            out[wrong] = self.numbers[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.hashes[at[wrong]] != h[wrong])]
        return out

    def add(self, h: np.ndarray, chars: np.ndarray, char_counts: np.ndarray, ids: np.ndarray, id_counts: np.ndarray) -> None:
        """Adds pieces with distinct hashes: their characters and ids one after another."""
        new = np.arange(self.count, self.count + len(h))
        at, waiting = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(h))
        while len(waiting):
            # Of those that want the same free slot one gets it; the others go on to the next.
            free = waiting[self.numbers[at[waiting]] < 0]
            self.numbers[at[free]] = new[free]
            placed = free[self.numbers[at[free]] == new[free]]
            self.hashes[at[placed]] = h[placed]
            waiting = waiting[self.numbers[at[waiting]] != new[waiting]]
            at[waiting] = (at[waiting] + 1) & (SLOTS - 1)
        for pool, starts, values, counts in (("chars", self.char_at, chars, char_counts), ("ids", self.id_at, ids, id_counts)):
            begin, held = int(starts[self.count]), getattr(self, pool)
            if begin + len(values) > len(held):
                setattr(self, pool, held := np.concatenate([held, np.zeros(len(held) + len(values), np.uint32)]))
            held[begin : begin + len(values)] = values
            starts[self.count + 1 : self.count + 1 + len(h)] = begin + np.cumsum(counts)
        self.count += len(h)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (and where the last ends)."""
        points, begins, stops, cuts, joined = _cut(texts)
        h = _hashes(points, begins, stops)
        number = self.find(h)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            if self.count + len(new) > CACHE_PIECES or self.char_at[self.count] > CACHE_CHARS:
                self.clear()
                new, first = np.unique(h, return_index=True)
            if len(new) > CACHE_PIECES:
                return self._one_by_one(joined, begins, stops, cuts)
            ids, counts = self.encode([joined[a:b] for a, b in zip(begins[first].tolist(), stops[first].tolist(), strict=True)])
            lengths = stops[first] - begins[first]
            self.add(new, points[ranges(begins[first], lengths)], lengths, ids, counts)
            number = self.find(h)
        lengths = stops - begins
        if not (np.array_equal(self.char_at[number + 1] - self.char_at[number], lengths) and np.array_equal(self.chars[ranges(self.char_at[number], lengths)], points[ranges(begins, lengths)])):
            return self._one_by_one(joined, begins, stops, cuts)
        held = self.id_at[number + 1] - self.id_at[number]
        return self.ids[ranges(self.id_at[number], held)], np.concatenate([[0], np.cumsum(held)])[cuts]

    def _one_by_one(self, joined: str, begins: np.ndarray, stops: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.encode([joined[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)])
        return ids, np.concatenate([[0], np.cumsum(counts)])[cuts]

    def each(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(ids, where each text's begin and the last's end, number of the first text and of the one after the last), a slice of the texts at a time."""
        for begin, end in slices([len(t) for t in texts], SLICE_CHARS):
            yield *self.of(texts[begin:end]), begin, end


def ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)


def _hashes(points: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of code points, from prefix sums of a polynomial in them."""
    up, down = powers(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return mixed((sums[stops] - sums[begins]) * down[begins])


def prefix_ids(vocabulary: Vocabulary) -> Encode:
    """Ids of pieces by the prefix encoder."""

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[int] = []
        ends = []
        for raw in (p.encode("utf-8", "surrogatepass") for p in pieces):
            token = vocabulary.ranks.get(raw)
            out += [token] if token is not None else PrefixEncoder(vocabulary, raw).ids()
            ends.append(len(out))
        return np.array(out, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)

    return encode


class Codec:
    """Encoder and decoder of one vocabulary, as a worker keeps it."""

    def __init__(self, path: str):
        vocabulary = Vocabulary.load(path)
        self.table = PieceTable(prefix_ids(vocabulary))
        lengths = np.zeros(max(vocabulary.bytes_of) + 1, np.int64)
        for i, b in vocabulary.bytes_of.items():
            lengths[i] = len(b)
        self.lengths, self.begins = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(vocabulary.bytes_of.get(i, b"") for i in range(len(lengths))), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ranges(self.begins[ids], self.lengths[ids])].tobytes()


codec = once(Codec)


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    """Packed ids (little-endian, 32 bits each) of each text."""
    for ids, cuts, _, _ in codec(path).table.each(texts):
        packed = ids.astype("<u4").tobytes()
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            yield packed[4 * a : 4 * b]


def decode_ids(packed: bytes, path: str) -> bytes:
    return codec(path).decode(np.frombuffer(packed, "<u4"))


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with the packed ids of `text` in the binary column `into` (which replaces one of that name)."""
    kept = [c for c in df.columns if c != into]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*[F.col(f"`{c}`") for c in kept]).dtypes) + f", `{into}` binary"

    def run(batches):
        for batch in batches:
            ids = pa.array(list(encode_texts(texts_of(batch.column(text)), path)), pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ids], [*kept, into])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: the key, the number of tokens, and the digests of its ids and of the text decoded from them."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            counts, ids, decoded = [], [], []
            for packed in encode_texts(texts_of(batch.column(1)), path):
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(packed, path)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
