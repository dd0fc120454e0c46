"""Best-fit packing of token sequences with best-two-fit repair.

Every document becomes ids followed by one end id; longer ones are cut into full pieces, a shorter
piece first. Pieces are dealt evenly into groups of bounded size, whatever their keys, and each
group is packed on its own: a sequence is filled greedily with the longest piece that fits; while a
gap is left, its shortest piece gives way to the two unpacked pieces whose sum fills the widened
gap best, if they fill more. A group leaves about one sequence part-filled, so groups cost next to
nothing (one sequence in some thousands).

Rows: a null text counts as empty and yields its end id alone. Repeated rows and null keys are
packed like any other, each row by itself. An empty table gives an empty result; further columns
are ignored. Texts are tokenized whole, however long.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.byte_bpe import PieceTable
from foliolens.llm.common import once, stored, texts_of

#: Pieces in a packing group, about.
GROUP_PIECES = 8192
END_ID = 0
#: Pieces of text that the library tokenizes in one call.
TOGETHER = 1000


class LibraryIds:
    """Ids by the tokenizers library, each distinct piece of text tokenized once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Tokens are written with one character for each byte.
        words = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(words.values()) + 1, np.int64)
        for word, i in words.items():
            self.lengths[i] = len(word)
        self.table = PieceTable(self._of_pieces)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, TOGETHER in one call; the ids' lengths in bytes tell where one piece's end."""
        ids = [np.empty(0, np.uint32)]
        for begin in range(0, len(pieces), TOGETHER):
            (found,) = self.tokenizer.encode_batch_fast([pieces[begin : begin + TOGETHER]], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
        joined = np.concatenate(ids)
        ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in pieces])
        return joined, np.diff(np.searchsorted(np.cumsum(self.lengths[joined]), ends) + 1, prepend=0)

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text, END_ID after them."""
        end_id = np.array([END_ID], "<u4").tobytes()
        for ids, cuts, begin, end in self.table.each(texts):
            packed = ids.astype("<u4").tobytes()
            for text, a, b in zip(texts[begin:end], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                # A special token's string cuts a text before it is split.
                if any(s in text for s in self.special):
                    yield self._ids(text).astype("<u4").tobytes() + end_id
                else:
                    yield packed[4 * a : 4 * b] + end_id


_library = once(LibraryIds)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a sequence of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, path: str, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every row of df with the digest of their ids; `dealt` numbers them within the job."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            for row, packed in enumerate(_library(path).of(texts_of(batch.column(1)))):
                for i, (start, length) in enumerate(cut(len(packed) // 4, capacity)):
                    rows.append((row, i, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]), number))
                    number += 1
            at, *columns = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [], [])
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]], [key, "piece", "start", "length", "ids_crc32", "dealt"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, dealt long")


def best_two_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each item its bin and its offset there. Lengths are 1 to capacity; the result depends on their order only among equals."""
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(lengths[i], []).append(i)
    sizes = sorted(waiting)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)

    def take(size: int) -> int:
        item = waiting[size].pop()
        if not waiting[size]:
            del waiting[size]
            del sizes[bisect_right(sizes, size) - 1]
        return item

    def give_back(item: int) -> None:
        if (size := lengths[item]) not in waiting:
            waiting[size] = []
            sizes.insert(bisect_right(sizes, size), size)
        waiting[size].append(item)

    def best_pair(room: int) -> tuple[int, int] | None:
        have = np.array(sizes)
        other = np.searchsorted(have, np.minimum(have, room - have), "right") - 1
        single = other == np.arange(len(have))  # the same size twice needs two items
        single &= np.array([len(waiting[s]) < 2 for s in sizes]) if single.any() else single
        other = other - single
        sums = np.where(other >= 0, have + have[other], -1)
        sums[sums > room] = -1
        at = int(sums.argmax())
        return (int(have[at]), int(have[other[at]])) if sums[at] > 0 else None

    number = 0
    while sizes:
        held, gap = [], capacity
        while gap and sizes and (at := bisect_right(sizes, gap)):
            held.append(take(sizes[at - 1]))
            gap -= lengths[held[-1]]
        while gap and sizes:
            least = lengths[held[-1]]
            pair = best_pair(gap + least)
            if not pair or sum(pair) <= least:
                break
            out = held.pop()
            held += [take(pair[0]), take(pair[1])]
            give_back(out)
            held.sort(key=lambda i: -lengths[i])
            gap += least - sum(pair)
        begin = 0
        for item in held:
            bins[item], offsets[item] = number, begin
            begin += lengths[item]
        number += 1
    return bins, offsets


def pack(df: DataFrame, path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document of df with the sequence each lies in and its offset there."""
    cut_up = stored(pieces(df, path, capacity, key, text), "pieces")
    groups = max(1, -(-cut_up.count() // GROUP_PIECES))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("dealt")
        bins, offsets = best_two_fit(group.column("length").to_pylist(), capacity)
        base = int(group.column("bin_group")[0].as_py()) << 32
        out = group.select([key, "piece", "start", "length", "ids_crc32"])
        out = out.append_column("sequence_id", pa.array(np.array(bins, np.int64) + base))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    kind = dict(df.dtypes)[key]
    # xxhash64 of the running number deals pieces evenly even where one key holds most rows.
    dealt = cut_up.withColumn("bin_group", F.pmod(F.xxhash64("dealt"), F.lit(groups)))
    return dealt.groupBy("bin_group").applyInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long")
