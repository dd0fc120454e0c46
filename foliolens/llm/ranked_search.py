"""Ranked lexical search of a set of items over all documents, each distinct bag of item words scored once.

Documents are cut down to the words that the items hold. Those whose words, frequencies and length factor agree form
one class: they are met by a hash and told apart by the bags themselves, so every document of a class has the same score
for every item. A class is scored once, by exact sums, and the best classes are expanded by ascending document id.

The items are the stated query set: they go in blocks of bounded bytes and number, each against all documents; a block's
words and weights are what all tasks are told. Copies of an item's text are asked once.

Rows: a null text, of a document or an item, has no terms. Rows that repeat a document's id are documents of their own, rows that
repeat an item's id items of their own. Null document ids come after all others. Items without a hit give no rows; empty tables none.
Further columns are ignored. Document ids are whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import slices, stored, texts_of

#: A block of items: at most about so many bytes of texts, and so many items.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 18, 512
#: Classes that are scored together, words of them that are multiplied together, and characters that are cut into words together.
CLASSES, COLUMNS, SLICE_CHARS = 512, 4096, 4_000_000
#: Whole numbers up to here are exact as doubles.
_EXACT = 1 << 53
_LAST = np.iinfo(np.int64).max
#: What is not part of a term becomes a blank, A-Z are lowered.
_TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order: runs of ASCII letters and digits and of all other characters, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Block:
    """Items of one block: the distinct texts' digests, the number of each word, and the items that hold a word, how often."""

    digests: list[str]
    vocabulary: dict[bytes, int]
    begins: np.ndarray
    items: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        held: list[tuple[int, int, int]] = []
        for number, (_, text) in enumerate(rows):
            for term, times in Counter(terms_of(text)).items():
                held.append((vocabulary.setdefault(term, len(vocabulary)), number, times))
        words, items, times = np.array(sorted(held), np.int64).reshape(-1, 3).T
        return cls([digest for digest, _ in rows], vocabulary, np.searchsorted(words, np.arange(len(vocabulary) + 1)), items, times)


def bags(docs: DataFrame, block: Block, key: str, text: str) -> DataFrame:
    """(id, n, terms, counts) of every document: its length in terms, the block's words that it holds, and how often."""
    told = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = told.value.get
        for batch in batches:
            texts = texts_of(batch.column(1))
            for begin, end in slices([len(t) for t in texts], SLICE_CHARS):
                lengths, ends, terms, counts = [], [0], [], []
                for words in map(terms_of, texts[begin:end]):
                    lengths.append(len(words))
                    found = sorted((i, n) for word, n in Counter(words).items() if (i := number(word)) is not None)
                    terms += [i for i, _ in found]
                    counts += [n for _, n in found]
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`")).mapInArrow(run, "id long, n long, terms array<int>, counts array<int>")


class Best:
    """The best documents of every item so far: rows of (item, score, id, whether the id is null)."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.rows = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]
        self.least = np.zeros(items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray, ends: np.ndarray) -> None:
        """Scores of classes (rows) for items (columns); the members of class c are ids[ends[c]:ends[c + 1]]."""
        classes, items = np.nonzero((scores >= self.least) & (scores > 0))
        if not len(classes):
            return
        sizes = np.diff(ends)[classes]
        members = np.repeat(ends[classes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        new = (np.repeat(items, sizes), np.repeat(scores[classes, items], sizes), ids[members], null[members])
        item, score, ident, void = (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((ident, void, -score, item))
        begins = np.searchsorted(item[order], np.arange(self.items + 1))
        order = order[np.arange(len(order)) - begins[item[order]] < self.k]
        self.rows = [x[order] for x in (item, score, ident, void)]
        begins = np.searchsorted(self.rows[0], np.arange(self.items + 1))
        full = np.flatnonzero(np.diff(begins) == self.k)
        self.least[full] = self.rows[1][begins[full + 1] - 1]


def score_classes(block: Block, weights: np.ndarray, m: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Scores of classes (rows) for the block's items (columns). Class c holds terms[ends[c]:ends[c + 1]]."""
    row = np.repeat(np.arange(len(m)), np.diff(ends))
    tf = counts.astype(np.int64)
    gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
    value = np.repeat(weights, np.diff(block.begins)) * block.times
    # Sums of products stay whole as doubles, unless some item is longer than any text should be.
    exact = np.bincount(block.items, value, len(block.digests)).max(initial=0) * 1_000_000 < _EXACT
    kind = np.float64 if exact else np.int64
    scores = np.zeros((len(m), len(block.digests)), kind)
    used, column = np.unique(terms, return_inverse=True)
    for first in range(0, len(used), COLUMNS):
        some = used[first : first + COLUMNS]
        here = (column >= first) & (column < first + COLUMNS)
        left = np.zeros((len(m), len(some)), kind)
        left[row[here], column[here] - first] = gain[here]
        right = np.zeros((len(some), len(block.digests)), kind)
        held = np.diff(block.begins)[some]
        at = np.repeat(block.begins[some] - np.cumsum(held) + held, held) + np.arange(held.sum())
        right[np.repeat(np.arange(len(some)), held), block.items[at]] = value[at]
        scores += left @ right
    return scores.astype(np.int64)


def best_of_block(docs: DataFrame, block: Block, k: int, key: str, text: str) -> DataFrame:
    """(digest, id, score): the k best documents of each item of a block, and some more."""
    spark = docs.sparkSession
    held = stored(bags(docs, block, key, text), "bags")
    total, length = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    for term, n in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the block's words
        df[term] = n
    told = spark.sparkContext.broadcast((block, np.array([weight(total, n) for n in df.tolist()], np.int64)))
    factor = F.expr(f"cast((25 * cast(n as decimal(38, 0)) * {total}) div {max(1, length)} + 75 as long)")
    found = held.filter(F.size("terms") > 0).withColumn("m", factor).withColumn("hash", F.xxhash64("m", "terms", "counts"))
    # Equal hashes are told apart by the bags. Of a class, members past the k-th can't be among an item's k best.
    bag = ["hash", "m", "terms", "counts"]
    first = found.withColumn("place", F.row_number().over(Window.partitionBy(*bag).orderBy(F.col("id").asc_nulls_last()))).filter(F.col("place") <= k)
    classes = first.groupBy(*bag).agg(F.collect_list(F.struct("id")).alias("members")).drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = told.value
        best = Best(len(block.digests), k)
        for batch in batches:
            for begin in range(0, batch.num_rows, CLASSES):
                part = batch.slice(begin, CLASSES)
                terms, counts, members = part.column("terms"), part.column("counts"), part.column("members")
                ends, at = (x.offsets.to_numpy().astype(np.int64) for x in (terms, members))
                ids = members.flatten().field(0)
                scores = score_classes(block, weights, part.column("m").to_numpy(), ends - ends[0], terms.flatten().to_numpy(), counts.flatten().to_numpy())
                best.add(scores, ids.fill_null(_LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), at - at[0])
        item, score, ident, void = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(block.digests, pa.string()).take(pa.array(item)), pa.array(ident, pa.int64(), mask=void), pa.array(score)], ["digest", "id", "score"])

    return classes.mapInArrow(run, "digest string, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item key, rank, document key, score): every item's k best documents with a score above 0, ties by ascending id."""
    asked = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("asked")).filter("asked is not null").withColumn("digest", F.sha2("asked", 256))
    texts = asked.select("digest", "asked").distinct()
    count, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("asked")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    found = []
    for number in range(blocks):
        rows = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == number).orderBy("digest").collect()
        found.append(best_of_block(docs, Block.of([tuple(r) for r in rows]), k, key, text))
    order = Window.partitionBy("digest").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asked.join(best, "digest").select(F.col("item").alias(item_key), "rank", F.col("id").alias(key), "score")
