"""Alignment of two tokenizers' ids over the same text, and how often two ids meet in it.

A text is encoded twice: with a blank before it by a byte-level BPE (A), and as it stands by a piece BPE that adds that
blank itself (B). Dictionaries from the byte offset where a token ends to its place (tables addressed by the offset) are intersected; the sorted common
offsets slice both lists of ids into groups, and every A token of a group is linked with every B token of it. Counts of
linked id pairs are summed over documents in Spark. The pairs that hold more than a fixed share of all occurrences are,
by that share, few: their counts are told to all tasks. The others are joined by pair, where none of them can be hot.

Rows: null and empty texts have no tokens, nor have those whose token bytes don't spell the text (the piece BPE writes its own
sign for blanks as a blank): zeros and ''. Repeated rows count as documents of their own; null and repeated keys pass through.
An empty table gives an empty result; further columns are ignored. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.byte_bpe import ranges
from foliolens.llm.common import once, stored, texts_of
from foliolens.llm.packing import LibraryIds

#: A worker forgets encoded words of B beyond so many, but for those of the texts at hand.
CACHE_WORDS = 500_000
#: Pairs told to all tasks: those with more than one of so many occurrences, so fewer than that.
COMMON = 1 << 17
#: Groups with more links than this are counted by their distinct ids instead of link by link.
LARGE_GROUP = 1 << 12
_WORD = re.compile(" +[^ ]*")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class Words:
    """Packed ids of B by word: blanks with what follows them, the first blank left off. No piece has a blank after another character, so merges stay within words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of the model reach over blanks")
        self.bytes_of = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.blank = self.model.piece_to_id("▁")
        self.packed: dict[str, bytes] = {}
        self.unspelt: set[str] = set()  # words that their pieces don't spell

    def words(self, text: str) -> list[str]:
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [w[1:] for w in _WORD.findall(" " + text)]
        return text.split(" ")

    def ids(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """The ids of each text, None where they don't spell it; new words are encoded together."""
        cut = [self.words(t) for t in texts]
        new = [w for w in set().union(*cut) if w not in self.packed]
        if len(self.packed) + len(new) > CACHE_WORDS:
            self.packed.clear()
            self.unspelt.clear()
            new = list(set().union(*cut))
        for word, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            ids = ids if word else [self.blank]
            if b"".join([self.bytes_of[i] for i in ids]) != (" " + word).encode("utf-8", "surrogatepass"):
                self.unspelt.add(word)
            self.packed[word] = np.array(ids, "<u4").tobytes()
        for words in cut:
            spelt = not self.unspelt or self.unspelt.isdisjoint(words)
            yield np.frombuffer(b"".join(map(self.packed.__getitem__, words)), "<u4").astype(np.int64) if spelt else None


class Aligner:
    """Both tokenizers, and the decimal forms of ids, as a worker keeps them."""

    def __init__(self, bpe_path: str, piece_path: str):
        self.a = LibraryIds(bpe_path)
        self.a.tokenizer.encode_special_tokens = True  # their strings are plain text
        self.b = Words(piece_path)
        self.most_b = len(self.b.lengths)
        forms = [b"%d," % i for i in range(max(len(self.a.lengths), self.most_b))]
        self.form_lengths = np.array([len(f) for f in forms], np.int64)
        self.form_begins = np.cumsum(self.form_lengths) - self.form_lengths
        self.forms = np.frombuffer(b"".join(forms), np.uint8)

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the groups of both lists begin, and where the last ends.

        An end-to-index dictionary is a table addressed by the end itself, 0 where no token ends; the ends of B that A's
        table knows are the common ones, in order.
        """
        ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        at_a, at_b = np.zeros(ends_a[-1] + 1, np.int32), np.zeros(ends_b[-1] + 1, np.int32)
        at_a[ends_a], at_b[ends_b] = np.arange(1, len(ends_a) + 1), np.arange(1, len(ends_b) + 1)
        common = ends_b[at_a[ends_b] > 0]
        return np.concatenate([[0], at_a[common]]), np.concatenate([[0], at_b[common]])

    def pairs(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct linked pairs, as numbers, and how many links each has."""
        n_a, n_b = np.diff(cut_a), np.diff(cut_b)
        codes, times = [], []
        for g in np.flatnonzero(n_a * n_b > LARGE_GROUP).tolist():
            (some_a, many_a), (some_b, many_b) = (np.unique(x, return_counts=True) for x in (ids_a[cut_a[g] : cut_a[g + 1]], ids_b[cut_b[g] : cut_b[g + 1]]))
            codes.append((some_a[:, None] * self.most_b + some_b).ravel())
            times.append((many_a[:, None] * many_b).ravel())
        of_a = np.repeat(np.where(n_a * n_b > LARGE_GROUP, 0, n_b), n_a)  # links of each A token
        linked = np.repeat(ids_a, of_a) * self.most_b + ids_b[ranges(np.repeat(cut_b[:-1], n_a), of_a)]
        code, many = np.unique(linked, return_counts=True)
        if codes:
            code, at = np.unique(np.concatenate([code, *codes]), return_inverse=True)
            summed = np.zeros(len(code), np.int64)
            np.add.at(summed, at, np.concatenate([many, *times]))
            many = summed
        return code, many

    def digest(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """Of the groups written as `a1,a2|b1;a3|b2,b3`."""
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.repeat(cut_b[:-1], np.diff(cut_a))] = ids_a
        order[np.arange(len(ids_b)) + np.repeat(cut_a[1:], np.diff(cut_b))] = ids_b
        lengths = self.form_lengths[order]
        written = self.forms[ranges(self.form_begins[order], lengths)]
        last = np.cumsum(lengths) - 1
        written[last[cut_a[1:] + cut_b[:-1] - 1]] = ord("|")
        written[last[cut_a[1:] + cut_b[1:] - 1]] = ord(";")
        return hashlib.sha256(written[:-1].tobytes()).hexdigest()

    def rows(self, texts: list[str]) -> Iterator[list[tuple]]:
        """Slices of (n_a, n_b, n_groups, n_links, digest, pair numbers, links of each pair), one a text."""
        nothing = np.empty(0, np.int64)
        for ids, cuts, begin, end in self.a.table.each([" " + t if t else "" for t in texts]):
            ids, out = ids.astype(np.int64), []
            for x, y, ids_b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), self.b.ids(texts[begin:end]), strict=True):
                ids_a = ids[x:y]
                if not len(ids_a) or ids_b is None:
                    out.append((0, 0, 0, 0, "", nothing, nothing))
                    continue
                cut_a, cut_b = self.align(ids_a, ids_b)
                pairs = self.pairs(ids_a, ids_b, cut_a, cut_b)
                out.append((len(ids_a), len(ids_b), len(cut_a) - 1, int(np.dot(np.diff(cut_a), np.diff(cut_b))), self.digest(ids_a, ids_b, cut_a, cut_b), *pairs))
            yield out


_aligner = once(Aligner)
_HEAD = ["number", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def aligned(df: DataFrame, bpe_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: a number of its own, the key, the counts and digest of its groups, its linked pairs and each one's links.

    A pair is the number a * (size of B's vocabulary) + b.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for rows in _aligner(bpe_path, piece_path).rows(texts_of(batch.column(1))):
                *counts, digests, pairs, links = zip(*rows, strict=True)
                numbers = pa.array(range(number, number + len(rows)), pa.int64())
                columns = [numbers, batch.column(0).slice(done, len(rows)), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), _lists(pairs), _lists(links)]
                yield pa.RecordBatch.from_arrays(columns, [*_HEAD, "pairs", "links"])
                number += len(rows)
                done += len(rows)

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"number long, key {kind}, {_COUNTS}, pairs array<long>, links array<long>")


def pair_counts(rows: DataFrame, most_b: int) -> DataFrame:
    """(pair, n, best): in how many rows a pair is linked, and whether no pair of its A id is linked in more (1, else 0)."""
    counted = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs").withColumn("a", F.expr(f"pair div {most_b}"))
    highest = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def links(df: DataFrame, bpe_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: the key, its tokens, groups and links, how many links are the best of their A id, and the sum of all links' counts."""
    spark = df.sparkSession
    rows = stored(aligned(df, bpe_path, piece_path, key, text), "aligned", compression="zstd")
    most_b = _aligner(bpe_path, piece_path).most_b
    counts = stored(pair_counts(rows, most_b), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > total // COMMON  # fewer than COMMON pairs, as their counts add up to no more than the total
    common = counts.filter(often).orderBy("pair").toArrow()
    told = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = told.value
        for batch in batches:
            lists = batch.column("pairs")
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            code, many = lists.flatten().to_numpy(), batch.column("links").flatten().to_numpy()
            at = np.searchsorted(pair, code)
            known = np.zeros(len(code), bool)
            inside = at < len(pair)
            known[inside] = pair[at[inside]] == code[inside]
            gain, hits = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
            gain[known], hits[known] = many[known] * n[at[known]], many[known] * best[at[known]]
            sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (hits, gain)]
            rest = pa.array(np.concatenate([[0], np.cumsum(~known)])[ends], pa.int32())
            left = [pa.ListArray.from_arrays(rest, pa.array(x[~known])) for x in (code, many)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _HEAD], *[pa.array(np.diff(s)) for s in sums], *left], [*_HEAD, "n_best", "count_sum", "pairs", "links"])

    kind = dict(df.dtypes)[key]
    partly = stored(rows.mapInArrow(run, f"number long, key {kind}, {_COUNTS}, n_best long, count_sum long, pairs array<long>, links array<long>"), "partly", compression="zstd")
    rare = partly.select("number", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("number", F.col("x.pairs").alias("pair"), F.col("x.links").alias("many"))
    met = rare.join(counts.filter(~often), "pair").groupBy("number").agg(F.sum(F.col("many") * F.col("best")).alias("more_best"), F.sum(F.col("many") * F.col("n")).alias("more_sum"))
    whole = partly.drop("pairs", "links").join(met, "number", "left")
    both = [(F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c) for c, more in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return whole.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", *both, "groups_sha256")
