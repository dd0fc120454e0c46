"""Similarity join on word n-gram sets by chosen paths, exact Jaccard on what it finds.

Each text becomes the set of its WORDS-word shingles, represented by min-hashes. Texts with the same set
are one node from the start. In every run a node follows paths: at each step it samples a few of
its min-hash tokens by a hash of the path and the token, so that nodes which share a token sample
it together or not at all. Nodes that meet at the end of a path form a bucket. Runs with other hashes are
repeated until a pair at the threshold is missed with a chance of 1 - TARGET at most: runs_for() measures how often
such a pair meets in one run and gives their number.

Buckets are compared by brute force on the min-hashes, each node with those not yet connected to it. Nodes that
agree on a whole band of min-hashes are connected before, so that a bucket of near copies takes few
comparisons. A bucket of more than BUCKET_PART nodes is compared in blocks: every pair of its blocks goes to a task of its own, and no
pair of nodes is left out. A bucket that takes more than COMPARISONS is split by another step instead, REPEATS times with other hashes.

A bucket passes on star edges of similar nodes, never all pairs. Connected nodes are then compared
exactly, by the shingle sets of their whole texts, in blocks of bounded size: every pair inside a
connected part is looked at, so links counted are exact there. Classes are the connected parts of
exact links; the class is named by its smallest document id, and a document's links are the other
documents, copies included, whose similarity reaches the threshold. Counting the links of a class takes comparisons
that grow with the square of its different texts, and each of these is read once for every block of the class.

Words are separated by ASCII white space. A text of fewer words than a shingle has one shingle of all its
words. Null, empty and blank texts have no shingles: each is a class of its own without links.
Repeated rows link to each other. A null id never names a class unless its class has no other.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import mixed, powers, stored, texts_of, whole_groups
from foliolens.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: Min-hash tokens of a set, and the share of pairs at the threshold that some run brings together. A node samples BRANCHES tokens a step on average.
TOKENS, TARGET, BRANCHES = 64, 0.9999, 1.35
#: Paths have at least FIRST_STEPS steps; buckets that take more than COMPARISONS are split until MOST_STEPS.
FIRST_STEPS, MOST_STEPS, COMPARISONS = 2, 5, 10_000_000
#: Nodes in a block of a bucket, and times that a split bucket is split with other hashes.
BUCKET_PART, REPEATS = 20_000, 2
#: Min-hashes of a band.
BAND = 16
#: Equal tokens, of TOKENS, from which two nodes of a bucket count as similar enough for the exact comparison.
LIKELY = 38
#: Nodes in a block of the exact comparison.
BLOCK = 2048
_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


_SEEDS = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], ~_SPACES[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=sums[1:])
    word = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    take = min(words, len(word))
    h = np.full(len(word) - take + 1, take, np.uint64)
    for i in range(take):
        h = mixed(h * _U(0x2545F4914F6CDD1D) + word[i : i + len(h)])
    return np.unique(h)


def min_hashes(found: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(found), 4096):
        part = found[begin : begin + 4096]
        np.minimum(out, mixed(part[None, :] ^ _SEEDS[:, None]).min(axis=1), out=out)
    return mixed(out ^ (_SEEDS << _U(1))).astype(np.uint32)


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


_LIMIT = _U(int(BRANCHES / TOKENS * 2**64))


def next_paths(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and longer paths: each row's path is extended by every token that it samples there."""
    step = mixed(path[:, None] ^ (tokens.astype(np.uint64) << _U(7) | np.arange(TOKENS, dtype=np.uint64)) * _U(_BASE))
    row, which = np.nonzero(mixed(step + _U(1)) < _LIMIT)
    return row, step[row, which]


@functools.cache
def runs_for(threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """Runs after which a pair at the threshold has met with the target's chance."""
    once = recall(threshold, runs=1, trials=2000)
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - min(once, 1 - 1e-9))))


def recall(similarity: float, steps: int = FIRST_STEPS, runs: int = 16, trials: int = 400, seed: int = 0) -> float:
    """Measured share of pairs of that similarity which meet on a path of `steps` steps in some run."""
    rng, met = np.random.default_rng(seed), 0
    for _ in range(trials):
        a = rng.integers(0, 2**32, TOKENS, dtype=np.uint32)
        b = np.where(rng.random(TOKENS) < similarity, a, rng.integers(0, 2**32, TOKENS, dtype=np.uint32))
        for run in range(runs):
            pa_, pb = np.array([_start(run)]), np.array([_start(run)])
            for _ in range(steps):
                pa_, pb = (next_paths(p, np.tile(t, (len(p), 1)))[1] if len(p) else p for p, t in ((pa_, a), (pb, b)))
            if len(np.intersect1d(pa_, pb)):
                met += 1
                break
    return met / trials


def _start(run: int) -> np.uint64:
    return mixed(np.array([run + 1], np.uint64) * _U(0xD6E8FEB86659FD93))[0]


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, tokens = [], []
        for text in texts_of(batch.column(1)):
            found = shingles(text)
            keys.append(set_key(found) if len(found) else None)
            tokens.append(min_hashes(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())], ["id", "text_key", "set_key", "tokens"])


def _first_paths(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                node, tokens = part.column(0).to_numpy(), _tokens(part.column(1))
                row, path = np.tile(np.arange(len(node)), runs), np.repeat(np.array([_start(r) for r in range(runs)]), len(node))
                for _ in range(FIRST_STEPS):
                    at, path = next_paths(path, tokens[row])
                    row = row[at]
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node[row])], ["path", "node"])

    return run


def _further_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 5000):
            part = batch.slice(begin, 5000)
            path, tokens = part.column(0).to_numpy().view(np.uint64), _tokens(part.column(2))
            for repeat in range(REPEATS):
                row, longer = next_paths(mixed(path + _U(repeat + 1)), tokens)
                yield pa.RecordBatch.from_arrays([pa.array(longer.view(np.int64)), part.column(1).take(pa.array(row))], ["path", "node"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = _tokens(batch.column(1)).astype(np.uint64)
        for band in range(0, TOKENS, BAND):
            h = np.full(len(tokens), band + 1, np.uint64)
            for i in range(band, band + BAND):
                h = mixed(h * _U(_BASE) + tokens[:, i])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0)], ["band", "node"])


def band_edges(tokens: DataFrame) -> DataFrame:
    """Star edges (a, b) of the nodes that agree on a whole band of min-hashes."""
    rows = tokens.mapInArrow(_bands, "band long, node long")
    least = rows.groupBy("band").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "b")
    return rows.join(least, "band").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _star_edges(node: np.ndarray, tokens: np.ndarray, budget: float, group: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]] | None:
    """Edges that connect the similar nodes of one bucket: each is compared with those not yet connected to it (of the other side, if there are two). None if that takes more comparisons."""
    group, edges = np.arange(len(node)) if group is None else np.unique(group, return_inverse=True)[1], []
    two = side is not None and len(np.unique(side)) > 1
    for i in range(len(node) - 1):
        open_ = group[i + 1 :] != group[i]
        if two:
            open_ &= side[i + 1 :] != side[i]
        others = np.flatnonzero(open_) + i + 1
        if not len(others):
            continue
        budget -= len(others)
        if budget < 0:
            return None
        near = others[(tokens[others] == tokens[i]).sum(axis=1) >= LIKELY]
        for g in np.unique(group[near]).tolist():
            edges.append((int(node[i]), int(node[near[group[near] == g][0]])))
            group[group == g] = group[i]
    return edges


def _compared(budget: float):
    """Edges (a, b) of the buckets; of a bucket that takes more than `budget` comparisons its rows (a, path), to be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "bucket", 5000):
            bucket, node, path, group, side = (part.column(c).to_numpy() for c in ("bucket", "node", "path", "part", "side"))
            tokens = _tokens(part.column("tokens"))
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            edges, rest = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                found = _star_edges(node[a:b], tokens[a:b], budget, group[a:b], side[a:b])
                if found is None:
                    rest += range(a, b)
                else:
                    edges += found
            at = np.array(rest, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64()), pa.nulls(len(edges), pa.int64())], ["a", "b", "path"])
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.nulls(len(at), pa.int64()), pa.array(path[at])], ["a", "b", "path"])

    return run


def _met(paths: DataFrame) -> DataFrame:
    return paths.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("path"))).filter("met > 1")


def likely_edges(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b) between nodes (node, tokens) that agree on a band, or that chosen paths bring together and whose min-hashes agree."""
    edges = stored(band_edges(nodes.select("node", "tokens")), "band-edges")
    tokens = nodes.select("node", "tokens").join(components(edges), "node", "left").select("node", "tokens", F.coalesce("part", "node").alias("part"))
    found = _met(nodes.select("node", "tokens").mapInArrow(_first_paths(runs_for(threshold)), "path long, node long"))
    for step in range(FIRST_STEPS, MOST_STEPS + 1):
        blocks = F.ceil(F.col("met") / BUCKET_PART).cast("int")
        held = found.select("path", "node", blocks.alias("blocks")).join(tokens, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        # Buckets of one block stay as they are; of others each block meets each other block, and itself.
        held = held.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        held = held.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node", "path", "part", (F.col("own") > F.col("other")).cast("int").alias("side"), "tokens")
        budget = COMPARISONS if step < MOST_STEPS else float("inf")
        compared = stored(held.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compared(budget), "a long, b long, path long").distinct(), "compared")
        edges = edges.unionByName(compared.filter("b IS NOT NULL").select("a", "b"))
        rest = compared.filter("b IS NULL").select("path", F.col("a").alias("node"))
        if step == MOST_STEPS or rest.isEmpty():
            return edges
        found = _met(rest.join(tokens, "node").select("path", "node", "tokens").mapInArrow(_further_paths, "path long, node long"))
    return edges


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left shares with each of right: frequent shingles by a matrix product, the others pair by pair."""
    values = np.concatenate([*left, *right])
    kinds, which = np.unique(values, return_inverse=True)
    row = np.concatenate([np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])])
    split = sum(map(len, left))
    on_left, on_right = np.bincount(which[:split], minlength=len(kinds)), np.bincount(which[split:], minlength=len(kinds))
    pairs = on_left * on_right
    dense = pairs > 256
    out = np.zeros((len(left), len(right)), np.float32)
    number = np.cumsum(dense) - 1
    for begin in range(0, int(dense.sum()), 2048):
        chosen = dense & (number >= begin) & (number < begin + 2048)
        a, b = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
        for matrix, w, r in ((a, which[:split], row[:split]), (b, which[split:], row[split:])):
            on = chosen[w]
            matrix[r[on], number[w[on]] - begin] = 1
        out += a @ b.T
    sparse = ~dense & (pairs > 0)
    orders = []
    for w, r in ((which[:split], row[:split]), (which[split:], row[split:])):
        on = sparse[w]
        order = np.argsort(w[on], kind="stable")
        orders.append((w[on][order], r[on][order]))
    (wl, rl), (wr, rr) = orders
    first = np.searchsorted(wr, wl)
    many = on_right[wl]
    for begin in range(0, len(wl), 100_000):
        n = many[begin : begin + 100_000]
        at = np.repeat(first[begin : begin + 100_000], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(out, (np.repeat(rl[begin : begin + 100_000], n), rr[at]), 1)
    return out


def _exact(threshold: float):
    def block(part: pa.Table) -> Iterator[tuple[int, int, int]]:
        """(node, links, leader) of one pair of blocks of a connected part."""
        node, copies, side = (part.column(c).to_numpy() for c in ("node", "copies", "side"))
        sets = [shingles(t) for t in part.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        within = not (side == 1).any()
        left = np.flatnonzero(side == 0)
        right = left if within else np.flatnonzero(side == 1)
        shared = shared_counts([sets[i] for i in left], [sets[i] for i in right])
        near = shared >= threshold * (sizes[left][:, None] + sizes[right][None, :] - shared) - 1e-6
        if within:
            np.fill_diagonal(near, False)
            yield from zip(node[left].tolist(), (near @ copies[left] + copies[left] - 1).tolist(), _leaders(near, node[left], node[left], True), strict=True)
        else:
            leaders = _leaders(near, node[left], node[right], False)
            yield from zip(np.concatenate([node[left], node[right]]).tolist(), [*(near @ copies[right]).tolist(), *(copies[left] @ near).tolist()], leaders, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, "pair", 256):
            pair = held.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows = list(block(held.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(3)], ["node", "links", "leader"])

    return run


def _leaders(near: np.ndarray, left: np.ndarray, right: np.ndarray, within: bool) -> list[int]:
    """For each row (then column, unless within) the smallest node connected to it."""
    a, b = left.copy(), right.copy()
    while True:
        new_b = b.copy()
        for i in range(len(a)):
            hit = near[i]
            if hit.any():
                least = min(a[i], new_b[hit].min())
                a[i] = least
                new_b[hit] = np.minimum(new_b[hit], least)
        if within:
            new_b = a = np.minimum(a, new_b)
        if (new_b == b).all():
            return a.tolist() if within else [*a.tolist(), *new_b.tolist()]
        b = new_b


def _classes(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Per row of df: id, text_key, class (null without shingles), the class's smallest id and the row's links."""
    source = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(text).alias("text_key"))
    kind = dict(source.dtypes)["id"]
    signed = stored(source.mapInArrow(_signatures, f"id {kind}, text_key long, set_key binary, tokens binary"), "signatures")
    nodes = signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.first("tokens").alias("tokens"), F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    nodes = stored(nodes.withColumn("node", F.xxhash64("set_key")), "nodes")
    parts = components(likely_edges(nodes, threshold))
    # Every node that is connected to another, with its part's blocks and its own block there.
    sized = parts.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("part")) / BLOCK).cast("int"))
    members = sized.join(nodes, "node").select("node", "part", "blocks", "copies", "text_key", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = source.filter("text IS NOT NULL").select("text", "text_key").join(members, "text_key").dropDuplicates(["node"])
    paired = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("part", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), "node", "copies", (F.col("block") > F.col("other")).cast("int").alias("side"), "text"
    )
    compared = stored(paired.repartition("pair").sortWithinPartitions("pair").mapInArrow(_exact(threshold), "node long, links long, leader long"), "links")
    classes = components(compared.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))
    counted = compared.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "set_key", "copies", "least").join(classes, "node", "left").join(counted, "node", "left")
    named = named.withColumn("class", F.coalesce("part", "node")).select(
        "set_key", "class", F.min("least").over(Window.partitionBy("class")).alias("class_id"), F.coalesce("links", F.col("copies") - 1).alias("n_links")
    )
    return signed.select("id", "text_key", "set_key").join(named, "set_key", "left")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of df: the key, its class (the smallest key linked to it, over any number of links) and its number of links."""
    rows = _classes(df, key, text, threshold)
    class_id = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return rows.select(F.col("id").alias(key), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of df for each class: that of the smallest key (null last). Rows without shingles stay, once for each key and text."""
    rows = _classes(df, key, text, threshold)
    best = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_key")).alias("w")).select("w.id", "w.text_key")
    stay = best.unionByName(rows.filter("class IS NULL").select("id", "text_key")).distinct().select(F.col("id").alias("stay_id"), F.col("text_key").alias("stay_key"))
    # The rows' own columns travel in a struct, whatever their names.
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"))
    chosen = marked.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("text_key") == F.col("stay_key")), "left_semi")
    return chosen.dropDuplicates(["id", "text_key"]).select("row.*")
