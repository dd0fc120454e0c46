"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training rows are labelled rows outside the held-out fold, at most SAMPLE_PER_CLASS of each class,
those with the smallest hashes of their keys (a documented bound; the hash makes the choice the
same at every run). Over them Spark counts in how many toxic and clean texts each hashed n-gram
occurs; n-grams whose shares differ most by their standard error become features, with value
log((share in toxic) / (share in clean)) times log(1 + occurrences). Logistic regression on these
gives the weights; its intercept is corrected from the sample's class shares to those of all labels.

Scores use whole texts and nothing else. A null or empty text has no n-grams and scores by the
intercept. Rows are scored one by one, so repeated rows, null keys and ties need no rule; labels
that are null or other than 0 and 1 are skipped, repeated ones count once per key (toxic if any
says so); of the rows that share a key, the text of the smallest hash teaches. With labels of one class only, or none, every score is that class's share (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored, texts_of

#: Bound of the training sample.
SAMPLE_PER_CLASS = 10_000
#: N-grams have these numbers of characters and are hashed into so many buckets.
SIZES, BUCKETS = (4, 5, 7), 1 << 20
#: Features that the classifier uses, and of these how many a training row keeps at most: those with the largest values. Training rows fit in the driver by this bound.
FEATURES, ROW_FEATURES = 8192, 2048
#: Entries of the training rows that the driver multiplies at once.
ENTRIES = 1 << 20
_MIX = np.uint32(0x9E3779B1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's n-grams and log(1 + occurrences): lower case, white space runs as one blank, a blank at both ends."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for size in SIZES:
        n = len(points) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint32)
        for i in range(size):
            h = (h ^ points[i : i + n]) * _MIX
            h ^= h >> np.uint32(15)
        found.append(h & np.uint32(BUCKETS - 1))
    if not found:
        return np.empty(0, np.uint32), np.empty(0)
    at, n = np.unique(np.concatenate(found), return_counts=True)
    return at, np.log1p(n)


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: np.ndarray  # by bucket; 0 where it is no feature

    def scores(self, texts: list[str]) -> np.ndarray:
        sums = np.array([self.intercept + float(self.weights[at] @ n) for at, n in map(grams, texts)], float)
        return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))


def held_out(key: str = "doc_id"):
    """The fold that training leaves out: crc32 of the key's text divisible by 5."""
    return F.crc32(F.col(f"`{key}`").cast("string")) % 5 == 0


def _sample(documents: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[DataFrame, dict[int, int]]:
    fit = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    order = F.xxhash64(key), F.col(key)
    parts = [fit.filter(F.col("toxic") == c).orderBy(*order).limit(SAMPLE_PER_CLASS) for c in (0, 1)]
    # At most 2 * SAMPLE_PER_CLASS rows of two numbers: safe to send to every executor.
    found = documents.select(key, text).join(F.broadcast(parts[0].unionByName(parts[1])), key)
    # Of the rows of one id the text of the smallest hash teaches, whatever their order.
    return found.groupBy(key, "toxic").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias(text)).select(key, text, "toxic"), sizes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        for label, text in zip(batch.column(1).to_pylist(), texts_of(batch.column(0)), strict=True):
            counts[label, grams(text)[0]] += 1
            rows[label] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at].astype(np.int64)), pa.array(counts[1, at].astype(np.int64))], ["bucket", "clean", "toxic"])
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array(rows[:1]), pa.array(rows[1:])], ["bucket", "clean", "toxic"])


def _logistic(counts: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, columns: int, strength: float = 0.02, steps: int = 400) -> tuple[float, np.ndarray]:
    """L2-regularised logistic regression by accelerated gradient steps; row after row, `counts` entries of (column, value) each. Entries are multiplied ENTRIES at a time."""
    n = len(y)
    row = np.repeat(np.arange(n, dtype=np.int32), counts)
    parts = [slice(i, i + ENTRIES) for i in range(0, len(at), ENTRIES)]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    def forward(w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(row[p], value[p] * w[at[p]], n) for p in parts), np.full(n, w[-1]))

    def backward(error: np.ndarray) -> np.ndarray:
        return sum((np.bincount(at[p], value[p] * error[row[p]], columns) for p in parts), np.zeros(columns))

    # A bound of the curvature: each row's squared length, by power iteration on the weighted matrix.
    v = np.ones(columns + 1)
    for _ in range(12):
        u = forward(v) * weight
        v = np.concatenate([backward(u), [u.sum()]])
        top = np.linalg.norm(v)
        v /= top or 1
    rate = 1 / (0.3 * top + strength / n)
    w = ahead = np.zeros(columns + 1)
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(ahead), -30, 30)))
        error = (p - y) * weight
        slope = np.concatenate([backward(error) + strength / n * ahead[:-1], [error.sum()]])
        new = ahead - rate * slope
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return float(w[-1]), w[:-1]


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    sample, sizes = _sample(documents, labels, key, text)
    total = sum(sizes.values())
    if len(sizes) < 2:
        share = 1e-6 if not sizes.get(1) else 1 - 1e-6
        return Model(float(np.log(share / (1 - share))), np.zeros(BUCKETS, np.float32))
    sample = stored(sample.select(F.col(text).alias("text"), "toxic").repartition(8), "toxic-sample")
    counts = sample.mapInArrow(_counted, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stored(counts, "toxic-counts")
    rows = counts.filter("bucket = -1").first()
    if rows is None or not rows["clean"] or not rows["toxic"]:
        return Model(float(np.log((sizes[1] / total) / (sizes[0] / total))), np.zeros(BUCKETS, np.float32))
    p, q = (F.col("toxic") + 1) / (rows["toxic"] + 2), (F.col("clean") + 1) / (rows["clean"] + 2)
    both = (F.col("toxic") + F.col("clean") + 2) / (rows["toxic"] + rows["clean"] + 4)
    apart = F.abs(p - q) / F.sqrt(both * (1 - both) + 1e-9)
    best = counts.filter("bucket >= 0").select("bucket", F.log(p / q).alias("ratio"), apart.alias("apart")).orderBy(F.desc("apart"), "bucket").limit(FEATURES).collect()
    ratios = np.zeros(BUCKETS, np.float32)
    column = np.full(BUCKETS, -1, np.int32)
    for i, r in enumerate(best):
        ratios[r["bucket"]], column[r["bucket"]] = r["ratio"], i

    def chosen(batches):
        for batch in batches:
            ids, values = [], []
            for at, n in map(grams, texts_of(batch.column(0))):
                at, n = at[column[at] >= 0], n[column[at] >= 0]
                value = ratios[at] * n
                if len(at) > ROW_FEATURES:
                    most = np.sort(np.argsort(-np.abs(value), kind="stable")[:ROW_FEATURES])
                    at, value = at[most], value[most]
                ids.append(column[at])
                values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["toxic", "ids", "values"])

    fit = sample.mapInArrow(chosen, "toxic int, ids array<int>, values array<float>").toArrow()
    of = np.array([r["ratio"] for r in best])
    y = fit.column("toxic").to_numpy().astype(float)
    ids, values = fit.column("ids").combine_chunks(), fit.column("values").combine_chunks()
    intercept, w = _logistic(pc.list_value_length(ids).to_numpy(), ids.flatten().to_numpy(), values.flatten().to_numpy(), y, len(best))
    # The fit weighs both classes alike; scores should follow the labels' own shares.
    intercept += float(np.log(sizes[1] / sizes[0]))
    weights = np.zeros(BUCKETS, np.float32)
    weights[[r["bucket"] for r in best]] = w * of
    return Model(intercept, weights)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """df with the probability in `into` that its text is toxic (a column of that name is replaced)."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers of 4 bytes
    kept = [c for c in df.columns if c != into]
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{into}` double"

    def run(batches):
        for batch in batches:
            column = pa.array(sent.value.scores(texts_of(batch.column(text))), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], column], [*kept, into])

    return df.mapInArrow(run, schema)


def keep_clean(df: DataFrame, model: Model, text: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of df whose text scores below `below`, with their columns."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return score(rows, model).filter(F.col("score") < below).select("row.*")


def scored_documents(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of documents: the key, whether it belongs to the held-out fold, the score and the verdict at 0.5."""
    model = train(documents, labels, key, text)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(texts_of(batch.column(1))), pa.float64())], [key, "score"])

    sent = documents.sparkSession.sparkContext.broadcast(model)
    scored = documents.select(key, text).mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, score double")
    return scored.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
