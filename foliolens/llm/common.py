"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_CLEARED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The application's folder inside the cluster's shared checkpoint folder, removed when the application ends.

    Where none is set, a folder of this process; that is an error unless driver and executors are one process.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="foliolens-"))
        named = _OWN[0]
    folder = f"{named.rstrip('/')}/{context.applicationId}"
    if folder not in _CLEARED:
        _CLEARED.add(folder)
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: the lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths add up to about `limit`; an element longer than that stands alone."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if len(lengths) > begin:
        yield begin, len(lengths)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_least: int) -> Iterator[pa.Table]:
    """Tables of at least `at_least` rows from batches sorted by `key`, cut only where the key changes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        joined = pa.Table.from_batches(held)
        values = joined.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(values != values[-1])[-1]) + 1 if (values != values[-1]).any() else 0
        if cut:
            yield joined.slice(0, cut)
            held = joined.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def once(build: Callable):
    """build(*args), kept for the life of the process: tables that every task of a Python worker shares."""
    kept: dict = {}

    def get(*args):
        if args not in kept:
            kept[args] = build(*args)
        return kept[args]

    return get


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_UP_DOWN = [np.ones(1, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 to the 64, and their inverses, up to the n-th at least: digests of stretches come from prefix sums."""
    if len(_UP_DOWN[0]) <= n:
        size = max(n + 1, 1 << 18)
        _UP_DOWN[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(x))]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _UP_DOWN[0], _UP_DOWN[1]
