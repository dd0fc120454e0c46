"""Cutting lineage in iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_KNOWN: set[str] = set()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared one; where none is set, in one of this process, if executors are part of it. All of an application's go when it ends."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named and not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="foliolens-"))
    base = f"{(named or _OWN[0]).rstrip('/')}/{context.applicationId}-steps"
    if base not in _KNOWN:
        _KNOWN.add(base)
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again. Unlike a checkpoint it is computed once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
