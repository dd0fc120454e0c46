"""Where query modules register themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB equivalent where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Tables of long texts, and parts, of which queries make pages and texts: where they lie in fewer splits than there are cores, their rows are dealt out before the work.
LONG = ("pages", "documents", "part")
#: Parts of which one task makes pages, and rows that one task sorts, at most about.
PARTS, ROWS = 20_000, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "part":  # a split of a few MB holds a million of them
        cores = max(cores, -(-df.count() // PARTS))
    return df.repartition(cores) if name in LONG and df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, by: str, rows: int = ROWS) -> DataFrame:
    """Rows of a table by a column, in partitions of about so many rows however large it is; Parquet is counted by its footers."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), by)
