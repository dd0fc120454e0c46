"""From documents to packed training sequences: five stages, each written and read again before the next.

An empty table passes through every stage as one. Rows that repeat an id are rows of their own, but for the third
stage, which keeps one of those with the same id and text. Further columns travel with their rows, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm import ngram_jaccard, packing, quality_rules, suffix_dedup, toxicity
from foliolens.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labelled ones among them, scores below 0.5. A null text scores as empty."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose posterior probability of being good is at least 0.5 and that pass the base rule; null texts don't."""
    return quality_rules.keep_good(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each class of texts linked by similar 5-word shingles."""
    return ngram_jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the strings of 200 bytes that stand elsewhere too."""
    return suffix_dedup.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' token pieces with their places in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Trained, iterative and byte-level stages are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
