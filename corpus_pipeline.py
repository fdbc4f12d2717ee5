"""A training-corpus pipeline: quality filter, line dedup, near dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the columns of documents. ``run`` writes each stage's result to the shared folder
and reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.llm import lines, minhash, packing, quality
from siltline.llm.common import stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored good and not toxic stay. The classifier is trained on the labelled ones among ``docs``."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all it had goes with them. n_chars follows the text."""
    left = lines.dedup(docs, drop_emptied=True)
    return left.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with the documents in them."""
    return packing.packed(docs)


STAGES = [("quality_classifier", quality_filter), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("best_fit_packing", pack)]

ORACLE_SQL = None  # neither the classifier nor min-max hashing nor packing can be expressed in SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
