"""A corpus from documents to packed sequences: toxicity, quality, near-duplicates, repeated passages, packing.

Every stage takes what its predecessor kept. The classifiers are fitted on a bounded sample of the labelled rows among it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.chunks import cut_repeats
from leafmill.llm.common import stage, table
from leafmill.llm.neardup import deduplicate
from leafmill.llm.packing import pack_documents
from leafmill.llm.quality import keep_quality
from leafmill.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return deduplicate(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in others before; n_chars follows the text."""
    cut = cut_repeats(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens and their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("best-fit packing", packing),
]

#: Models, hashes and packings aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
