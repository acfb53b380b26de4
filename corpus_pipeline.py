"""The corpus pipeline: rejects of the quality classifier go, one document of each group of
near duplicates stays, contaminated documents go, and the rest is encoded.

Every stage but the last returns the columns of ``docs``; each works on all that the stage
before it kept. Rows without an id pass through like others. Nulls count as empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, neardup, quality, tiling
from palimpsest.sources.model import table
from palimpsest.sources.store import Store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model) >= quality.CUTOFF)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: SQL can express none of the four.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    store = Store(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = store.save(docs)
    return docs
