"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import neardup, packing, secrets, suffixes, toxicity
from tickloom.llm.common import stored, table
from tickloom.llm.queries import WORD_VOCABULARY

#: The stage links from here on; 85 is op10's own.
NEAR_PERCENT = 80


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under 0.5; the model learns from the labelled rows of docs."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.accepted(docs, toxicity.train(docs, labels))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: NEAR_PERCENT of the shingles of both in common."""
    return neardup.dedup(docs, NEAR_PERCENT)


def _suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that stand in more than one place."""
    return suffixes.strip(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of every secret."""
    return secrets.redact(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences."""
    return packing.pack(docs, WORD_VOCABULARY)


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("suffix_dedup", _suffix_dedup), ("secrets", _secrets), ("packing", _packing)]

#: No SQL expresses the learned, hashed and tokenizing stages. Tests hold near_dedup against brute force; the row
#: of all stages is not tested yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
