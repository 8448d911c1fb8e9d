"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, inner, interaction, lexical, licenses, neardup, packing, quality, secrets, substrings, suffixes, toxicity
from .common import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": _documents(fingerprints.fingerprints),
    "op2_packing": _documents(lambda docs: packing.pack(docs, WORD_VOCABULARY)),
    "op3_secrets": _documents(secrets.scan),
    "op4_toxicity": lambda spark, sf_dir: toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_substrings": _documents(substrings.dedup_words),
    "op6_suffixes": _documents(suffixes.dedup_bytes),
    "op7_licenses": _documents(licenses.scan),
    "op8_bpe": _documents(lambda docs: bpe.round_trip(docs, BYTE_VOCABULARY)),
    "op9_quality": _documents(quality.judge),
    "op10_neardup": _documents(neardup.near_duplicates),
    "op11_interaction": lambda spark, sf_dir: interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op12_inner": lambda spark, sf_dir: inner.nearest(table(spark, sf_dir, "embeddings")),
    "op13_lexical": lambda spark, sf_dir: lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}

#: SQL where it can express a query in a time that whole tables allow.
SQL: dict[str, str] = {"op11_interaction": interaction.SQL, "op12_inner": inner.SQL, "op13_lexical": lexical.SQL}
