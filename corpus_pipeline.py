"""A training corpus out of ``documents``: stages that each take and return whole tables.

Each stage takes the documents that the one before kept, with their columns; what it rejects goes.
Null texts, empty tables, repeated rows and further columns are treated as the operators say; a stage
that rejects nothing returns all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modcensus.llm import op1_language, op4_near_duplicates, op6_secrets, op7_quality, op10_packing
from modcensus.llm.common import land, table


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; dictionaries are learned from those with a known one."""
    return op1_language.accepted_documents(docs, op1_language.learn(docs, F.lit(True)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the classifier, which is fitted on those with labels."""
    return op7_quality.kept_documents(docs, op7_quality.quality_model(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return op4_near_duplicates.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return op6_secrets.masked_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their sequences."""
    return op10_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", clear_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: compression, classifiers and hash signatures cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before is landed in the shared folder and read again."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = land(stage(spark, rows, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
