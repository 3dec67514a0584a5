"""A corpus pipeline: each stage takes what its predecessor kept, as Parquet.

Defined cases: documents with a null text go in the first stage, those without a word or letter in the second at the latest; of
repeated rows, and of rows that share a text, one stays after the third; null ids and labels pass through (the label becomes the
language found); columns of any other name pass through, and the last stage's own get underscores in front where they clash; an
empty table gives an empty result with all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coderill.llm import bpe, langid, ordermin, tiling, weakrules
from coderill.llm.common import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is too low go."""
    return weakrules.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go; lang becomes the language found."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ordermin.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item go."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens."""
    return bpe.with_tokens(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe", tokenise),
]

#: SQL cannot express expectation-maximisation, alignment or merging.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
