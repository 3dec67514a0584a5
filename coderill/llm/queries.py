"""The ten operators over their whole tables, and the SQL that some of them can be expressed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, extshuffle, langid, licenses, ordermin, sstable, tiling, transcripts, warc, weakrules


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve(warc.captures_of_pages(_read(spark, sf_dir, "pages")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted documents."""
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).where("accepted")


def op3_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.to_shards(_read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    return weakrules.score(_read(spark, sf_dir, "documents")).where("keep")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that goes, with the near duplicate of it that stays."""
    return ordermin.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical turns of every conversation, recovered from its transcript."""
    made = transcripts.transcripts_of(_read(spark, sf_dir, "conversations"))
    return transcripts.parse(made, transcripts.fit(made))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, and whether they decode to its text."""
    return bpe.encode(_read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extshuffle.external_shuffle(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_revisits, op2_language_id, op3_sstable_shards, op4_quality_rules, op5_order_minhash, op6_chat_turns, op7_bpe, op8_license_scan, op9_decontamination, op10_external_shuffle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisits": warc.ORACLE_SQL, "op8_license_scan": licenses.oracle_sql()}
