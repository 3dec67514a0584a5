"""Source trees: files by extension, and what the parsers make of them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coderill.parsers import EXTENSIONS, SKIPPED, parse

FACT = T.StructType([T.StructField("language", T.StringType()), T.StructField("path", T.StringType()), T.StructField("file_hash", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("fact", T.MapType(T.StringType(), T.StringType()))])


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package where neither an installation nor PYTHONPATH does."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def files(spark: SparkSession, root: str, suffixes: list[str], skipped: set[str]) -> DataFrame:
    """(path, content, file_hash) of files with one of the suffixes, paths from ``root``, none inside a skipped folder.

    Content is read only for files that pass, by the executors.
    """
    base = Path(root).resolve().as_uri().replace("file:///", "file:/")
    # a suffix stands for all names that end with it; a pattern or a whole name for itself
    names = [x if "*" in x or not x.startswith(".") else "*" + x for x in sorted(suffixes)]
    glob = "{" + ",".join(names) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(str(Path(root).resolve()))
    path = F.substring("path", len(base) + 2, 1 << 20)
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    outside = ~F.arrays_overlap(F.split(F.col("path"), "/"), F.array(*(F.lit(x) for x in sorted(skipped)))) if skipped else F.lit(True)
    # the condition is on the path from the root
    return found.select(path.alias("path"), "content").where(outside).withColumn("file_hash", F.sha2("content", 256))


def languages_of(suffix_map: dict[str, tuple[str, ...]] = EXTENSIONS) -> list[str]:
    return list(suffix_map)


def source_files(spark: SparkSession, root: str, language: str | None = None) -> DataFrame:
    """Files of one language, or of all in one scan; where languages share a suffix, a file is there once for each."""
    wanted = {k: v for k, v in EXTENSIONS.items() if language in (None, k)}
    found = files(spark, root, sorted({x for v in wanted.values() for x in v}), SKIPPED)
    of = F.array(*(F.when(F.exists(F.array(*(F.lit(x) for x in v)), lambda x: F.col("path").endswith(x)), F.lit(k)) for k, v in wanted.items()))
    return found.withColumn("language", F.explode(F.array_compact(of)))


def facts(scanned: DataFrame) -> DataFrame:
    """(language, path, file_hash, entity, fact) of all entities that the parsers find; a file that is no UTF-8 has none, one that can't
    be parsed is a module without content."""
    workers_see_package(scanned.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for language, path, file_hash, content in zip(b["language"], b["path"], b["file_hash"], b["content"], strict=True):
                try:
                    text = bytes(content).decode()
                except UnicodeDecodeError:
                    continue
                rows += [(language, path, file_hash, entity, {k: None if v is None else str(v) for k, v in fact.items()}) for entity, fact in parse(language, path, text)]
            yield pd.DataFrame(rows, columns=FACT.names)

    return scanned.select("language", "path", "file_hash", "content").mapInPandas(run, FACT)


def entity(found: DataFrame, kind: str, /, **columns: str) -> DataFrame:
    """The facts of one kind as a table: language, path and the given fields, cast to the given types."""
    return found.where(F.col("entity") == kind).select("language", "path", *(F.col("fact")[k].cast(v).alias(k) for k, v in columns.items()))
