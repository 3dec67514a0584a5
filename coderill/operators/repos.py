"""Many repositories at once: tables that carry a ``repo`` column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_repos(df: DataFrame, repos: list[str] | None) -> DataFrame:
    """Rows of the named repositories (all for None); with tables partitioned by repo this prunes partitions."""
    return df if repos is None else df.where(F.col("repo").isin(repos))


def tagged(df: DataFrame, repo: str) -> DataFrame:
    return df.withColumn("repo", F.lit(repo))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def overview(by_repo: DataFrame, *sums: str) -> DataFrame:
    return by_repo.agg(F.count(F.lit(1)).alias("repos"), *(F.sum(c).alias(c) for c in sums))


def most(by_repo: DataFrame, metric: str, position: Column) -> DataFrame:
    """The repository with the highest metric; of equals the one of the last position."""
    return by_repo.agg(F.max_by("repo", F.struct(F.col(metric), position)).alias("repo"), F.max(metric).alias(metric))
