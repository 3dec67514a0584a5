"""When commits happen: weekday and hour, weeks, active areas, age bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderill.functions.scalars import monday_week
from coderill.operators.placing import meet, tasks
from coderill.operators.temporal import live


def commit_time(commits: DataFrame) -> DataFrame:
    """By weekday (0 is Sunday) and hour."""
    return commits.groupBy((F.dayofweek("timestamp") - 1).alias("day_of_week"), F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("commit_count"))


def weekly(commits: DataFrame) -> DataFrame:
    return commits.groupBy(monday_week(F.col("timestamp")).alias("week")).agg(F.count(F.lit(1)).alias("commit_count"))


def latest_weeks(commits: DataFrame, n: int = 52) -> DataFrame:
    return weekly(commits).orderBy(F.desc("week")).limit(n)


def active_areas(changes: DataFrame, commits: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Files that were touched in the last ``days``: distinct commits and the last one."""
    recent = commits.where(F.col("timestamp") >= as_of - F.expr(f"interval {days} days")).select(F.col("id").alias("commit_id"), "timestamp")
    touched = changes.select("commit_id", "file_path")
    by_commit = meet(touched, recent, "commit_id", tasks(changes, commits)).groupBy("commit_id", "file_path").agg(F.max("timestamp").alias("at"))
    return by_commit.groupBy("file_path").agg(F.count("commit_id").alias("recent_commits"), F.max("at").alias("last_commit"))


def commit_stats(commits: DataFrame) -> DataFrame:
    return commits.agg(F.count(F.lit(1)).alias("total_commits"), F.countDistinct("author_name").alias("authors"), F.min("timestamp").alias("first_commit"), F.max("timestamp").alias("last_commit"))


def churn_score(churned: DataFrame) -> DataFrame:
    return churned.select("file_path", (F.col("total_commits") + F.col("total_lines_added") + F.col("total_lines_deleted")).alias("churn_score"))


def age_bands(aged: DataFrame) -> DataFrame:
    """Old beyond a year, ageing beyond half a year."""
    days = F.col("days_since_last_change")
    return aged.select("file_path", F.when(days > 365, "red").when(days > 180, "amber").otherwise("normal").alias("band"))


def author_totals(stats: DataFrame) -> DataFrame:
    """Sums over authors (a file counts once for each), and the share of the most active one in percent."""
    commits = F.sum("total_commits")
    return stats.agg(
        commits.alias("commits"), F.sum(F.coalesce("lines_added", F.lit(0))).alias("lines"), F.sum("files_touched").alias("files"), F.when(commits > 0, F.max("total_commits") * 100.0 / commits).alias("top_share")
    )


__all__ = ["active_areas", "age_bands", "author_totals", "churn_score", "commit_stats", "commit_time", "latest_weeks", "live", "weekly"]
