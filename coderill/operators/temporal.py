"""History: churn, ownership and change coupling.

Inputs are commits (id, author_name, author_email, timestamp), authors (id, name, email) and file changes (commit_id,
file_path, lines_added, lines_deleted, change_type). Deletions count neither in churn, coupling nor ownership, but do in
the statistics of authors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coderill.functions.scalars import days_between, month
from coderill.operators.placing import meet, tasks

#: Files of a commit of which one task makes all pairs.
COMMIT_BLOCK = 512


def live(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("change_type") != "D")


def _of_commits(changes: DataFrame, commits: DataFrame) -> DataFrame:
    return changes.join(commits.select(F.col("id").alias("commit_id"), "author_email", "timestamp"), "commit_id")


def first_seen_authors(commits: DataFrame, position: str) -> DataFrame:
    """One (name, email) for each email: the name of the commit that was met first."""
    first = F.min(F.struct(position, "author_name")).alias("seen")
    return commits.groupBy(F.col("author_email").alias("email")).agg(first).select(F.col("seen.author_name").alias("name"), "email")


def _dated(changes: DataFrame, commits: DataFrame, n: int, *others: str) -> DataFrame:
    """``_of_commits`` in ``n`` tasks by commit."""
    dates = commits.select(F.col("id").alias("commit_id"), *others)
    return meet(changes, dates, "commit_id", n)


def churn(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """By file: commits, lines, first and last commit, authors."""
    n = tasks(changes, commits)
    plus, minus = F.sum("plus"), F.sum("minus")
    # commits first, which keeps to the join's partitioning, then authors: no distinct count is left, and no text is aggregated
    by_commit = _dated(live(changes), commits, n, "author_email", "timestamp").groupBy("commit_id", "file_path", F.col("author_email").alias("email"), "timestamp").agg(F.sum("lines_added").alias("plus"), F.sum("lines_deleted").alias("minus"))
    # a commit that is there under two authors counts once
    once = F.row_number().over(W.partitionBy("commit_id", "file_path").orderBy("email", "timestamp")) == 1
    by_author = by_commit.withColumn("once", F.when(once, F.lit(1))).repartition(n, "file_path", "email").groupBy("file_path", "email").agg(
        F.count("once").alias("commits"), plus.alias("plus"), minus.alias("minus"), F.sum(F.col("plus") + F.col("minus")).alias("both"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    return by_author.groupBy("file_path").agg(
        F.sum("commits").alias("total_commits"), plus.alias("total_lines_added"), minus.alias("total_lines_deleted"), F.sum("both").alias("total_churn"),
        F.min("first").alias("first_commit"), F.max("last").alias("last_commit"), F.count("email").alias("author_count"),
    )


def author_stats(authors: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """By author: commits (also those without files), distinct files, lines (null without changes), first and last commit.

    Commits are counted without their files, and files by author and file, so that nothing is counted distinct twice at once.
    """
    n = tasks(authors, commits, changes)
    made = commits.select("id", F.col("author_email").alias("email"), "timestamp").where("author_email is not null")
    by_id = made.repartition(n, "email").groupBy("email", "id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    own = by_id.groupBy("email").agg(F.count("id").alias("total_commits"), F.min("first").alias("first_commit"), F.max("last").alias("last_commit"))
    theirs = _dated(changes, commits.where("author_email is not null"), n, F.col("author_email").alias("email")).repartition(n, "email", "file_path")
    by_file = theirs.groupBy("email", "file_path").agg(F.sum("lines_added").alias("plus"), F.sum("lines_deleted").alias("minus"))
    touched = by_file.repartition(n, "email").groupBy("email").agg(F.count("file_path").alias("files_touched"), F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))
    # an author who is there several times has his lines as often
    known = authors.where("email is not null").repartition(n, "email").groupBy("email", "name").agg(F.count(F.lit(1)).alias("times"))
    return known.join(own.hint("merge"), "email").join(touched.hint("merge"), "email", "left").select(
        "name", "email", "total_commits", F.coalesce("files_touched", F.lit(0)).cast("bigint").alias("files_touched"), (F.col("plus") * F.col("times")).alias("lines_added"), (F.col("minus") * F.col("times")).alias("lines_deleted"),
        "first_commit", "last_commit",
    )


def commit_frequency(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """By file and month: changes and churn."""
    dated = _of_commits(live(changes), commits)
    return dated.groupBy("file_path", month(F.col("timestamp")).alias("month")).agg(F.count(F.lit(1)).alias("change_count"), F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("churn"))


def touched(changes: DataFrame) -> DataFrame:
    """Distinct (commit_id, file_path) that a commit leaves in place."""
    return live(changes).select("commit_id", "file_path").distinct()


def jaccard(changes: DataFrame, block: int = COMMIT_BLOCK) -> DataFrame:
    """Pairs file_a < file_b with a common commit: co_change_count and shared commits over all commits of either.

    Counts are enough; no set of commits is put together. Pairs come from a self-join on the commit, so files that never
    change together never meet. A commit of more than ``block`` files is cut into blocks, and each pair of blocks is a key of
    its own, so that no task makes all pairs of a huge commit.
    """
    seen = touched(changes)
    huge = seen.groupBy("commit_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    placed = seen.join(huge, "commit_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("file_path"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    total = seen.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    a = placed.select("commit_id", F.col("own").alias("i"), F.col("other").alias("j"), F.col("file_path").alias("file_a"))
    b = placed.select("commit_id", F.col("other").alias("i"), F.col("own").alias("j"), F.col("file_path").alias("file_b"))
    both = a.join(b, ["commit_id", "i", "j"]).where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("co_change_count"))
    na, nb = total.select(F.col("file_path").alias("file_a"), F.col("n").alias("na")), total.select(F.col("file_path").alias("file_b"), F.col("n").alias("nb"))
    joined = both.join(na, "file_a").join(nb, "file_b")
    return joined.select("file_a", "file_b", "co_change_count", (F.col("co_change_count") / (F.col("na") + F.col("nb") - F.col("co_change_count"))).alias("jaccard_similarity"))


def coupled(pairs: DataFrame, least_count: int = 2, least_similarity: float = 0.0) -> DataFrame:
    return pairs.where((F.col("co_change_count") >= least_count) & (F.col("jaccard_similarity") >= least_similarity))


def high_coupling(pairs: DataFrame, churned: DataFrame, least_count: int = 3, least_similarity: float = 0.3) -> DataFrame:
    """Strong pairs with the commits of each file; a file without churn has null."""
    out = coupled(pairs, least_count, least_similarity)
    for x in "ab":
        out = out.join(churned.select(F.col("file_path").alias(f"file_{x}"), F.col("total_commits").alias(f"file_{x}_commits")), f"file_{x}", "left")
    return out.select("file_a", "file_b", "co_change_count", "jaccard_similarity", "file_a_commits", "file_b_commits")


def code_age(churned: DataFrame, as_of: Column) -> DataFrame:
    """Days since the last change, days active and commits in 30 active days (null for a file of one day)."""
    active = days_between(F.col("last_commit"), F.col("first_commit"))
    return churned.select(
        "file_path", "first_commit", "last_commit", "total_commits", days_between(as_of, F.col("last_commit")).alias("days_since_last_change"), active.alias("days_active"),
        (F.col("total_commits").cast("double") / F.nullif(active / 30.0, F.lit(0.0))).alias("commits_per_month"),
    )


def ownership(changes: DataFrame, commits: DataFrame, authors: DataFrame) -> DataFrame:
    """By author and file: distinct commits and lines added."""
    n = tasks(changes, commits, authors)
    who = authors.select(F.col("email").alias("author_email"), F.col("id").alias("author_id"), F.col("name").alias("author_name"))
    made = meet(commits.select("id", "author_email"), who, "author_email", n)
    theirs = _dated(live(changes), made, n, "author_id", "author_name").groupBy("commit_id", "author_id", "author_name", "file_path").agg(F.sum("lines_added").alias("plus"))
    return theirs.repartition(n, "author_id", "author_name", "file_path").groupBy("author_id", "author_name", "file_path").agg(F.count("commit_id").alias("commit_count"), F.sum("plus").alias("lines_contributed"))


def _scalar(df: DataFrame, *aggregates: Column) -> DataFrame:
    return df.agg(*aggregates)


def summary(commits: DataFrame, authors: DataFrame, changes: DataFrame, pairs: DataFrame, with_deleted: bool = False) -> DataFrame:
    """One row of totals; files that were only ever deleted count on demand."""
    files = changes if with_deleted else live(changes)
    parts = [
        _scalar(commits, F.count(F.lit(1)).alias("total_commits"), F.min("timestamp").alias("first_commit"), F.max("timestamp").alias("last_commit")),
        _scalar(authors, F.count(F.lit(1)).alias("total_authors")),
        _scalar(files, F.countDistinct("file_path").alias("total_files")),
        _scalar(pairs, F.count(F.lit(1)).alias("total_couplings")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def file_churn_all(changes: DataFrame) -> DataFrame:
    """By file, over changes of all types."""
    plus, minus = F.sum("lines_added"), F.sum("lines_deleted")
    return changes.groupBy("file_path").agg(F.count(F.lit(1)).alias("change_count"), plus.alias("lines_added"), minus.alias("lines_deleted"), (plus + minus).alias("churn_score"))


def top_of_each(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; ``order`` must break all ties."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)
