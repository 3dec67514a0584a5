"""History of throw-away repositories: exact values."""

from pyspark.sql import functions as F

from coderill.operators import temporal
from coderill.sources import git


def tables(spark, repo):
    commits = git.read(spark, str(repo.path), "commits").cache()
    changes = git.read(spark, str(repo.path), "file_changes").cache()
    return commits, changes


def sample(repo):
    one = "a\nb\nc\n"
    repo.commit(file_a="1\n2\n", file_b="1\n2\n")
    repo.commit(file_c="1\n")
    repo.commit(file_a="1\n2\n3\n", file_b="1\n2\n3\n")
    repo.commit(file_a="1\n2\n3\n4\n")
    repo.commit(file_b="1\n2\n3\n4\n", file_c="1\n2\n")
    return one


def test_sample_repository(spark, repo):
    sample(repo)
    commits, changes = tables(spark, repo)
    assert commits.count() == 5 and changes.select("file_path").distinct().count() == 3
    pairs = {(r.file_a, r.file_b): (r.co_change_count, r.jaccard_similarity) for r in temporal.jaccard(changes).collect()}
    assert pairs == {("file_a", "file_b"): (2, 0.5), ("file_b", "file_c"): (1, 0.25)}
    churn = {r.file_path: r for r in temporal.churn(changes, commits).collect()}
    assert (churn["file_a"].total_commits, churn["file_a"].author_count, churn["file_a"].total_lines_added, churn["file_a"].total_lines_deleted) == (3, 1, 5, 0)
    assert (churn["file_c"].total_commits, churn["file_b"].total_churn) == (2, 5)
    authors = spark.createDataFrame([(1, "Ann", "ann@x.org")], "id bigint, name string, email string")
    stats = temporal.author_stats(authors, commits, changes).collect()
    assert len(stats) == 1 and (stats[0].total_commits, stats[0].files_touched, stats[0].lines_added) == (5, 3, 12)
    assert temporal.high_coupling(temporal.jaccard(changes), temporal.churn(changes, commits)).isEmpty()
    assert temporal.ownership(changes, commits, authors).count() == 3


def test_deletion(spark, repo):
    repo.commit(file1="x\n", file2="y\n")
    repo.commit(file1=None, file3="z\n")
    commits, changes = tables(spark, repo)
    assert {r.change_type for r in changes.where("file_path = 'file1'").collect()} == {"A", "D"}
    pairs = temporal.jaccard(changes).collect()
    assert [(r.file_a, r.file_b, r.co_change_count, r.jaccard_similarity) for r in pairs] == [("file1", "file2", 1, 1.0)]


def test_rename_has_old_path(spark, repo):
    repo.commit(old_name="".join(f"line {i}\n" for i in range(30)))
    repo.git("mv", "old_name", "new_name")
    repo.commit()
    _, changes = tables(spark, repo)
    r = changes.where("change_type = 'R'").collect()
    assert [(x.file_path, x.old_path, x.lines_added) for x in r] == [("new_name", "old_name", 0)]


def test_perfect_high_single_and_empty(spark, repo, tmp_path):
    for k in range(5):
        repo.commit(a=f"{k}\n", b=f"{k}\n")
    commits, changes = tables(spark, repo)
    found = temporal.high_coupling(temporal.jaccard(changes), temporal.churn(changes, commits)).collect()
    assert [(r.co_change_count, r.jaccard_similarity, r.file_a_commits, r.file_b_commits) for r in found] == [(5, 1.0, 5, 5)]
    from tests.conftest import Repo

    single = Repo(tmp_path / "single")
    single.commit(only="x\n")
    assert temporal.jaccard(git.read(spark, str(single.path), "file_changes")).isEmpty()
    empty = Repo(tmp_path / "empty")
    assert git.read(spark, str(empty.path), "commits").count() == 0 and temporal.jaccard(git.read(spark, str(empty.path), "file_changes")).isEmpty()


def test_discover(repo, tmp_path):
    repo.commit(a="x\n")
    assert git.discover(str(tmp_path)) == [str(repo.path)] and git.discover(str(tmp_path / "none")) == [] and git.repo_name(str(repo.path)) == "sample"


def test_root_and_patch_lines():
    text = b"+a\n+++ b\n-c\n d\n++x"
    lines = text.split(b"\n")
    assert (git.signed(lines, b"+"), git.signed(lines, b"-"), git.pieces(text), git.pieces(b""), git.pieces(b"\xff\xfe")) == (2, 1, 5, 1, 0)
    assert [git.kind_of(x) for x in ("A", "D", "R087", "C100", "M", "T", "")] == ["A", "D", "R", "C", "M", "M", "M"]


def test_code_age_of_one_day_has_no_rate(spark):
    churned = spark.sql("select 'f' as file_path, timestamp '2024-01-01' as first_commit, timestamp '2024-01-01' as last_commit, 1 as total_commits")
    row = temporal.code_age(churned, F.expr("timestamp '2024-01-11 12:00:00'")).first()
    assert row.days_since_last_change == 10.5 and row.commits_per_month is None


def test_statistics_of_commits_and_authors_that_repeat(spark):
    from pyspark.sql import functions as F

    from coderill.operators import activity, temporal

    commits = spark.createDataFrame([(1, "A", "a", 1), (1, "A", "a", 1), (1, "B", "b", 5), (2, "A", "a", 3), (3, "C", None, 9), (4, "A", "a", 0)], "id long, author_name string, author_email string, t long").withColumn("timestamp", F.timestamp_seconds("t"))
    authors = spark.createDataFrame([(1, "A", "a"), (1, "A", "a"), (2, "B", "b"), (3, "C", None), (4, "D", "d")], "id long, name string, email string")
    changes = spark.createDataFrame([(1, "x", 10, 1, "M"), (1, "x", 5, 0, "A"), (2, "x", 7, 2, "M"), (2, "y", 1, 1, "D"), (3, "x", 2, 2, "M"), (None, "x", 1, 1, "M")], "commit_id long, file_path string, lines_added long, lines_deleted long, change_type string")
    seconds = lambda c: F.unix_seconds(c)
    got = temporal.churn(changes, commits)
    assert [tuple(r) for r in got.withColumns({"first_commit": seconds("first_commit"), "last_commit": seconds("last_commit")}).collect()] == [("x", 3, 54, 7, 61, 1, 9, 2)]
    stats = temporal.author_stats(authors, commits, changes)
    assert sorted(map(tuple, stats.withColumns({"first_commit": seconds("first_commit"), "last_commit": seconds("last_commit")}).collect())) == [("A", "a", 3, 2, 76, 10, 0, 3), ("B", "b", 1, 1, 15, 1, 5, 5)]
    assert sorted(map(tuple, temporal.ownership(changes, commits, authors).collect())) == [(1, "A", "x", 2, 74), (2, "B", "x", 1, 15)]
    areas = activity.active_areas(changes, commits, F.timestamp_seconds(F.lit(9)))
    assert [(r.file_path, r.recent_commits) for r in areas.orderBy("file_path").collect()] == [("x", 3), ("y", 1)]


def test_tasks_of_history_grow_with_its_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from coderill.operators import activity, temporal
    from coderill.operators.placing import tasks

    spark.range(2_500_000).selectExpr("id % 500000 as commit_id", "concat('f', id % 40) as file_path", "xxhash64(id) as lines_added", "1L as lines_deleted", "'M' as change_type").write.parquet(str(tmp_path / "changes"))
    spark.range(500_000).selectExpr("id", "concat('n', id % 900) as author_name", "concat('e', id % 900) as author_email", "timestamp_seconds(id) as timestamp").write.parquet(str(tmp_path / "commits"))
    changes, commits = (spark.read.parquet(str(tmp_path / x)) for x in ("changes", "commits"))
    authors = commits.selectExpr("id", "author_name as name", "author_email as email").where("id < 900")
    n = tasks(changes, commits)
    assert n > 4  # the session has 4 partitions
    found = temporal.churn(changes, commits), temporal.author_stats(authors, commits, changes), temporal.ownership(changes, commits, authors), activity.active_areas(changes, commits, F.timestamp_seconds(F.lit(400_000)))
    for df, least in zip(found, (n, n, n, n), strict=True):
        plan = df._jdf.queryExecution().executedPlan().toString()
        large = [int(x) for x in __import__("re").findall(r"hashpartitioning\(commit_id#\d+L?, (\d+)\)", plan)]
        assert large and min(large) >= least, plan
        assert "Expand" not in plan and "first(" not in plan
