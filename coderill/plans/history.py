"""Queries about commits, authors and files over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderill.adapters import AS_OF, Logical
from coderill.functions import scalars
from coderill.operators import activity, temporal
from coderill.operators.placing import sorted_in, tasks
from coderill.plans.registry import SHARED, query


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp")


SHARED |= {
    "vw_dated": "select c.*, k.author_email as email, k.ts from lg_live c join lg_commits k on k.id = c.commit_id",
    "vw_churn": "select f as file_path, count(distinct commit_id) as total_commits, sum(plus)::bigint as total_lines_added, sum(minus)::bigint as total_lines_deleted, sum(plus + minus)::bigint as total_churn,"
    " min(ts) as first_commit, max(ts) as last_commit, count(distinct email) as author_count from vw_dated group by f",
    "vw_stats": "select a.name, a.email, count(distinct k.id) as total_commits, count(distinct c.f) as files_touched, sum(c.plus)::bigint as lines_added, sum(c.minus)::bigint as lines_deleted,"
    " min(k.ts) as first_commit, max(k.ts) as last_commit from lg_authors a join lg_commits k on k.author_email = a.email left join lg_changes c on c.commit_id = k.id group by a.name, a.email",
    "vw_age": f"select file_path, first_commit, last_commit, total_commits, (epoch_us(timestamp '{AS_OF}') - epoch_us(last_commit)) / 86400000000.0::double as days_since_last_change,"
    " (epoch_us(last_commit) - epoch_us(first_commit)) / 86400000000.0::double as days_active from vw_churn",
    "vw_weeks": "select strftime(ts, '%Y-%W') as week, count(*) as commit_count from lg_commits group by 1",
    "vw_all_churn": "select f as file_path, count(*) as change_count, sum(plus)::bigint as lines_added, sum(minus)::bigint as lines_deleted, sum(plus)::bigint + sum(minus)::bigint as churn_score from lg_changes group by f",
}


def churned(t: Logical) -> DataFrame:
    return temporal.churn(t.changes, t.commits)


def stats(t: Logical) -> DataFrame:
    return temporal.author_stats(t.authors, t.commits, t.changes)


def aged(t: Logical) -> DataFrame:
    return temporal.code_age(churned(t), now())


@query("select * from vw_churn")
def agg_churn(t: Logical) -> DataFrame:
    return churned(t)


@query("select * from vw_stats")
def agg_author_stats(t: Logical) -> DataFrame:
    return stats(t)


@query("select f as file_path, strftime(ts, '%Y-%m') as month, count(*) as change_count, sum(plus + minus)::bigint as churn from vw_dated group by 1, 2")
def agg_commit_frequency(t: Logical) -> DataFrame:
    return temporal.commit_frequency(t.changes, t.commits)


@query("select *, total_commits / nullif(days_active / 30.0::double, 0) as commits_per_month from vw_age")
def agg_code_age(t: Logical) -> DataFrame:
    return aged(t)


@query("select a.id as author_id, a.name as author_name, d.f as file_path, count(distinct commit_id) as commit_count, sum(plus)::bigint as lines_contributed from vw_dated d join lg_authors a on a.email = d.email group by 1, 2, 3")
def agg_ownership(t: Logical) -> DataFrame:
    return temporal.ownership(t.changes, t.commits, t.authors)


_TOTALS = (
    "select (select count(*) from lg_commits) as total_commits, (select min(ts) from lg_commits) as first_commit, (select max(ts) from lg_commits) as last_commit,"
    " (select count(*) from lg_authors) as total_authors, (select count(distinct f) from {files}) as total_files, (select count(*) from vw_pairs) as total_couplings"
)


@query(_TOTALS.format(files="lg_live"))
def agg_summary(t: Logical) -> DataFrame:
    return temporal.summary(t.commits, t.authors, t.changes, temporal.jaccard(t.changes))


@query(_TOTALS.format(files="lg_changes"))
def agg_git_stats(t: Logical) -> DataFrame:
    return temporal.summary(t.commits, t.authors, t.changes, temporal.jaccard(t.changes), with_deleted=True)


@query("select dayofweek(ts)::int as day_of_week, hour(ts)::int as hour, count(*) as commit_count from lg_commits group by 1, 2")
def agg_commit_time(t: Logical) -> DataFrame:
    return activity.commit_time(t.commits)


@query("select * from vw_weeks")
def agg_weekly(t: Logical) -> DataFrame:
    return activity.weekly(t.commits)


@query("select * from vw_weeks order by week desc limit 52")
def top52_weeks(t: Logical) -> DataFrame:
    return activity.latest_weeks(t.commits)




@query(f"select c.f as file_path, count(distinct c.commit_id) as recent_commits, max(k.ts) as last_commit from lg_changes c join lg_commits k on k.id = c.commit_id where k.ts >= timestamp '1998-07-01' - interval 30 day group by 1")
def agg_active_areas(t: Logical) -> DataFrame:
    return activity.active_areas(t.changes, t.commits, F.lit("1998-07-01 00:00:00").cast("timestamp"))


@query("select id, author_email from lg_commits where ts >= timestamp '1998-07-01' - interval 30 day")
def flt_recent_30d(t: Logical) -> DataFrame:
    return t.commits.where(F.col("timestamp") >= F.expr("timestamp '1998-07-01 00:00:00' - interval 30 days")).select("id", "author_email")


@query("select count(*) as total_commits, count(distinct author_name) as authors, min(ts) as first_commit, max(ts) as last_commit from lg_commits")
def agg_commit_stats(t: Logical) -> DataFrame:
    return activity.commit_stats(t.commits)


@query("select * from vw_all_churn")
def agg_file_churn_all(t: Logical) -> DataFrame:
    return temporal.file_churn_all(t.changes)


@query("select file_path, churn_score from vw_all_churn")
def prj_churn_score_b(t: Logical) -> DataFrame:
    return temporal.file_churn_all(t.changes).select("file_path", "churn_score")


@query("select file_path, total_commits + total_lines_added + total_lines_deleted as churn_score from vw_churn")
def prj_churn_score_a(t: Logical) -> DataFrame:
    return activity.churn_score(churned(t))


@query("select file_path, case when days_since_last_change > 365 then 'red' when days_since_last_change > 180 then 'amber' else 'normal' end as band from vw_age")
def prj_age_band(t: Logical) -> DataFrame:
    return activity.age_bands(aged(t))


@query("select sum(total_commits)::bigint as commits, sum(coalesce(lines_added, 0))::bigint as lines, sum(files_touched)::bigint as files, max(total_commits) * 100.0::double / sum(total_commits) as top_share from vw_stats")
def agg_author_totals(t: Logical) -> DataFrame:
    return activity.author_totals(stats(t))


@query("select max(total_commits) * 100.0::double / sum(total_commits) as top_share from vw_stats")
def agg_top_share(t: Logical) -> DataFrame:
    return activity.author_totals(stats(t)).select("top_share")


@query("select id, commit_id, f as file_path, ct as change_type from lg_live")
def flt_not_deleted(t: Logical) -> DataFrame:
    return temporal.live(t.changes).select("id", "commit_id", "file_path", "change_type")


@query("select * from vw_churn where file_path = (select min(file_path) from vw_churn)")
def flt_file(t: Logical) -> DataFrame:
    first = temporal.live(t.changes).agg(F.min("file_path").alias("file_path"))
    return churned(t).join(first, "file_path", "left_semi")


@query("select id, commit_id, f as file_path, email as author_email, ts as timestamp from vw_dated")
def jn_changes_commits(t: Logical) -> DataFrame:
    return temporal._of_commits(temporal.live(t.changes), t.commits).select("id", "commit_id", "file_path", "author_email", "timestamp")


@query("select k.id as commit_id, a.id as author_id from lg_commits k join lg_authors a on a.email = k.author_email")
def jn_author_commits(t: Logical) -> DataFrame:
    return t.commits.select(F.col("id").alias("commit_id"), F.col("author_email").alias("email")).join(t.authors.select(F.col("id").alias("author_id"), "email"), "email").select("commit_id", "author_id")


@query("select k.id as commit_id, c.f as file_path from lg_commits k left join lg_changes c on c.commit_id = k.id")
def jn_author_changes_left(t: Logical) -> DataFrame:
    return t.commits.select(F.col("id").alias("commit_id")).join(t.changes, "commit_id", "left").select("commit_id", "file_path")


@query("select author_email as email, arg_min(author_name, id) as name from lg_commits group by 1")
def src_commits_first_author(t: Logical) -> DataFrame:
    return temporal.first_seen_authors(t.commits, "id")


@query("select distinct f as file_path from lg_live")
def set_distinct_files(t: Logical) -> DataFrame:
    return temporal.live(t.changes).select("file_path").distinct()


def _top(sql: str, order: str, n: int | None = None) -> str:
    return f"select * from {sql} order by {order}" + (f" limit {n}" if n else "")


@query(_top("vw_churn", "total_churn desc, file_path"))
def srt_churn(t: Logical) -> DataFrame:
    return churned(t).orderBy(F.desc("total_churn"), "file_path")


@query(_top("vw_churn", "total_churn desc, file_path", 10))
def top10_churn(t: Logical) -> DataFrame:
    return churned(t).orderBy(F.desc("total_churn"), "file_path").limit(10)


@query(_top("vw_all_churn", "churn_score desc, file_path", 50))
def top50_churn(t: Logical) -> DataFrame:
    return temporal.file_churn_all(t.changes).orderBy(F.desc("churn_score"), "file_path").limit(50)


@query("select file_path, days_since_last_change from vw_age order by days_since_last_change desc, file_path limit 50")
def top50_oldest(t: Logical) -> DataFrame:
    return aged(t).select("file_path", "days_since_last_change").orderBy(F.desc("days_since_last_change"), "file_path").limit(50)


@query("select f as file_path, strftime(ts, '%Y-%m') as month, count(*) as change_count, sum(plus + minus)::bigint as churn from vw_dated group by 1, 2 order by month desc, file_path limit 100")
def top100_freq(t: Logical) -> DataFrame:
    return temporal.commit_frequency(t.changes, t.commits).orderBy(F.desc("month"), "file_path").limit(100)


@query(_top("vw_stats", "total_commits desc, email"))
def srt_authors(t: Logical) -> DataFrame:
    return stats(t).orderBy(F.desc("total_commits"), "email")


@query("select a.name as author_name, d.f as file_path, count(distinct commit_id) as commit_count from vw_dated d join lg_authors a on a.email = d.email group by 1, 2 order by 3 desc, 1, 2")
def srt_ownership(t: Logical) -> DataFrame:
    found = temporal.ownership(t.changes, t.commits, t.authors).select("author_name", "file_path", "commit_count")
    return sorted_in(found, tasks(found), F.desc("commit_count"), F.col("author_name"), F.col("file_path"))


@query("select file_path, days_since_last_change from vw_age order by 2 desc, 1")
def srt_age(t: Logical) -> DataFrame:
    return aged(t).select("file_path", "days_since_last_change").orderBy(F.desc("days_since_last_change"), "file_path")


@query("select * from (select *, row_number() over (partition by repo order by total_churn desc, file_path) as place from (select split_part(file_path, '/', 1) as repo, file_path, total_churn from vw_churn)) where place <= 10")
def top10_churn_per_repo(t: Logical) -> DataFrame:
    by = churned(t).select(scalars.directory(F.col("file_path")).alias("repo"), "file_path", "total_churn")
    return temporal.top_of_each(by, "repo", [F.desc("total_churn"), F.asc("file_path")], 10)


@query("select event_id, strftime(ts, '%Y-%W') as week, strftime(ts, '%Y-%m') as month, dayofweek(ts)::int as day_of_week, hour(ts)::int as hour from events")
def fn_time_buckets(t: Logical) -> DataFrame:
    ts = F.col("ts")
    return t.table("events").select("event_id", scalars.monday_week(ts).alias("week"), scalars.month(ts).alias("month"), (F.dayofweek(ts) - 1).alias("day_of_week"), F.hour(ts).alias("hour"))
