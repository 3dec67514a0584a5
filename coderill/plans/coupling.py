"""Queries about files that change together, and across repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.adapters import Logical
from coderill.functions.scalars import directory
from coderill.operators import graph, matrix, repos, temporal
from coderill.plans.history import churned
from coderill.plans.registry import SHARED, query

#: The driver tables couple loosely: files share few commits out of many.
COUNT, SIMILARITY = 3, 0.01

SHARED |= {
    "vw_touched": "select distinct commit_id, f from lg_live",
    "vw_pairs": "select a as file_a, b as file_b, co as co_change_count, co / (na.n + nb.n - co) as jaccard_similarity from (select x.f as a, y.f as b, count(*) as co from vw_touched x join vw_touched y on x.commit_id = y.commit_id and x.f < y.f group by 1, 2)"
    " join (select f, count(*) as n from vw_touched group by 1) na on na.f = a join (select f, count(*) as n from vw_touched group by 1) nb on nb.f = b",
    "vw_strong": f"select * from vw_pairs where co_change_count >= {COUNT} and jaccard_similarity >= {SIMILARITY}",
    "vw_file_index": "select f as path, split_part(f, '/', 1) as dir, row_number() over (order by split_part(f, '/', 1), f) - 1 as idx from (select distinct f from lg_live)",
    "vw_temporal_cells": f"select x.idx as row, y.idx as col, v as value from (select file_a as a, file_b as b, jaccard_similarity as v from vw_pairs where jaccard_similarity >= {SIMILARITY} union all select file_b, file_a, jaccard_similarity from vw_pairs where jaccard_similarity >= {SIMILARITY})"
    " join vw_file_index x on x.path = a join vw_file_index y on y.path = b",
    "vw_repos": "select split_part(file_path, '/', 1) as repo, sum(total_commits)::bigint as commits, count(*) as files, sum(total_churn)::bigint as churn from vw_churn group by 1",
}


def pairs(t: Logical) -> DataFrame:
    return temporal.jaccard(t.changes)


def strong(t: Logical) -> DataFrame:
    return temporal.coupled(pairs(t), COUNT, SIMILARITY)


def by_repo(t: Logical) -> DataFrame:
    """First directories stand for repositories."""
    tagged = churned(t).withColumn("repo", directory(F.col("file_path")))
    return tagged.groupBy("repo").agg(F.sum("total_commits").alias("commits"), F.count(F.lit(1)).alias("files"), F.sum("total_churn").alias("churn"))


@query("select * from vw_pairs")
def agg_jaccard(t: Logical) -> DataFrame:
    return pairs(t)


@query("select file_a, file_b, co_change_count from vw_pairs")
def jn_pairs_cochange(t: Logical) -> DataFrame:
    return pairs(t).select("file_a", "file_b", "co_change_count")


@query("select * from vw_strong")
def flt_coupling_threshold(t: Logical) -> DataFrame:
    return strong(t)


@query("select s.*, x.total_commits as file_a_commits, y.total_commits as file_b_commits from vw_strong s left join vw_churn x on x.file_path = file_a left join vw_churn y on y.file_path = file_b")
def agg_high_coupling(t: Logical) -> DataFrame:
    return temporal.high_coupling(pairs(t), churned(t), COUNT, SIMILARITY)


@query("select * from vw_strong order by jaccard_similarity desc, co_change_count desc, file_a, file_b")
def srt_coupling(t: Logical) -> DataFrame:
    return strong(t).orderBy(F.desc("jaccard_similarity"), F.desc("co_change_count"), "file_a", "file_b")


@query("select node, count(*) as links, max(s) as strongest from (select file_a as node, jaccard_similarity as s from vw_strong union all select file_b, jaccard_similarity from vw_strong) group by node")
def gr_network(t: Logical) -> DataFrame:
    return graph.network(strong(t))


@query("select file_a as node from vw_strong union select file_b from vw_strong")
def set_nodes(t: Logical) -> DataFrame:
    return strong(t).select(F.explode(F.array("file_a", "file_b")).alias("node")).distinct()


@query("select * from vw_temporal_cells")
def mx_temporal(t: Logical) -> DataFrame:
    return matrix.temporal(pairs(t), t.changes, SIMILARITY)


@query("select dir, min(idx) as start, max(idx) + 1 as end, count(*) as n from vw_file_index group by dir")
def mx_dir_ranges(t: Logical) -> DataFrame:
    return matrix.ranges(matrix.index(temporal.live(t.changes).select(F.col("file_path").alias("path"))))


@query("select path, dir, idx from vw_file_index")
def mx_index(t: Logical) -> DataFrame:
    return matrix.index(temporal.live(t.changes).select(F.col("file_path").alias("path")))


@query("select f.files, f.directories, c.cells, c.cells / f.files as cells_per_file from (select count(*) as files, count(distinct dir) as directories from vw_file_index) f, (select count(*) as cells from vw_temporal_cells) c")
def agg_matrix_stats(t: Logical) -> DataFrame:
    return matrix.stats(matrix.temporal(pairs(t), t.changes, SIMILARITY), matrix.index(temporal.live(t.changes).select(F.col("file_path").alias("path"))))


@query("select * from vw_strong where file_a in (select path from vw_file_index) and file_b in (select path from vw_file_index)")
def semi_in_index(t: Logical) -> DataFrame:
    known = matrix.index(temporal.live(t.changes).select(F.col("file_path").alias("path")))
    return strong(t).join(known.select(F.col("path").alias("file_a")), "file_a", "left_semi").join(known.select(F.col("path").alias("file_b")), "file_b", "left_semi")


@query("select * from vw_repos")
def agg_repo_totals(t: Logical) -> DataFrame:
    return by_repo(t)


@query("select count(*) as repos, sum(commits)::bigint as commits, sum(files)::bigint as files from vw_repos")
def agg_repo_overview(t: Logical) -> DataFrame:
    return repos.overview(by_repo(t), "commits", "files")


@query("select arg_max(repo, (commits, repo)) as repo, max(commits) as commits from vw_repos")
def agg_argmax_repo(t: Logical) -> DataFrame:
    return repos.most(by_repo(t), "commits", F.col("repo"))


@query("select split_part(file_path, '/', 1) as repo, file_path, total_churn from vw_churn where split_part(file_path, '/', 1) in ('Brand#11', 'Brand#12', 'Brand#none')")
def q_compare(t: Logical) -> DataFrame:
    tagged = churned(t).select(directory(F.col("file_path")).alias("repo"), "file_path", "total_churn")
    return repos.of_repos(tagged, ["Brand#11", "Brand#12", "Brand#none"])


@query("select 'one' as repo, file_path, total_churn from vw_churn union all select 'two', file_path, churn_score from vw_all_churn")
def set_concat_repos(t: Logical) -> DataFrame:
    one = churned(t).select("file_path", "total_churn")
    two = temporal.file_churn_all(t.changes).select("file_path", F.col("churn_score").alias("total_churn"))
    return repos.concatenated([repos.tagged(one, "one"), repos.tagged(two, "two")])


@query("select distinct split_part(f, '/', 1) as repo from lg_changes")
def src_list_repos(t: Logical) -> DataFrame:
    return t.changes.select(directory(F.col("file_path")).alias("repo")).distinct().orderBy("repo")
