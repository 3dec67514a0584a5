"""Operators that work inside larger queries, each with a query of its own: what it adds to the larger one."""

from __future__ import annotations

from pyspark.sql import functions as F

from coderill.adapters import Logical
from coderill.operators import structural, temporal
from coderill.plans.registry import query, registered
from coderill.reports import page

OWN: dict[str, tuple[str, tuple[str, ...]]] = {
    "flt_cross_lang": ("agg_cross_lang_imports", ("from_language", "to_language")),
    "prj_quality_scores": ("agg_quality", ("complexity_score", "type_score", "stability_score")),
    "prj_repo_tag": ("set_concat_repos", ("repo", "file_path")),
    "prj_complexity_pct": ("agg_complexity_stats", ("high_share",)),
    "prj_untyped": ("agg_type_coverage", ("path", "untyped_functions")),
    "prj_coverage_band": ("agg_type_coverage", ("path", "coverage", "band")),
    "jn_coupling_churn": ("agg_high_coupling", ("file_a", "file_b", "file_a_commits", "file_b_commits")),
    "jn_ownership_author": ("agg_ownership", ("author_id", "author_name", "file_path")),
    "jn_lang_modules_left": ("agg_language_stats", ("language", "file_count")),
    "jn_ca_ce": ("agg_instability", ("module_id", "ca", "ce")),
    "jn_module_functions_left": ("agg_module_complexity", ("module_id", "function_count")),
    "jn_version_self": ("q_version_conflicts", ("package_name", "id1", "id2")),
    "jn_api_like": ("q_api_coupling", ("id", "url_pattern", "path")),
    "jn_decorator_fn": ("agg_decorators", ("decorator_name", "path")),
    "set_jaccard_sets": ("agg_jaccard", ("file_a", "file_b", "co_change_count", "jaccard_similarity")),
}


def _register(name: str, source: str, columns: tuple[str, ...]) -> None:
    f, sql = registered(source)

    def run(t: Logical):
        return f(t).select(*columns)

    run.__name__ = name
    query(f"select {', '.join(columns)} from ({sql})")(run)


for _name, (_source, _columns) in OWN.items():
    _register(_name, _source, _columns)


@query("select * from (select f as file_path, strftime(ts, '%Y-%m') as month, count(*) as change_count from vw_dated group by 1, 2) order by month desc, file_path limit 30 offset 30")
def page_frequency(t: Logical):
    found = temporal.commit_frequency(t.changes, t.commits).select("file_path", "month", "change_count")
    return page(found, 30, 2, F.desc("month"), "file_path")


@query("select path, instability from vw_inst order by instability desc, path limit 15 offset 0")
def page_instability(t: Logical):
    return page(structural.instability(t.modules, t.imports).select("path", "instability"), 15, 1, F.desc("instability"), "path")


@query("select function_id, name, n from (select f.id as function_id, f.name, count(*) as n from lg_calls c join lg_call_functions f on f.id = c.src group by 1, 2) order by n desc, function_id limit 20 offset 20")
def page_calling(t: Logical):
    return page(structural.calls_out(t.calls, t.call_functions), 20, 2, F.desc("n"), "function_id")


@query("select f.id as function_id, f.name, count(*) as n from lg_calls c join lg_call_functions f on f.id = c.src group by 1, 2 order by n desc, 1 limit 20")
def top20_calling(t: Logical):
    return page(structural.calls_out(t.calls, t.call_functions), 20, 1, F.desc("n"), "function_id")
