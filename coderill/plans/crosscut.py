"""Queries that combine structure, history, interfaces and declared dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.adapters import Logical
from coderill.operators import crosslang, ecosystem, quality, temporal
from coderill.plans.coupling import COUNT, SIMILARITY
from coderill.plans.history import churned
from coderill.plans.registry import SHARED, query
from coderill.plans.structure import measured, scc

SHARED |= {
    # files of the structure, in the history: brands stand for modules
    "vw_mod_of": "select id, path, name from lg_modules",
    "vw_mod_changes": "select c.commit_id, m.path as f, c.plus, c.minus, c.ct, k.ts, k.author_email as email from lg_changes c join lg_commits k on k.id = c.commit_id join lg_modules m on m.id = c.id % 25 where c.ct <> 'D'",
    "vw_mod_churn": "select f as path, count(distinct commit_id) as change_count from vw_mod_changes group by 1",
    "vw_mod_touched": "select distinct commit_id, f from vw_mod_changes",
    "vw_mod_pairs": "select a as file_a, b as file_b, co as co_change_count, co / (na.n + nb.n - co) as jaccard_similarity from (select x.f as a, y.f as b, count(*) as co from vw_mod_touched x join vw_mod_touched y on x.commit_id = y.commit_id and x.f < y.f group by 1, 2)"
    " join (select f, count(*) as n from vw_mod_touched group by 1) na on na.f = a join (select f, count(*) as n from vw_mod_touched group by 1) nb on nb.f = b",
    "vw_hot": "select i.path, m.total_complexity, c.change_count, i.ca, i.ce, i.instability, m.total_complexity * c.change_count * (i.ca + i.ce + 1) as hotspot_score from vw_inst i join vw_mc m using (module_id) join vw_mod_churn c on c.path = i.path where m.total_complexity >= 5 and c.change_count >= 3",
    "vw_hidden": f"select p.* from vw_mod_pairs p where co_change_count >= {COUNT} and jaccard_similarity >= {SIMILARITY} and not exists (select 1 from vw_met v join lg_modules a on a.id = v.src join lg_modules b on b.id = v.module_id where (a.path = file_a and b.path = file_b) or (a.path = file_b and b.path = file_a))",
    "vw_quality": "select greatest(0.0::double, 100.0::double - 5.0::double * (select avg(cc) from lg_functions where cc > 0)) as complexity_score, (select count(*) from lg_functions where id in (select function_id from lg_hints)) * 100.0::double / (select count(*) from lg_functions) as type_score,"
    " (select count(*) from lg_functions where cc > 15) as high_complexity_count",
    "vw_scored": "select *, 0.3::double * complexity_score + 0.3::double * type_score + 0.4::double * stability_score as overall from (select q.*, (select count(*) from vw_risk where classification = 'high_risk') as high_risk_modules,"
    " greatest(0.0::double, 100.0::double - 100.0::double * (select sum(instability::decimal(24,12))::double / count(*) from vw_inst)) as stability_score from vw_quality q)",
    "vw_ends": "select distinct method, path, endpoint_type from lg_endpoints",
    "vw_matched": "select c.id, c.url as url_pattern, c.method, c.call_type, e.path, e.endpoint_type from lg_api_calls c join vw_ends e on e.method = c.method and contains(c.url, e.path)",
    "vw_conflicts": "select a.package as package_name, a.id as id1, b.id as id2, a.version as version1, b.version as version2, a.manifest as manifest1, b.manifest as manifest2,"
    " case when regexp_extract(a.version, '[0-9]+') <> '' and regexp_extract(b.version, '[0-9]+') <> '' and regexp_extract(a.version, '[0-9]+') <> regexp_extract(b.version, '[0-9]+') then 'major_version_diff' else 'version_mismatch' end as conflict_type"
    " from lg_deps a join lg_deps b on a.package = b.package and a.id < b.id and a.version <> b.version where a.version <> '' and b.version <> ''",
    "vw_declared": "select m.ecosystem, m.name as manager, d.package as package_name, d.version as version_spec, d.manifest as manifest_file, d.dev as is_dev from lg_deps d join lg_managers m on m.id = d.manager_id",
}


def module_changes(t: Logical) -> DataFrame:
    """Changes of the files that the structure knows of."""
    at = t.modules.select((F.col("id")).alias("k"), "path")
    return t.changes.drop("file_path").withColumn("k", F.col("id") % 25).join(at, "k").withColumnRenamed("path", "file_path").drop("k")


def hotspots(t: Logical) -> DataFrame:
    return quality.hotspots(t.modules, t.functions, measured(t), temporal.churn(module_changes(t), t.commits))


def hidden(t: Logical) -> DataFrame:
    return quality.hidden_dependencies(temporal.jaccard(module_changes(t)), t.imports, t.modules, SIMILARITY, COUNT)


def scored(t: Logical) -> DataFrame:
    return quality.quality(t.functions, t.type_hints, measured(t))


def matched(t: Logical) -> DataFrame:
    return crosslang.matches(t.api_calls, t.api_endpoints)


@query("select * from vw_hot")
def q_hotspots(t: Logical) -> DataFrame:
    return hotspots(t)


@query("select path, hotspot_score from vw_hot order by 2 desc, 1")
def srt_hotspots(t: Logical) -> DataFrame:
    return hotspots(t).select("path", "hotspot_score").orderBy(F.desc("hotspot_score"), "path")


@query("select path, total_complexity, change_count, hotspot_score from vw_hot")
def prj_hotspot_score(t: Logical) -> DataFrame:
    return hotspots(t).select("path", "total_complexity", "change_count", "hotspot_score")


@query("select i.path, m.total_complexity, i.instability from vw_inst i join vw_mc m using (module_id) where m.function_count > 0")
def jn_complexity_instability(t: Logical) -> DataFrame:
    by = t.functions.groupBy("module_id").agg(F.sum("cyclomatic_complexity").alias("total_complexity"))
    return measured(t).join(by, "module_id").select("path", "total_complexity", "instability")


@query("select m.path, m.id as module_id, c.change_count from lg_modules m join vw_mod_churn c on c.path = m.path")
def jn_structure_history(t: Logical) -> DataFrame:
    changed = temporal.churn(module_changes(t), t.commits).select(F.col("file_path").alias("path"), F.col("total_commits").alias("change_count"))
    return t.modules.select("path", F.col("id").alias("module_id")).join(changed, "path")


@query("select * from vw_hidden")
def q_hidden_deps(t: Logical) -> DataFrame:
    return hidden(t)


@query("select file_a, file_b from vw_hidden")
def anti_hidden(t: Logical) -> DataFrame:
    return hidden(t).select("file_a", "file_b")


@query("select file_a, file_b, jaccard_similarity from vw_hidden order by 3 desc, 1, 2")
def srt_hidden(t: Logical) -> DataFrame:
    return hidden(t).select("file_a", "file_b", "jaccard_similarity").orderBy(F.desc("jaccard_similarity"), "file_a", "file_b")


_BANDS = "case when overall >= 80 then 'excellent' when overall >= 60 then 'good' when overall >= 40 then 'fair' else 'poor' end"


@query(f"select *, {_BANDS} as band from vw_scored")
def agg_quality(t: Logical) -> DataFrame:
    return scored(t)


@query(f"select *, {_BANDS} as band from (select *, 0.5::double * complexity_score + 0.5::double * type_score as overall from vw_quality)")
def agg_quality_all(t: Logical) -> DataFrame:
    return quality.quality(t.functions, t.type_hints)


@query(f"select overall, {_BANDS} as band from vw_scored")
def prj_score_band(t: Logical) -> DataFrame:
    return scored(t).select("overall", "band")


@query("select 'complexity' as topic, 'high' as priority from vw_scored where high_complexity_count > 10 union all select 'types', 'high' from vw_scored where type_score < 90 union all select 'stability', 'medium' from vw_scored where high_risk_modules > 0 union all select 'overall', 'high' from vw_scored where overall < 90")
def prj_recommendations(t: Logical) -> DataFrame:
    # the driver tables score well: stricter limits than the defaults
    return quality.recommendations(scored(t), least_typed=90, least_overall=90)


@query("select kind, n, case when n > 0 then advice end as advice from (select 'hotspots' as kind, (select count(*) from vw_hot) as n, 'split or test the busiest modules' as advice union all select 'cycles', (select count(distinct component) from vw_scc), 'break import cycles' union all select 'hidden', (select count(*) from vw_hidden), 'make the dependency explicit')")
def prj_arch_counts(t: Logical) -> DataFrame:
    return quality.architecture(hotspots(t), scc(t).select("component").distinct(), hidden(t))


@query("select * from vw_matched")
def jn_api_contains(t: Logical) -> DataFrame:
    return matched(t)


@query("select c.id, c.url as url_pattern, c.method, c.call_type, e.path, e.endpoint_type from lg_api_calls c left join vw_ends e on e.method = c.method and c.url ilike '%' || e.path || '%'")
def q_api_coupling(t: Logical) -> DataFrame:
    return crosslang.coupling(t.api_calls, t.api_endpoints)


@query("select id, url as url_pattern, method, call_type from lg_api_calls where url not in (select url_pattern from vw_matched)")
def anti_unmatched_calls(t: Logical) -> DataFrame:
    return crosslang.unmatched_calls(t.api_calls, matched(t))


@query("select * from lg_endpoints where path not in (select path from vw_matched)")
def anti_unmatched_endpoints(t: Logical) -> DataFrame:
    return crosslang.unmatched_endpoints(t.api_endpoints, matched(t))


@query("select (select count(*) from lg_endpoints) as endpoints, (select count(*) from lg_api_calls) as calls, (select count(*) from vw_matched) as matched, (select count(*) from lg_api_calls where url not in (select url_pattern from vw_matched)) as unmatched_calls, (select count(*) from lg_endpoints where path not in (select path from vw_matched)) as unmatched_endpoints")
def agg_api_summary(t: Logical) -> DataFrame:
    return crosslang.summary(t.api_calls, t.api_endpoints, matched(t))


@query("select coalesce(method, 'UNKNOWN') as method, count(*) as n from lg_endpoints group by 1")
def agg_methods(t: Logical) -> DataFrame:
    return crosslang.by_method(t.api_endpoints)


@query("select e.path, m.path as module_path, l.name as language from lg_endpoints e join lg_modules m on m.id = e.module_id join lg_languages l on l.id = m.language_id")
def jn_endpoint_modules(t: Logical) -> DataFrame:
    of = t.modules.join(t.languages.select(F.col("id").alias("language_id"), F.col("name").alias("language")), "language_id")
    return t.api_endpoints.select("module_id", "path").join(of.select(F.col("id").alias("module_id"), F.col("path").alias("module_path"), "language"), "module_id").drop("module_id")


@query("select c.id, c.url as url_pattern from lg_api_calls c join lg_modules m on m.id = c.module_id join lg_languages l on l.id = m.language_id where l.name in ('ASIA', 'EUROPE')")
def flt_lang_in(t: Logical) -> DataFrame:
    return crosslang.in_languages(t.api_calls, t.modules, t.languages, ["ASIA", "EUROPE"]).select("id", "url_pattern")


@query("select a.name as from_language, b.name as to_language, count(*) as n from vw_met v join lg_modules x on x.id = v.src join lg_languages a on a.id = x.language_id join lg_modules y on y.id = v.module_id join lg_languages b on b.id = y.language_id where a.name <> b.name group by 1, 2")
def agg_cross_lang_imports(t: Logical) -> DataFrame:
    return crosslang.cross_imports(t.imports, t.modules, t.languages)


@query("select l.name as language, endpoint_type, count(*) as n from lg_endpoints e join lg_modules m on m.id = e.module_id join lg_languages l on l.id = m.language_id group by 1, 2")
def agg_api_endpoints_by(t: Logical) -> DataFrame:
    return crosslang.by_language(t.api_endpoints, "endpoint_type", t.modules, t.languages)


@query("select l.name as language, call_type, count(*) as n from lg_api_calls e join lg_modules m on m.id = e.module_id join lg_languages l on l.id = m.language_id group by 1, 2")
def agg_api_calls_by(t: Logical) -> DataFrame:
    return crosslang.by_language(t.api_calls, "call_type", t.modules, t.languages)


@query("select type_system, count(*) as n from lg_shared group by 1")
def agg_shared_types_by(t: Logical) -> DataFrame:
    return crosslang.by_type_system(t.shared_types)


@query("select * from vw_conflicts")
def q_version_conflicts(t: Logical) -> DataFrame:
    return ecosystem.conflicts(t.dependencies)


@query("select conflict_type, count(*) as n from vw_conflicts group by 1")
def prj_conflict_type(t: Logical) -> DataFrame:
    return ecosystem.conflict_counts(t.dependencies)


@query("select * from vw_conflicts order by conflict_type desc, package_name, id1, id2")
def srt_conflicts(t: Logical) -> DataFrame:
    return ecosystem.conflicts(t.dependencies, ordered=True)


@query("select ecosystem, manager, count(distinct package_name) as packages, count(distinct manifest_file) as manifests, count(case when is_dev then 1 end) as dev, count(case when not is_dev then 1 end) as prod from vw_declared group by 1, 2")
def agg_deps_by(t: Logical) -> DataFrame:
    return ecosystem.by_manager(t.dependencies, t.package_managers)


@query("select count(*) as total, count(case when not is_dev then 1 end) as prod, count(case when is_dev then 1 end) as dev, count(distinct ecosystem) as ecosystems from vw_declared")
def agg_deps_overview(t: Logical) -> DataFrame:
    return ecosystem.overview(t.dependencies, t.package_managers)


@query("select ecosystem, count(*) as n from vw_declared group by 1")
def agg_deps_by_ecosystem(t: Logical) -> DataFrame:
    return ecosystem.by_ecosystem(t.dependencies, t.package_managers)


@query("select * from vw_declared order by ecosystem, package_name, manager, manifest_file, version_spec")
def srt_deps(t: Logical) -> DataFrame:
    return ecosystem.declared(t.dependencies, t.package_managers).orderBy("ecosystem", "package_name", "manager", "manifest_file", "version_spec")


@query("select m.name as manager, d.package as package_name from lg_managers m left join lg_deps d on d.manager_id = m.id")
def jn_deps_manager(t: Logical) -> DataFrame:
    deps = t.dependencies.select("package_manager_id", "package_name")
    return t.package_managers.select(F.col("id").alias("package_manager_id"), F.col("name").alias("manager")).join(deps, "package_manager_id", "left").drop("package_manager_id")


@query("select (select sum(file_count)::bigint from vw_lang) as files, (select sum(function_count)::bigint from vw_lang) as functions, (select sum(total_complexity)::bigint from vw_lang) as complexity, (select count(*) from vw_declared) as declared, (select count(case when not is_dev then 1 end) from vw_declared) as prod, (select count(case when is_dev then 1 end) from vw_declared) as dev")
def agg_polyglot_totals(t: Logical) -> DataFrame:
    from coderill.operators import structural

    langs = structural.language_stats(t.languages, t.modules, t.functions).agg(F.sum("file_count").alias("files"), F.sum("function_count").alias("functions"), F.sum("total_complexity").alias("complexity"))
    deps = ecosystem.overview(t.dependencies, t.package_managers).select(F.col("total").alias("declared"), "prod", "dev")
    return langs.crossJoin(deps)


__all__ = ["churned"]
