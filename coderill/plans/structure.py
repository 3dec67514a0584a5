"""Queries about modules, functions, classes and their relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.adapters import Logical
from coderill.operators import graph, matrix, structural
from coderill.operators import resolve as rs
from coderill.plans.registry import SHARED, query

SHARED |= {
    "vw_met": "select distinct i.id, i.src, i.dst, m.id as module_id from lg_imports i join lg_modules m on i.dst = m.name or i.dst = m.path",
    "vw_ca": "select m.id as module_id, m.path, count(distinct v.src) as ca from lg_modules m left join vw_met v on v.module_id = m.id group by 1, 2",
    "vw_ce": "select m.id as module_id, m.path, count(distinct i.dst) as ce from lg_modules m left join lg_imports i on i.src = m.id group by 1, 2",
    "vw_inst": "select module_id, a.path, ca, ce, case when ca + ce = 0 then 0.0::double else ce / (ca + ce) end as instability from vw_ca a join vw_ce e using (module_id)",
    "vw_risk": "select *, 1.0::double - instability as stability, case when instability > 0.8 and ca > 5 then 'high_risk' when instability < 0.2 and ce > 5 then 'rigid' else 'normal' end as classification from vw_inst",
    "vw_mc": "select m.id as module_id, m.path, m.language_id, count(f.id) as function_count, sum(f.cc)::bigint as total_complexity, avg(f.cc) as avg_complexity, max(f.cc) as max_complexity from lg_modules m left join lg_functions f on f.module_id = m.id group by 1, 2, 3",
    "vw_lang": "select l.name as language, count(*) as file_count, sum(function_count)::bigint as function_count, sum(coalesce(total_complexity, 0))::bigint as total_complexity, avg(coalesce(total_complexity, 0)) as avg_complexity from lg_languages l join vw_mc on language_id = l.id group by 1",
    "vw_typed": "select m.path, count(*) as total_functions, count(case when f.id in (select function_id from lg_hints) then 1 end) as typed_functions from lg_functions f join lg_modules m on m.id = f.module_id group by 1",
    "vw_edges_call": "select c.id, s.name as caller, sm.path as caller_path, d.name as callee, dm.path as callee_path, call_kind from lg_calls c join lg_call_functions s on s.id = c.src join lg_call_functions d on d.id = c.dst join lg_modules sm on sm.id = s.module_id join lg_modules dm on dm.id = d.module_id",
    "vw_first": "select i.id, i.src as from_module_id, min(m.id) as module_id from lg_imports i join lg_modules m on i.dst = m.path or i.dst = m.name group by 1, 2",
    "vw_graph": "select distinct a.path as src, b.path as dst from vw_first v join lg_modules a on a.id = from_module_id join lg_modules b on b.id = v.module_id where a.path <> b.path",
    "vw_reach_rec": "select src, dst from vw_graph union select r.src, g.dst from vw_reach_rec r join vw_graph g on g.src = r.dst",
    "vw_scc": "select a.src as node, min(a.dst) as component from vw_reach_rec a join vw_reach_rec b on a.src = b.dst and a.dst = b.src group by 1 having count(*) > 1",
    "vw_tier": "select c.*, coalesce((select min(id) from lg_modules where path = dst), (select arg_max(id, path) from lg_modules where name = dst), (select arg_min(id, path) from lg_modules where ends_with(path, dst) or ends_with(path, dst || '.py'))) as module_id"
    " from (select src as from_module_id, dst, count(*) as n from lg_imports group by 1, 2) c",
    "vw_mod_index": "select id, path, row_number() over (order by split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path) - 1 as idx from (select distinct id, path from lg_modules)",
    "vw_struct_cells": "select a.idx as row, b.idx as col, sum(n)::bigint as value from vw_tier t join vw_mod_index a on a.id = from_module_id join vw_mod_index b on b.id = module_id where a.id <> b.id group by 1, 2",
}


def measured(t: Logical) -> DataFrame:
    return structural.instability(t.modules, t.imports)


def scc(t: Logical) -> DataFrame:
    return graph.components(graph.edges(t.imports, t.modules, t.import_rows))


@query("select * from vw_ca")
def agg_afferent(t: Logical) -> DataFrame:
    return structural.afferent(t.modules, t.imports)


@query("select * from vw_ce")
def agg_efferent(t: Logical) -> DataFrame:
    return structural.efferent(t.modules, t.imports)


@query("select * from vw_risk")
def agg_instability(t: Logical) -> DataFrame:
    return measured(t)


@query("select path, instability from vw_inst order by instability desc, path")
def srt_instability(t: Logical) -> DataFrame:
    return measured(t).select("path", "instability").orderBy(F.desc("instability"), "path")


@query("select path, classification from vw_risk")
def prj_classification(t: Logical) -> DataFrame:
    return measured(t).select("path", "classification")


@query("select path, stability from vw_risk")
def prj_stability(t: Logical) -> DataFrame:
    return measured(t).select("path", "stability")


@query("select avg(ca) as avg_ca, max(ca) as max_ca, avg(ce) as avg_ce, max(ce) as max_ce, sum(instability::decimal(24,12))::double / count(*) as avg_instability, count(case when classification = 'high_risk' then 1 end) as high_risk, count(case when classification = 'rigid' then 1 end) as rigid from vw_risk")
def agg_instability_stats(t: Logical) -> DataFrame:
    return structural.instability_stats(measured(t))


@query("select count(case when classification = 'high_risk' then 1 end) as high_risk, count(case when classification = 'rigid' then 1 end) as rigid from vw_risk")
def agg_risk_counts(t: Logical) -> DataFrame:
    return structural.instability_stats(measured(t)).select("high_risk", "rigid")


@query("select * from vw_mc")
def agg_module_complexity(t: Logical) -> DataFrame:
    return structural.module_complexity(t.modules, t.functions)


@query("select path, total_complexity from vw_mc order by 2 desc, 1")
def srt_complexity(t: Logical) -> DataFrame:
    return structural.module_complexity(t.modules, t.functions).select("path", "total_complexity").orderBy(F.desc("total_complexity"), "path")


@query("select m.id as module_id, l.name as language from lg_modules m left join lg_languages l on l.id = m.language_id")
def jn_module_lang_left(t: Logical) -> DataFrame:
    return t.modules.join(t.languages.select(F.col("id").alias("language_id"), F.col("name").alias("language")), "language_id", "left").select(F.col("id").alias("module_id"), "language")


@query("select m.id as module_id, i.dst as to_module from lg_modules m left join lg_imports i on i.src = m.id")
def jn_module_imports_left(t: Logical) -> DataFrame:
    return t.modules.select(F.col("id").alias("module_id")).join(t.imports.select(F.col("from_module_id").alias("module_id"), "to_module"), "module_id", "left")


@query("select language, file_count, function_count, avg_complexity from vw_lang")
def agg_language_stats(t: Logical) -> DataFrame:
    return structural.language_stats(t.languages, t.modules, t.functions).drop("total_complexity")


@query("select language, file_count, total_complexity from vw_lang order by file_count desc, language")
def agg_language_dist(t: Logical) -> DataFrame:
    return structural.language_stats(t.languages, t.modules, t.functions).select("language", "file_count", "total_complexity").orderBy(F.desc("file_count"), "language")


@query("select count(*) as total_functions, avg(cc) as avg_complexity, max(cc) as max_complexity, count(case when cc > 5 then 1 end) as high_complexity, count(case when cc > 5 then 1 end) * 100.0::double / count(*) as high_share from lg_functions where cc > 0")
def agg_complexity_stats(t: Logical) -> DataFrame:
    return structural.complexity_stats(t.functions, 5)


@query("select id, cc as cyclomatic_complexity from lg_functions where cc > 0")
def flt_positive_complexity(t: Logical) -> DataFrame:
    return t.functions.where("cyclomatic_complexity > 0").select("id", "cyclomatic_complexity")


@query("select b.bin, count(f.id) as n from (values ('1-5', 1, 5), ('6-10', 6, 10), ('11-15', 11, 15), ('16-20', 16, 20), ('21+', 21, 1000000)) b(bin, lo, hi) left join lg_functions f on f.cc between lo and hi group by 1")
def agg_histogram(t: Logical) -> DataFrame:
    return structural.histogram(t.functions)


_BAND = "case when 100.0 * typed_functions / total_functions > 80 then 'good' when 100.0 * typed_functions / total_functions > 50 then 'fair' else 'poor' end"


@query(f"select *, total_functions - typed_functions as untyped_functions, typed_functions * 100.0::double / total_functions as coverage, {_BAND} as band from vw_typed")
def agg_type_coverage(t: Logical) -> DataFrame:
    return structural.type_coverage(t.modules, t.functions, t.type_hints)


@query("select sum(total_functions)::bigint as total_functions, sum(typed_functions)::bigint as typed_functions, sum(typed_functions) * 100.0::double / sum(total_functions) as coverage from vw_typed")
def agg_type_coverage_overall(t: Logical) -> DataFrame:
    return structural.overall_coverage(structural.type_coverage(t.modules, t.functions, t.type_hints))


@query("select f.id as function_id, h.id as hint_id from lg_functions f left join lg_hints h on h.function_id = f.id")
def jn_typehint_left(t: Logical) -> DataFrame:
    hints = t.type_hints.select("function_id", F.col("id").alias("hint_id"))
    return t.functions.select(F.col("id").alias("function_id")).join(hints, "function_id", "left")


@query("select parameter_name, count(*) as n from lg_generics group by 1")
def agg_generics(t: Logical) -> DataFrame:
    return structural.generics(t.generic_parameters)


@query("select decorator_name, m.path, count(*) as n from lg_decorators d join lg_functions f on f.id = d.target_id join lg_modules m on m.id = f.module_id group by 1, 2")
def agg_decorators(t: Logical) -> DataFrame:
    return structural.decorators(t.decorators, t.functions, t.modules)


@query("select decorator_name, count(*) as n from lg_decorators d join lg_functions f on f.id = d.target_id group by 1")
def agg_decorators_by_name(t: Logical) -> DataFrame:
    return structural.decorators(t.decorators, t.functions, t.modules).groupBy("decorator_name").agg(F.sum("n").alias("n"))


@query("select f.id as function_id, f.name, count(*) as n from lg_decorators d join lg_functions f on f.id = d.target_id group by 1, 2 order by n desc, function_id limit 20")
def top20_decorated(t: Logical) -> DataFrame:
    return structural.decorated(t.decorators, t.functions).orderBy(F.desc("n"), "function_id").limit(20)


@query("select c.id as class_id, c.name as child, cm.path as child_path, i.base_id as base_class_id, b.name as base, bm.path as base_path, i.kind as relationship_kind from lg_inheritance i join lg_classes c on c.id = i.class_id join lg_modules cm on cm.id = c.module_id left join lg_classes b on b.id = i.base_id left join lg_modules bm on bm.id = b.module_id")
def jn_inheritance_self(t: Logical) -> DataFrame:
    return structural.inherits(t.inheritance, t.classes, t.modules)


@query("select class_id, count(*) as parent_count from lg_inheritance group by 1")
def agg_inheritance_parents(t: Logical) -> DataFrame:
    return structural.parents(t.inheritance)


@query("select base_id as base_class_id, count(*) as child_count from lg_inheritance where base_id is not null group by 1 order by 2 desc, 1 limit 20")
def top20_extended(t: Logical) -> DataFrame:
    return structural.children(t.inheritance).orderBy(F.desc("child_count"), "base_class_id").limit(20)


@query("select count(*) as relations, count(distinct class_id) as children, count(distinct base_id) as bases, (select count(*) from (select class_id from lg_inheritance group by 1 having count(*) > 1)) as multiple from lg_inheritance")
def agg_inheritance(t: Logical) -> DataFrame:
    return structural.inheritance_stats(t.inheritance)


@query("select count(*) as multiple from (select class_id from lg_multi_inheritance group by 1 having count(*) > 1)")
def agg_multi_inherit(t: Logical) -> DataFrame:
    many = structural.parents(t.multi_inheritance)
    return many.where("parent_count > 1").agg(F.count(F.lit(1)).alias("multiple"))


@query("select kind, count(*) as n from lg_classes group by 1")
def agg_class_kinds(t: Logical) -> DataFrame:
    return structural.class_kinds(t.classes)


@query("select c.id as class_id, c.name, count(*) as methods, sum(cc)::bigint as complexity from lg_classes c join lg_functions f on f.class_id = c.id group by 1, 2")
def agg_class_complexity(t: Logical) -> DataFrame:
    return structural.class_complexity(t.classes, t.functions)


@query("select * from vw_edges_call")
def jn_calls_self(t: Logical) -> DataFrame:
    return structural.call_edges(t.calls, t.call_functions, t.modules)


@query("select c.id, d.name as callee from lg_calls c join lg_call_functions d on d.id = c.dst")
def flt_resolved(t: Logical) -> DataFrame:
    return t.calls.select("id", F.col("to_function_id").alias("k")).join(t.call_functions.select(F.col("id").alias("k"), F.col("name").alias("callee")), "k").select("id", "callee")


@query("select id as function_id, name, module_id from lg_call_functions where id not in (select dst from lg_calls where dst is not null)")
def anti_entry_points(t: Logical) -> DataFrame:
    return structural.entry_points(t.call_functions, t.calls)


@query("select f.id as function_id, f.name, count(*) as n from lg_calls c join lg_call_functions f on f.id = c.src group by 1, 2")
def agg_call_out(t: Logical) -> DataFrame:
    return structural.calls_out(t.calls, t.call_functions)


@query("select f.id as function_id, f.name, count(*) as n from lg_calls c join lg_call_functions f on f.id = c.dst group by 1, 2")
def agg_call_in(t: Logical) -> DataFrame:
    return structural.calls_in(t.calls, t.call_functions)


@query("select f.id as function_id, f.name, count(*) as n from lg_calls c join lg_call_functions f on f.id = c.dst group by 1, 2 order by 3 desc, 1 limit 20")
def top20_called(t: Logical) -> DataFrame:
    return structural.calls_in(t.calls, t.call_functions).orderBy(F.desc("n"), "function_id").limit(20)


@query("select count(*) as calls, count(distinct caller) as callers, count(distinct callee) as callees from vw_edges_call")
def agg_call_stats(t: Logical) -> DataFrame:
    return structural.call_stats(structural.call_edges(t.calls, t.call_functions, t.modules))


@query("select c.id, c.src as from_function_id, coalesce((select min(f.id) from lg_call_functions f, lg_call_functions h where h.id = c.src and f.module_id = h.module_id and 'pkg.' || f.name = c.to_name), (select min(f.id) from lg_call_functions f where 'pkg.' || f.name = c.to_name)) as to_function_id from lg_calls c")
def resolve_names(t: Logical) -> DataFrame:
    return rs.resolve_names(t.calls, t.call_functions)


@query("select src as from_module_id, string_agg(dst, ',' order by dst) as targets from lg_imports group by 1")
def agg_group_concat(t: Logical) -> DataFrame:
    return structural.imported_list(t.imports)


@query("select src as from_module_id, dst as to_module, count(*) as n from lg_imports group by 1, 2")
def agg_import_counts(t: Logical) -> DataFrame:
    return structural.import_counts(t.imports)


@query("select id, src as from_module_id, dst as to_module, module_id from vw_met")
def jn_import_module_or(t: Logical) -> DataFrame:
    return rs.resolve_any(t.imports, t.modules, t.import_rows)


@query("select * from vw_first")
def resolve_first(t: Logical) -> DataFrame:
    return rs.resolve_first(t.imports, t.modules, t.import_rows)


@query("select from_module_id, dst as to_module, n, module_id from vw_tier where module_id is not null")
def resolve_tiered(t: Logical) -> DataFrame:
    return rs.resolve_tiered(t.imports, t.modules)


@query("select * from vw_graph")
def gr_edges(t: Logical) -> DataFrame:
    return graph.edges(t.imports, t.modules, t.import_rows)


@query("select * from vw_scc")
def gr_scc(t: Logical) -> DataFrame:
    return scc(t)


@query("select row_number() over (order by component) as cycle_id, count(*) as cycle_length, string_agg(node, ' -> ' order by node) || ' -> ' || min(node) as cycle from vw_scc group by component")
def gr_cycle_table(t: Logical) -> DataFrame:
    return graph.cycle_table(scc(t))


@query("select * from vw_struct_cells")
def mx_structural(t: Logical) -> DataFrame:
    return matrix.structural(t.imports, t.modules, 2)


@query("select distinct a.path as x, b.path as y from vw_met v join lg_modules a on a.id = v.src join lg_modules b on b.id = v.module_id union all select distinct b.path, a.path from vw_met v join lg_modules a on a.id = v.src join lg_modules b on b.id = v.module_id")
def set_imports_sym(t: Logical) -> DataFrame:
    return graph.imported(t.imports, t.modules)
