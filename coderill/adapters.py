"""The driver's star schema in the logical schema of a repository's history and structure.

Operators take logical tables; here each of those is a projection of driver tables, so that the same operator serves real
repositories and the SQL checks. ``VIEWS`` has the same mapping in DuckDB SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coderill.operators.placing import BROADCAST_BYTES, file_bytes, meet, tasks

#: Stands for the present in time-dependent queries.
AS_OF = "1999-01-01 00:00:00"
N_CALL_FUNCTIONS = 300


def _named(lines: DataFrame, names: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Lines with names from a table; Spark may broadcast that only while its files are small."""
    return lines.join(names, on, how) if file_bytes(names) <= BROADCAST_BYTES else meet(lines, names, on, tasks(lines, names), how)


class Logical:
    """Lazy logical tables over ``sf_dir``."""

    #: Whether each row of imports counts where ids repeat; else rows of one id are one import.
    import_rows = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def commits(self) -> DataFrame:
        who = F.concat(F.lit("cust"), F.col("o_custkey").cast("string"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), who.alias("author_name"), F.concat(who, F.lit("@x")).alias("author_email"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("message")
        )

    @cached_property
    def authors(self) -> DataFrame:
        who = F.concat(F.lit("cust"), F.col("c_custkey").cast("string"))
        return self.table("customer").select(F.col("c_custkey").alias("id"), who.alias("name"), F.concat(who, F.lit("@x")).alias("email"))

    @cached_property
    def changes(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "R", "D").when(F.col("l_returnflag") == "A", "A").otherwise("M")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_type").alias("file_path"))
        return _named(self.table("lineitem"), part, "l_partkey").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("commit_id"), "file_path",
            F.col("l_quantity").cast("bigint").alias("lines_added"), F.col("l_linenumber").cast("bigint").alias("lines_deleted"), kind.alias("change_type"),
        )

    @cached_property
    def languages(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def modules(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("language_id"),
            F.concat(F.lit("src/r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_name"), F.lit(".py")).alias("path"), F.col("n_name").alias("name"),
        )

    @cached_property
    def imports(self) -> DataFrame:
        lines = self.table("lineitem").where("l_quantity >= 50 and l_discount >= 0.10").select("l_orderkey", "l_suppkey", "l_linenumber")
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        customers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("from_module_id"))
        suppliers = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("id"))
        found = lines.join(suppliers, "l_suppkey").join(self.modules, "id").join(orders, "l_orderkey").join(customers, "o_custkey")
        target = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("ext."), F.col("name"))).when(F.col("l_linenumber") % 2 == 0, F.col("path")).otherwise(F.col("name"))
        return found.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "from_module_id", target.alias("to_module"))

    @cached_property
    def functions(self) -> DataFrame:
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
        customers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("module_id"))
        return (
            self.table("orders")
            .join(customers, "o_custkey")
            .join(lines, "o_orderkey", "left")
            .select(
                F.col("o_orderkey").alias("id"), "module_id", F.col("o_custkey").alias("class_id"), F.col("o_orderpriority").alias("name"),
                F.coalesce("n", F.lit(0)).cast("bigint").alias("cyclomatic_complexity"), F.lit(0).cast("bigint").alias("line_start"),
            )
        )

    @cached_property
    def type_hints(self) -> DataFrame:
        return self.table("lineitem").where("l_returnflag = 'A'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("function_id"))

    @cached_property
    def generic_parameters(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_mktsegment").alias("parameter_name"))

    @cached_property
    def decorators(self) -> DataFrame:
        return self.table("lineitem").where("l_linestatus = 'F'").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("function").alias("target_type"), F.col("l_orderkey").alias("target_id"), F.col("l_returnflag").alias("decorator_name")
        )

    @cached_property
    def call_functions(self) -> DataFrame:
        k = F.col("id")
        return self.spark.range(N_CALL_FUNCTIONS).select(k, F.concat(F.lit("fn"), (k % 50).cast("string")).alias("name"), (k % 25).alias("module_id"))

    @cached_property
    def calls(self) -> DataFrame:
        to = F.col("event_id") % 200
        return self.table("events").select(
            F.col("event_id").alias("id"), (F.col("user_id") % N_CALL_FUNCTIONS).alias("from_function_id"), F.when(F.col("event_id") % 7 != 0, to).alias("to_function_id"),
            F.concat(F.lit("pkg.fn"), (to % 50).cast("string")).alias("to_name"), F.col("event_type").alias("call_kind"),
        )

    @cached_property
    def classes(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).alias("module_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))

    @cached_property
    def inheritance(self) -> DataFrame:
        base = F.floor(F.col("p_partkey") / 10)
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_partkey").alias("class_id"), F.when(base > 0, base).alias("base_class_id"), F.concat(F.lit("part"), base.cast("string")).alias("base_class_name"), F.col("p_brand").alias("relationship_kind")
        )

    @cached_property
    def multi_inheritance(self) -> DataFrame:
        """Parts as classes, and every size of which a supplier has shipped one as a base: most have several."""
        lines = self.table("lineitem").select(F.col("l_partkey").alias("class_id"), (F.col("l_suppkey") % 3).alias("base_class_id"))
        return lines.distinct().withColumn("id", F.col("class_id") * 3 + F.col("base_class_id"))

    @cached_property
    def package_managers(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lower("n_name").alias("name"), F.concat(F.lit("eco"), F.col("n_regionkey").cast("string")).alias("ecosystem"))

    @cached_property
    def dependencies(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"), (F.col("p_partkey") % 20).alias("package_manager_id"), F.col("p_brand").alias("manifest_file"), F.col("p_name").alias("package_name"),
            F.when(F.col("p_size") % 9 == 0, "").otherwise(F.concat(F.lit("=="), F.col("p_size").cast("string"), F.lit(".0"))).alias("version_spec"), (F.col("p_size") % 2 == 0).alias("is_dev"),
        )

    @cached_property
    def api_endpoints(self) -> DataFrame:
        found = self.table("pages").select("page_id", F.explode(F.expr(r"""regexp_extract_all(html, 'href="(/[^"/]*)"', 1)""")).alias("path")).distinct()
        k = F.col("page_id")
        return found.select(
            (k % 25).alias("module_id"), F.when(k % 4 == 0, "route").otherwise("handler").alias("endpoint_type"), F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, "GET").otherwise("POST").alias("method"), "path"
        ).distinct()

    @cached_property
    def api_calls(self) -> DataFrame:
        k = F.col("page_id")
        return self.table("pages").select(
            k.alias("id"), (k % 25).alias("module_id"), F.when(k % 3 == 0, "fetch").otherwise("axios").alias("call_type"), F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), F.col("url").alias("url_pattern")
        )

    @cached_property
    def shared_types(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "protobuf").otherwise("graphql").alias("type_system"), F.col("s_name").alias("name"))


class Parts(Logical):
    """Parts as modules and an import for every line of an order, so that graphs grow with the tables.

    Modules lie in blocks of 50. In odd blocks targets go round, which makes one cycle of all; in even ones they go forward.
    """

    import_rows = True

    @cached_property
    def modules(self) -> DataFrame:
        k = F.col("p_partkey")
        name = F.concat(F.lit("m"), k.cast("string"))
        return self.table("part").select(k.alias("id"), (k % 5).cast("bigint").alias("language_id"), F.concat(F.col("p_brand"), F.lit("/"), name, F.lit(".py")).alias("path"), name.alias("name"))

    @cached_property
    def imports(self) -> DataFrame:
        block, place, step = F.floor(F.col("l_partkey") / 50), F.col("l_partkey") % 50, F.col("l_linenumber")
        target = block * 50 + F.when(block % 2 == 1, (place + step) % 50).otherwise(F.least(place + step, F.lit(49)))
        lines = self.table("lineitem").select((F.col("l_orderkey") * 10 + step).alias("id"), F.col("l_partkey").alias("from_module_id"), target.cast("bigint").alias("t"), step.alias("step"))
        name = F.concat(F.lit("m"), F.col("t").cast("string"))
        text = F.when(F.col("step") == 7, F.concat(F.lit("ext."), name)).when(F.col("step") % 2 == 0, F.coalesce("path", name)).otherwise(name)
        found = _named(lines, self.modules.select(F.col("id").alias("t"), "path"), "t", "left")
        return found.select("id", "from_module_id", text.alias("to_module"))


#: What Parts has instead, and joins by equality where the tables are large. Ids of imports repeat where lines do.
PART_VIEWS: dict[str, str] = {
    "lg_modules": "select p_partkey as id, (p_partkey % 5)::bigint as language_id, p_brand || '/m' || p_partkey || '.py' as path, 'm' || p_partkey as name from part",
    "lg_targets": "select l_orderkey * 10 + l_linenumber as id, l_partkey as src, l_linenumber as step, l_partkey // 50 * 50 + case when l_partkey // 50 % 2 = 1 then (l_partkey % 50 + l_linenumber) % 50 else least(l_partkey % 50 + l_linenumber, 49) end as t from lineitem",
    "lg_imports": "select k.id, src, case when step = 7 then 'ext.m' || t when step % 2 = 0 then coalesce(m.path, 'm' || t) else 'm' || t end as dst from lg_targets k left join lg_modules m on m.id = t",
    "vw_met": "select i.id, i.src, i.dst, m.id as module_id from lg_imports i join lg_modules m on i.dst = m.name union all select i.id, i.src, i.dst, m.id from lg_imports i join lg_modules m on i.dst = m.path",
    "lg_keys": "select key, min(id) as module_id from (select id, name as key from lg_modules union all select id, path from lg_modules) group by 1",
    "vw_first": "select i.id, i.src as from_module_id, k.module_id from lg_imports i join lg_keys k on k.key = i.dst",
}


#: The same tables in DuckDB SQL.
VIEWS: dict[str, str] = {
    "lg_commits": "select o_orderkey as id, 'cust' || o_custkey as author_name, 'cust' || o_custkey || '@x' as author_email, o_orderdate as ts from orders",
    "lg_authors": "select c_custkey as id, 'cust' || c_custkey as name, 'cust' || c_custkey || '@x' as email from customer",
    "lg_changes": "select l_orderkey * 10 + l_linenumber as id, l_orderkey as commit_id, p_brand || '/' || p_type as f, l_quantity::bigint as plus, l_linenumber::bigint as minus,"
    " case l_returnflag when 'R' then 'D' when 'A' then 'A' else 'M' end as ct from lineitem join part on p_partkey = l_partkey",
    "lg_live": "select * from lg_changes where ct <> 'D'",
    "lg_languages": "select r_regionkey::bigint as id, r_name as name from region",
    "lg_modules": "select n_nationkey::bigint as id, n_regionkey::bigint as language_id, 'src/r' || n_regionkey || '/' || n_name || '.py' as path, n_name as name from nation",
    "lg_imports": "select l_orderkey * 10 + l_linenumber as id, c_nationkey::bigint as src, case when l_linenumber = 7 then 'ext.' || m.name when l_linenumber % 2 = 0 then m.path else m.name end as dst"
    " from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey join lg_modules m on m.id = s_nationkey where l_quantity >= 50 and l_discount >= 0.10",
    "lg_functions": "select o_orderkey as id, c_nationkey::bigint as module_id, o_custkey as class_id, o_orderpriority as name, (select count(*) from lineitem where l_orderkey = o_orderkey)::bigint as cc"
    " from orders join customer on c_custkey = o_custkey",
    "lg_hints": "select l_orderkey * 10 + l_linenumber as id, l_orderkey as function_id from lineitem where l_returnflag = 'A'",
    "lg_generics": "select c_custkey as owner_id, c_mktsegment as parameter_name from customer",
    "lg_decorators": "select l_orderkey * 10 + l_linenumber as id, l_orderkey as target_id, l_returnflag as decorator_name from lineitem where l_linestatus = 'F'",
    "lg_call_functions": f"select range as id, 'fn' || (range % 50) as name, range % 25 as module_id from range({N_CALL_FUNCTIONS})",
    "lg_calls": f"select event_id as id, user_id % {N_CALL_FUNCTIONS} as src, case when event_id % 7 <> 0 then event_id % 200 end as dst, 'pkg.fn' || (event_id % 200 % 50) as to_name, event_type as call_kind from events",
    "lg_classes": "select p_partkey as id, p_partkey % 25 as module_id, p_name as name, p_type as kind from part",
    "lg_inheritance": "select p_partkey as class_id, case when p_partkey // 10 > 0 then p_partkey // 10 end as base_id, p_brand as kind from part",
    "lg_multi_inheritance": "select distinct l_partkey as class_id, l_suppkey % 3 as base_id from lineitem",
    "lg_managers": "select n_nationkey::bigint as id, lower(n_name) as name, 'eco' || n_regionkey as ecosystem from nation",
    "lg_deps": "select p_partkey as id, p_partkey % 20 as manager_id, p_brand as manifest, p_name as package, case when p_size % 9 = 0 then '' else '==' || p_size || '.0' end as version, p_size % 2 = 0 as dev from part",
    "lg_endpoints": """select distinct page_id % 25 as module_id, case when page_id % 4 = 0 then 'route' else 'handler' end as endpoint_type,
       case when page_id % 5 = 0 then null when page_id % 2 = 0 then 'GET' else 'POST' end as method, path
     from (select page_id, unnest(regexp_extract_all(html, 'href="(/[^"/]*)"', 1)) as path from pages)""",
    "lg_api_calls": "select page_id as id, page_id % 25 as module_id, case when page_id % 3 = 0 then 'fetch' else 'axios' end as call_type, case when page_id % 2 = 0 then 'GET' else 'POST' end as method, url from pages",
    "lg_shared": "select s_suppkey as id, case when s_suppkey % 3 = 0 then 'protobuf' else 'graphql' end as type_system, s_name as name from supplier",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` behind the views that it and they refer to."""
    known = VIEWS | (extra or {})
    need: dict[str, bool] = {}  # in order of need; a view may refer to itself

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\blg_\w+|\bvw_\w+", text)):
            if name in known and name not in seen:
                seen.add(name)
                visit(known[name])
                need[name] = True

    seen: set[str] = set()
    visit(sql)
    recursive = "recursive " if any(n.endswith("_rec") for n in need) else ""
    return (f"with {recursive}" + ",\n".join(f"{n} as ({known[n]})" for n in need) + "\n" + sql) if need else sql
