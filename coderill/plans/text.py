"""Queries of the text rules, and of the set and write rules, over driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.adapters import Logical
from coderill.functions import scalars
from coderill.plans.registry import query
from coderill.sources import git, tree


@query("select l_orderkey * 10 + l_linenumber as id, round_even(l_discount * 100 / 8, 1)::double as rounded, printf('%.2f', l_extendedprice) as fixed from lineitem")
def fn_rounding(t: Logical) -> DataFrame:
    # eighths are exact doubles, so ties are ties
    return t.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), scalars.round_half_even(F.col("l_discount") * 100 / 8, 1).cast("double").alias("rounded"), scalars.to_fixed(F.col("l_extendedprice"), 2).alias("fixed"))


@query("select p_partkey as id, regexp_replace(list_last(string_split(p, '/')), '(.)[.][^.]*$', '\\1') as stem, list_last(string_split(p, '/')) as base from (select p_partkey, p_brand || '/' || replace(p_type, ' ', '.') as p from part)")
def fn_path_parts(t: Logical) -> DataFrame:
    path = F.concat_ws("/", "p_brand", F.replace("p_type", F.lit(" "), F.lit(".")))
    return t.table("part").select(F.col("p_partkey").alias("id"), scalars.stem(path).alias("stem"), scalars.base_name(path).alias("base"))


@query("select page_id, sha256(html) as file_hash, len(string_split(html, chr(10))) as lines from pages")
def src_incremental_hash(t: Logical) -> DataFrame:
    tree.workers_see_package(t.spark)
    return t.table("pages").select("page_id", F.sha2("html", 256).alias("file_hash"), _by_git(lambda x: git.pieces(x.encode()), "bigint")("html").alias("lines"))


def _by_git(source, result: str):
    """A function of the Git source, over a column."""
    return F.pandas_udf(lambda s: s.map(source, na_action="ignore"), result)


@query("select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'A') and not starts_with(x, 'AAA'))) as plus from documents")
def src_line_counts(t: Logical) -> DataFrame:
    tree.workers_see_package(t.spark)
    plus = _by_git(lambda x: git.signed(x.encode().split(b"\n"), b"A"), "bigint")
    return t.table("documents").select("doc_id", plus("text").alias("plus"))


@query("select doc_id, len(string_split(text, chr(10))) as lines from documents")
def src_root_commit(t: Logical) -> DataFrame:
    tree.workers_see_package(t.spark)
    return t.table("documents").select("doc_id", _by_git(lambda x: git.pieces(x.encode()), "bigint")("text").alias("lines"))


@query("select l_orderkey as commit_id, l_linenumber as n, case when l_returnflag = 'A' then 'A' when l_linestatus = 'F' then 'D' when l_quantity > 40 then 'R' when l_discount > 0.05 then 'C' else 'M' end as change_type from lineitem")
def src_file_changes(t: Logical) -> DataFrame:
    tree.workers_see_package(t.spark)
    status = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_linestatus") == "F", "D").when(F.col("l_quantity") > 40, "R087").when(F.col("l_discount") > 0.05, "C100").otherwise("T")
    return t.table("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("n"), _by_git(git.kind_of, "string")(status).alias("change_type"))


@query("select page_id, path from (select page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) as path from pages)")
def api_paths(t: Logical) -> DataFrame:
    return t.table("pages").select("page_id", F.explode(F.expr(r"""regexp_extract_all(html, 'href="(/[^"]*)"', 1)""")).alias("path"))


@query("select o_orderkey as id from orders where lower(o_orderpriority) not in ('1-urgent', '5-low')")
def flt_keyword(t: Logical) -> DataFrame:
    return t.table("orders").where(~F.lower("o_orderpriority").isin("1-urgent", "5-low")).select(F.col("o_orderkey").alias("id"))


@query("select page_id, url from pages where not regexp_matches(lower(url), '[.](net|org)/')")
def flt_path_pattern(t: Logical) -> DataFrame:
    return t.table("pages").where(~F.lower("url").rlike(r"\.(net|org)/")).select("page_id", "url")


@query("select email, name from (select 'cust' || c_custkey || '@x' as email, c_name as name from customer where c_custkey % 3 = 0 union all select distinct 'cust' || o_custkey || '@x', 'order' from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 = 0))")
def dml_insert_ignore(t: Logical) -> DataFrame:
    from coderill.catalog import insert_ignore

    old = t.table("customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("cust"), F.col("c_custkey").cast("string"), F.lit("@x")).alias("email"), F.col("c_name").alias("name"))
    new = t.table("orders").select(F.concat(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("@x")).alias("email"), F.lit("order").alias("name"))
    return insert_ignore(old, new, ["email"])


@query("select c_custkey as id, coalesce(n, 0)::bigint as n from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def dml_upsert(t: Logical) -> DataFrame:
    from coderill.catalog import upsert

    old = t.table("customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("bigint").alias("n"))
    new = t.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return upsert(old, new, ["id"])
