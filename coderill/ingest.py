"""A whole repository into the catalog: history, structure, interfaces and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coderill.catalog import FACTS, Catalog, changed_files
from coderill.operators import ecosystem, resolve, temporal
from coderill.parsers import EXTENSIONS, SKIPPED
from coderill.schemas import LANGUAGES, MANAGERS, SCHEMAS, seeds
from coderill.sources import api_text, git, manifests, tree

MANIFESTS = ["requirements*.txt", "pyproject.toml", "Pipfile", "package.json", "Cargo.toml", "pom.xml", "go.mod"]


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Ids from 1 in the order of the columns.

    They are counted in two steps: places among the rows of one first value, and a running sum over the first values alone; so
    no task sees all rows.
    """
    first, rest = order[0], [F.col(c).asc_nulls_first() for c in order[1:]] or [F.lit(0)]
    sizes = df.groupBy(F.col(first).alias("_first")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(F.col("_first").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = df.withColumn("_place", F.row_number().over(W.partitionBy(first).orderBy(*rest)))
    return placed.join(sizes.select("_first", before.alias("_before")), F.col(first).eqNullSafe(F.col("_first"))).withColumn("id", (F.col("_before") + F.col("_place")).cast("bigint")).drop("_first", "_before", "_place")


def _fit(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in its types; those that ``df`` lacks are null."""
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields))


def history(spark: SparkSession, catalog: Catalog, path: str, repo: str) -> None:
    for table in ("commits", "file_changes"):
        catalog.write(repo, table, git.read(spark, path, table))
    commits, changes = catalog.read("commits", repo), catalog.read("file_changes", repo)
    catalog.write(repo, "authors", _fit(numbered(temporal.first_seen_authors(commits, "id"), "email"), "authors"))
    catalog.write(repo, "temporal_coupling", temporal.jaccard(changes))
    catalog.write(repo, "author_ownership", temporal.ownership(changes, commits, catalog.read("authors", repo)))


def parsed(spark: SparkSession, catalog: Catalog, path: str, repo: str) -> DataFrame:
    """The facts of all files as they are now: parsed where a file is new or changed, else as they were found before."""
    scanned = tree.source_files(spark, path)
    before = catalog.facts(repo)
    if before is None:
        now = tree.facts(scanned)
    else:
        kept = before.join(scanned.select("language", "path", "file_hash"), ["language", "path", "file_hash"], "left_semi")
        now = kept.unionByName(tree.facts(changed_files(scanned, before)))
    catalog.write(repo, FACTS, now, strict=False)
    return catalog.read(FACTS, repo)


def structure(spark: SparkSession, catalog: Catalog, path: str, repo: str) -> None:
    found = parsed(spark, catalog, path, repo)
    langs = spark.createDataFrame(list(enumerate(LANGUAGES, 1)), "language_id bigint, language string")
    catalog.write(repo, "languages", seeds(spark, "languages"))
    known = numbered(found.where("entity = 'module'").select("language", "path", "file_hash").join(F.broadcast(langs), "language"), "path")
    known = known.withColumn("name", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    catalog.write(repo, "modules", _fit(known, "modules"))
    at = catalog.read("modules", repo).select(F.col("id").alias("module_id"), "path")
    classes = numbered(tree.entity(found, "class", name="string", kind="string", line_start="bigint", line_end="bigint", docstring="string").join(at, "path"), "module_id", "line_start", "name")
    catalog.write(repo, "classes", _fit(classes, "classes"))
    own = catalog.read("classes", repo).groupBy("module_id", F.element_at(F.split("name", r"\."), -1).alias("class")).agg(F.min("id").alias("class_id"))
    functions = tree.entity(found, "function", name="string", kind="string", line_start="bigint", line_end="bigint", docstring="string", cyclomatic_complexity="bigint", is_async="boolean", **{"class": "string"})
    catalog.write(repo, "functions", _fit(numbered(functions.join(at, "path").join(own, ["module_id", "class"], "left"), "module_id", "line_start", "name"), "functions"))
    fn = catalog.read("functions", repo).groupBy("module_id", "name").agg(F.min("id").alias("function_id"))
    imports = tree.entity(found, "import", to_module="string", import_name="string", alias="string", import_kind="string", is_relative="boolean", is_dynamic="boolean", is_wildcard="boolean", line="bigint")
    catalog.write(repo, "imports", _fit(numbered(imports.join(at, "path").withColumnsRenamed({"module_id": "from_module_id", "line": "line_number"}), "from_module_id", "line_number", "to_module", "import_name"), "imports"))
    bases = tree.entity(found, "inheritance", base="string", relationship_kind="string", position="bigint", **{"class": "string"}).join(at, "path")
    bases = bases.withColumn("class", F.element_at(F.split("class", r"\."), -1)).join(own, ["module_id", "class"]).withColumnRenamed("base", "base_class_name")
    bases = numbered(bases, "class_id", "position")
    known = resolve.resolve_classes(bases.select("id", "class_id", "base_class_name"), catalog.read("classes", repo))
    catalog.write(repo, "inheritance", _fit(bases.join(known.select("id", "base_class_id"), "id"), "inheritance"))
    calls = tree.entity(found, "call", to_name="string", call_kind="string", line="bigint", **{"from": "string"}).join(at, "path").withColumnsRenamed({"from": "name", "line": "line_number"})
    calls = calls.join(fn, ["module_id", "name"]).withColumnRenamed("function_id", "from_function_id")
    calls = numbered(calls, "from_function_id", "line_number", "to_name")
    known = resolve.resolve_names(calls.select("id", "from_function_id", "to_name"), catalog.read("functions", repo))
    catalog.write(repo, "calls", _fit(calls.join(known.select("id", "to_function_id"), "id"), "calls"))
    marks = tree.entity(found, "decorator", target_type="string", target="string", decorator_name="string", arguments="string", line="bigint").join(at, "path").withColumnsRenamed({"target": "name", "line": "line_number"})
    marks = marks.join(fn, ["module_id", "name"], "left").withColumnRenamed("function_id", "target_id")
    catalog.write(repo, "decorators", _fit(numbered(marks, "module_id", "line_number", "decorator_name"), "decorators"))
    hints = tree.entity(found, "type_hint", owner="string", hint_type="string", parameter_name="string", type_annotation="string", is_optional="boolean").join(at, "path").withColumnRenamed("owner", "name")
    hints = hints.join(fn, ["module_id", "name"], "left")
    catalog.write(repo, "type_hints", _fit(numbered(hints, "module_id", "name", "hint_type", "parameter_name", "type_annotation"), "type_hints"))
    fields = tree.entity(found, "variable", name="string", kind="string", line="bigint", **{"class": "string"}).join(at, "path").join(own, ["module_id", "class"], "left").withColumnRenamed("line", "line_number")
    catalog.write(repo, "variables", _fit(numbered(fields, "module_id", "line_number", "name"), "variables"))


def _texts(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    return tree.files(spark, path, suffixes, SKIPPED).select("path", F.col("content").cast("string").alias("text"))


def interfaces(spark: SparkSession, catalog: Catalog, path: str, repo: str) -> None:
    at = catalog.read("modules", repo).select(F.col("id").alias("module_id"), F.col("path").alias("file"))
    scripts = [s for k in ("typescript", "javascript") for s in EXTENSIONS[k]]
    ends = api_text.endpoints(_texts(spark, path, list(EXTENSIONS["python"]))).join(at, "file")
    catalog.write(repo, "api_endpoints", _fit(numbered(ends, "module_id", "line_number", "path", "method"), "api_endpoints"))
    calls = api_text.calls(_texts(spark, path, scripts)).join(at, "file")
    catalog.write(repo, "api_calls", _fit(numbered(calls, "module_id", "line_number", "url_pattern", "method"), "api_calls"))
    types = api_text.shared_types(_texts(spark, path, [".proto", ".graphql", ".gql", "openapi*.json", "swagger*.json"]))
    catalog.write(repo, "shared_types", _fit(numbered(types, "file_path", "name"), "shared_types"))


def declarations(spark: SparkSession, catalog: Catalog, path: str, repo: str) -> None:
    catalog.write(repo, "package_managers", seeds(spark, "package_managers"))
    ids = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MANAGERS, 1)], "package_manager_id bigint, manager string")
    found = manifests.declared(_texts(spark, path, MANIFESTS)).join(F.broadcast(ids), "manager")
    catalog.write(repo, "external_dependencies", _fit(numbered(found, "manifest_file", "package_name", "version_spec", "is_dev"), "external_dependencies"))
    catalog.write(repo, "dependency_conflicts", ecosystem.conflicts(catalog.read("external_dependencies", repo)))


def analyse(spark: SparkSession, catalog: Catalog, path: str, with_structure: bool = True) -> str:
    """Replace all that the catalog holds of the repository at ``path``; its name."""
    if not git.discover(path)[:1]:
        raise FileNotFoundError(f"{path} is no git repository")
    repo = git.repo_name(path)
    history(spark, catalog, path, repo)
    if with_structure:
        structure(spark, catalog, path, repo)
        interfaces(spark, catalog, path, repo)
        declarations(spark, catalog, path, repo)
    return repo
