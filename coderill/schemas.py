"""Types and rules of the logical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _T = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "commits": _of(id=_L, hash=_S, author_name=_S, author_email=_S, timestamp=_T, message=_S),
    "authors": _of(id=_L, name=_S, email=_S),
    "file_changes": _of(id=_L, commit_id=_L, file_path=_S, lines_added=_L, lines_deleted=_L, change_type=_S, old_path=_S),
    "temporal_coupling": _of(file_a=_S, file_b=_S, co_change_count=_L, jaccard_similarity=_D),
    "author_ownership": _of(author_id=_L, author_name=_S, file_path=_S, commit_count=_L, lines_contributed=_L),
    "languages": _of(id=_L, name=_S, version=_S),
    "modules": _of(id=_L, language_id=_L, path=_S, name=_S, file_hash=_S),
    "classes": _of(id=_L, module_id=_L, name=_S, kind=_S, line_start=_L, line_end=_L, docstring=_S),
    "functions": _of(id=_L, module_id=_L, class_id=_L, name=_S, kind=_S, line_start=_L, line_end=_L, docstring=_S, cyclomatic_complexity=_L, is_async=_B),
    "variables": _of(id=_L, module_id=_L, class_id=_L, function_id=_L, name=_S, kind=_S, line_number=_L),
    "imports": _of(id=_L, from_module_id=_L, to_module=_S, import_name=_S, alias=_S, import_kind=_S, is_relative=_B, is_dynamic=_B, is_wildcard=_B, line_number=_L),
    "calls": _of(id=_L, from_function_id=_L, to_function_id=_L, to_name=_S, call_kind=_S, line_number=_L),
    "inheritance": _of(id=_L, class_id=_L, base_class_id=_L, base_class_name=_S, relationship_kind=_S, position=_L),
    "decorators": _of(id=_L, target_type=_S, target_id=_L, decorator_name=_S, arguments=_S, line_number=_L),
    "type_hints": _of(id=_L, function_id=_L, variable_id=_L, hint_type=_S, parameter_name=_S, type_annotation=_S, is_optional=_B),
    "generic_parameters": _of(id=_L, owner_type=_S, owner_id=_L, parameter_name=_S, position=_L, constraint_expression=_S, default_value=_S),
    "language_metadata": _of(id=_L, entity_type=_S, entity_id=_L, language_id=_L, key=_S, value=_S),
    "api_endpoints": _of(id=_L, module_id=_L, endpoint_type=_S, method=_S, path=_S, line_number=_L),
    "api_calls": _of(id=_L, module_id=_L, call_type=_S, method=_S, url_pattern=_S, line_number=_L),
    "shared_types": _of(id=_L, type_system=_S, name=_S, file_path=_S, definition=_S),
    "type_usage": _of(id=_L, shared_type_id=_L, module_id=_L, usage_type=_S, line_number=_L),
    "package_managers": _of(id=_L, name=_S, ecosystem=_S),
    "external_dependencies": _of(id=_L, package_manager_id=_L, manifest_file=_S, package_name=_S, version_spec=_S, is_dev=_B),
    "dependency_conflicts": _of(package_name=_S, id1=_L, id2=_L, version1=_S, version2=_S, manifest1=_S, manifest2=_S, conflict_type=_S),
    "module_package_usage": _of(id=_L, module_id=_L, external_dependency_id=_L, import_name=_S),
}

#: What must hold of each row; null passes, as it does in a CHECK.
RULES: dict[str, list[str]] = {
    "commits": ["length(hash) = 40"],
    "file_changes": ["change_type in ('C', 'R', 'D', 'M', 'A')", "lines_added >= 0", "lines_deleted >= 0"],
    "temporal_coupling": ["file_a < file_b", "jaccard_similarity between 0 and 1"],
    "functions": ["cyclomatic_complexity >= 1"],
    "dependency_conflicts": ["conflict_type in ('version_mismatch', 'major_version_diff', 'incompatible')"],
}

#: Rows that a fresh store begins with.
LANGUAGES = ("python", "typescript", "javascript", "csharp", "java", "rust", "cpp", "go")
MANAGERS = (
    ("pip", "python"), ("poetry", "python"), ("pipenv", "python"), ("npm", "javascript"), ("yarn", "javascript"), ("cargo", "rust"), ("maven", "java"),
    ("gradle", "java"), ("go", "go"), ("nuget", "csharp"), ("conan", "cpp"), ("vcpkg", "cpp"), ("pnpm", "javascript"),
)


def seeds(spark, table: str) -> DataFrame:
    """Languages, or package managers, with ids from 1."""
    rows = {"languages": [(i, n, None) for i, n in enumerate(LANGUAGES, 1)], "package_managers": [(i, *m) for i, m in enumerate(MANAGERS, 1)]}[table]
    return spark.createDataFrame(rows, SCHEMAS[table])


def validate(df: DataFrame, table: str) -> DataFrame:
    """The rows that break a rule of the table."""
    broken: list[Column] = [~F.coalesce(F.expr(r), F.lit(True)) for r in RULES.get(table, []) if all(c in df.columns for c in SCHEMAS[table].names if c in r.split())]
    return df.where(reduce(lambda a, b: a | b, broken)) if broken else df.limit(0)
