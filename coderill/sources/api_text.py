"""Interfaces between languages, off the text of source and definition files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Java expressions; each group is one that a rule reads.
FLASK = r"""@(?:bp|blueprint|app)\.route\(\s*["']([^"']+)["'](?:[^)\n]*?methods *= *\[([^\]]*)\])?"""
FASTAPI = r"""@app\.(get|put|post|patch|delete)\(\s*["']([^"']+)["']\s*\)"""
FETCH = r"""\bfetch\(\s*["']([^"']+)["']\s*(?:,\s*\{[^}]*?method\s*:\s*['"](\w+)['"])?"""
AXIOS = r"""\baxios\.(get|put|post|patch|delete)\(\s*["']([^"']+)["']"""


def _all(text: F.Column, pattern: str) -> tuple[F.Column, F.Column, F.Column]:
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))


def _found(files: DataFrame, pattern: str) -> DataFrame:
    """(path of the file, line, first group, second group) of each match."""
    whole, one, two = _all(F.col("text"), pattern)
    parts = files.select(F.col("path").alias("file"), "text", F.posexplode(F.arrays_zip(whole.alias("w"), one.alias("a"), two.alias("b"))).alias("k", "m"))
    # the k-th match begins where the text is split for the k-th time
    before = F.slice(F.split("text", pattern), F.lit(1), F.col("k") + 1)
    seen = F.slice(_all(F.col("text"), pattern)[0], F.lit(1), F.col("k"))
    text = F.concat(F.array_join(before, ""), F.array_join(seen, ""))
    line = F.size(F.split(text, "\n", -1))
    return parts.select("file", line.cast("bigint").alias("line_number"), F.col("m.w").alias("w"), F.col("m.a").alias("a"), F.col("m.b").alias("b"))


def endpoints(files: DataFrame) -> DataFrame:
    """(file, endpoint_type, method, path, line_number) in Python files (path, text); a route of several methods gives a row for
    each, one without says GET."""
    flask = _found(files, FLASK)
    methods = F.when(F.trim("b") == "", F.array(F.lit("GET"))).otherwise(F.transform(F.split("b", ","), lambda x: F.upper(F.regexp_replace(x, r"""[\s'"]""", ""))))
    one = flask.select("file", F.lit("flask").alias("endpoint_type"), F.explode(F.filter(methods, lambda x: x != "")).alias("method"), F.col("a").alias("path"), "line_number")
    two = _found(files, FASTAPI).select("file", F.lit("fastapi").alias("endpoint_type"), F.upper("a").alias("method"), F.col("b").alias("path"), "line_number")
    return one.unionByName(two)


def calls(files: DataFrame) -> DataFrame:
    """(file, call_type, method, url_pattern, line_number) in scripts (path, text); templates are not read."""
    one = _found(files, FETCH).select("file", F.lit("fetch").alias("call_type"), F.when(F.col("b") == "", "GET").otherwise(F.upper("b")).alias("method"), F.col("a").alias("url_pattern"), "line_number")
    two = _found(files, AXIOS).select("file", F.lit("axios").alias("call_type"), F.upper("a").alias("method"), F.col("b").alias("url_pattern"), "line_number")
    return one.unionByName(two)


def _braced(text: str, word: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(rf"\b{word}\s+(\w+)[^{{}}\n]*\{{", text):
        depth = 0
        for b in re.finditer(r"[{}]", text[m.end() - 1 :]):
            depth += 1 if b[0] == "{" else -1
            if not depth:
                yield m[1], text[m.start() : m.end() + b.start()]
                break


def types_in(path: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(type system, name, definition) in one definition file."""
    low = path.lower()
    if low.endswith(".proto"):
        yield from (("protobuf", n, d) for n, d in _braced(text, "message"))
    elif low.endswith((".graphql", ".gql")):
        yield from (("graphql", n, d) for n, d in _braced(text, "type"))
    elif low.endswith(".json"):
        try:
            schemas = json.loads(text).get("components", {}).get("schemas", {})
        except (ValueError, AttributeError):
            return
        if isinstance(schemas, dict):
            yield from (("openapi", n, json.dumps(d)) for n, d in schemas.items())


def shared_types(files: DataFrame) -> DataFrame:
    """(file_path, type_system, name, definition) of definition files (path, text)."""
    from coderill.sources.tree import workers_see_package

    workers_see_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *x) for p, t in zip(b["path"], b["text"], strict=True) for x in types_in(p, t or "")], columns=["file_path", "type_system", "name", "definition"])

    return files.select("path", "text").mapInPandas(run, "file_path string, type_system string, name string, definition string")
