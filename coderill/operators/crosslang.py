"""Calls and endpoints across languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderill.operators.resolve import resolve_any


def _key(path: Column) -> Column:
    """The longest piece of a pattern that holds no wildcard, in lower case: whatever the pattern fits holds it."""
    pieces = F.split(F.lower(path), "[%_]")
    return F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]


def _holding(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """(url, m, key) for the distinct URLs of ``calls`` and each key of an endpoint of their method that they hold.

    A URL is taken apart into its pieces of the lengths that keys of its method have, so that "holds" is an equality.
    """
    keys = ends.select("m", "key").distinct()
    lengths = keys.groupBy("m").agg(F.collect_set(F.length("key")).alias("lengths"))
    urls = calls.select(F.col("method").alias("m"), F.col("url_pattern").alias("url")).distinct().join(lengths, "m")
    pieces = F.expr("array_distinct(flatten(transform(lengths, n -> if(n > length(url), cast(array() as array<string>), transform(sequence(1, length(url) - n + 1), k -> substring(lower(url), k, n))))))")
    return urls.select("m", "url", F.explode(pieces).alias("key")).join(keys, ["m", "key"])


def matches(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Calls whose URL holds an endpoint's path and whose method is the same; every match stays."""
    ends = endpoints.select(F.col("method").alias("m"), "path", "endpoint_type").distinct().withColumn("key", F.lower("path"))
    met = _holding(calls, ends).join(ends, ["m", "key"]).where(F.expr("contains(url, path)")).drop("key")
    return calls.join(met, (F.col("m") == F.col("method")) & (F.col("url") == F.col("url_pattern"))).select("id", "url_pattern", "method", "call_type", "path", "endpoint_type")


def unmatched_calls(calls: DataFrame, matched: DataFrame) -> DataFrame:
    """Calls whose URL is in no match, under whatever method."""
    return calls.join(matched.select("url_pattern").distinct(), "url_pattern", "left_anti").select("id", "url_pattern", "method", "call_type")


def unmatched_endpoints(endpoints: DataFrame, matched: DataFrame) -> DataFrame:
    return endpoints.join(matched.select("path").distinct(), "path", "left_anti").select("module_id", "endpoint_type", "method", "path")


def summary(calls: DataFrame, endpoints: DataFrame, matched: DataFrame) -> DataFrame:
    parts = {"endpoints": endpoints, "calls": calls, "matched": matched, "unmatched_calls": unmatched_calls(calls, matched), "unmatched_endpoints": unmatched_endpoints(endpoints, matched)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def coupling(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """All calls, with the endpoints of that method whose path, as a pattern of any case, is in the URL.

    % and _ are wildcards; no sign takes that from them.
    """
    ends = endpoints.select(F.col("method").alias("m"), "path", "endpoint_type").distinct().withColumn("key", _key(F.col("path")))
    met = _holding(calls, ends).join(ends, ["m", "key"]).where(F.expr("url ilike concat('%', path, '%') escape '\\u0001'")).drop("key")
    return calls.join(met, (F.col("m") == F.col("method")) & (F.col("url") == F.col("url_pattern")), "left").select("id", "url_pattern", "method", "call_type", "path", "endpoint_type")


def cross_imports(imports: DataFrame, modules: DataFrame, languages: DataFrame) -> DataFrame:
    """Imports by the languages of both ends, where those differ."""
    of = modules.join(languages.select(F.col("id").alias("language_id"), F.col("name").alias("language")), "language_id", "left").select("id", "language")
    met = resolve_any(imports, modules)
    src, dst = of.select(F.col("id").alias("from_module_id"), F.col("language").alias("from_language")), of.select(F.col("id").alias("module_id"), F.col("language").alias("to_language"))
    return met.join(src, "from_module_id").join(dst, "module_id").where("from_language <> to_language").groupBy("from_language", "to_language").agg(F.count(F.lit(1)).alias("n"))


def by_language(df: DataFrame, kind: str, modules: DataFrame, languages: DataFrame) -> DataFrame:
    """Rows of ``df`` (module_id and a kind) by language and kind."""
    of = modules.join(languages.select(F.col("id").alias("language_id"), F.col("name").alias("language")), "language_id").select(F.col("id").alias("module_id"), "language")
    return df.join(of, "module_id").groupBy("language", kind).agg(F.count(F.lit(1)).alias("n"))


def by_method(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy(F.coalesce("method", F.lit("UNKNOWN")).alias("method")).agg(F.count(F.lit(1)).alias("n"))


def by_type_system(types: DataFrame) -> DataFrame:
    return types.groupBy("type_system").agg(F.count(F.lit(1)).alias("n"))


def in_languages(calls: DataFrame, modules: DataFrame, languages: DataFrame, names: list[str]) -> DataFrame:
    of = modules.join(languages.where(F.col("name").isin(names)).select(F.col("id").alias("language_id")), "language_id", "left_semi").select(F.col("id").alias("module_id"))
    return calls.join(of, "module_id", "left_semi")
