"""Structure: coupling between modules, complexity, types, decorators, inheritance and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderill.functions.scalars import exact_mean, flag, share
from coderill.operators.placing import tasks
from coderill.operators.resolve import imported_pairs, known_targets

BINS = (("1-5", 1, 5), ("6-10", 6, 10), ("11-15", 11, 15), ("16-20", 16, 20), ("21+", 21, None))


def _named(modules: DataFrame) -> DataFrame:
    return modules.select(F.col("id").alias("module_id"), "name", "path", "language_id")


def afferent(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct modules that import each module."""
    n = tasks(imports, modules)
    met = imported_pairs(imports, known_targets(modules), n).repartition(n, "module_id", "from_module_id").distinct()
    met = met.groupBy("module_id").agg(F.count("from_module_id").alias("ca"))
    return _named(modules).join(met, "module_id", "left").select("module_id", "path", F.coalesce("ca", F.lit(0)).cast("bigint").alias("ca"))


def efferent(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct targets that each module imports, those outside the repository included."""
    out = imports.groupBy(F.col("from_module_id").alias("module_id")).agg(F.countDistinct("to_module").alias("ce"))
    return _named(modules).join(out, "module_id", "left").select("module_id", "path", F.coalesce("ce", F.lit(0)).cast("bigint").alias("ce"))


def instability(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """ce / (ca + ce), 0 for an isolated module, with stability and a classification."""
    both = afferent(modules, imports).join(efferent(modules, imports).drop("path"), "module_id")
    total = F.col("ca") + F.col("ce")
    value = F.when(total == 0, F.lit(0.0)).otherwise(F.col("ce") / total)
    return both.select("module_id", "path", "ca", "ce", value.alias("instability")).withColumn("stability", 1.0 - F.col("instability")).withColumn("classification", risk(F.col("instability"), F.col("ca"), F.col("ce")))


def risk(value: Column, ca: Column, ce: Column) -> Column:
    return F.when((value > 0.8) & (ca > 5), "high_risk").when((value < 0.2) & (ce > 5), "rigid").otherwise("normal")


def instability_stats(measured: DataFrame) -> DataFrame:
    return measured.agg(
        F.avg("ca").alias("avg_ca"), F.max("ca").alias("max_ca"), F.avg("ce").alias("avg_ce"), F.max("ce").alias("max_ce"), exact_mean(F.col("instability")).alias("avg_instability"),
        F.sum(flag(F.col("classification") == "high_risk")).alias("high_risk"), F.sum(flag(F.col("classification") == "rigid")).alias("rigid"),
    )


def module_complexity(modules: DataFrame, functions: DataFrame) -> DataFrame:
    """Modules without functions have 0 of them and no sums."""
    c = F.col("cyclomatic_complexity")
    by = functions.groupBy("module_id").agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total_complexity"), F.avg(c).alias("avg_complexity"), F.max(c).alias("max_complexity"))
    return _named(modules).join(by, "module_id", "left").select("module_id", "path", "language_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("function_count"), "total_complexity", "avg_complexity", "max_complexity")


def language_stats(languages: DataFrame, modules: DataFrame, functions: DataFrame) -> DataFrame:
    """By language with files: files, functions, complexity in all and on average a file."""
    per = module_complexity(modules, functions).select(F.col("language_id").alias("id"), "function_count", F.coalesce("total_complexity", F.lit(0)).alias("c"))
    by = per.groupBy("id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("function_count").alias("function_count"), F.sum("c").alias("total_complexity"), F.avg("c").alias("avg_complexity"))
    return languages.join(by, "id").select(F.col("name").alias("language"), "file_count", "function_count", "total_complexity", "avg_complexity")


def complexity_stats(functions: DataFrame, above: int = 15) -> DataFrame:
    c = F.col("cyclomatic_complexity")
    high = F.sum(flag(c > above))
    return functions.where(c > 0).agg(F.count(F.lit(1)).alias("total_functions"), F.avg(c).alias("avg_complexity"), F.max(c).alias("max_complexity"), high.alias("high_complexity"), share(high, F.count(F.lit(1))).alias("high_share"))


def histogram(functions: DataFrame) -> DataFrame:
    """Functions in each range of complexity, empty ranges too."""
    c = F.col("cyclomatic_complexity")
    inside = {name: (c >= lo) if hi is None else c.between(lo, hi) for name, lo, hi in BINS}
    counts = functions.agg(*(F.sum(flag(x)).alias(name) for name, x in inside.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("bin"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("n")) for n in inside))).alias("x")).select("x.bin", "x.n")


def type_coverage(modules: DataFrame, functions: DataFrame, hints: DataFrame) -> DataFrame:
    """By module with functions: typed ones have a hint at least."""
    typed = hints.select(F.col("function_id").alias("id")).distinct().withColumn("typed", F.lit(1))
    by = functions.select("id", "module_id").join(typed, "id", "left").groupBy("module_id").agg(F.count(F.lit(1)).alias("total_functions"), F.sum(F.coalesce("typed", F.lit(0))).cast("bigint").alias("typed_functions"))
    return _named(modules).join(by, "module_id").select(
        "path", "total_functions", "typed_functions", (F.col("total_functions") - F.col("typed_functions")).alias("untyped_functions"), share(F.col("typed_functions"), F.col("total_functions")).alias("coverage"),
        _coverage_band(share(F.col("typed_functions"), F.col("total_functions"))).alias("band"),
    )


def _coverage_band(x: Column) -> Column:
    return F.when(x > 80, "good").when(x > 50, "fair").otherwise("poor")


def overall_coverage(by_module: DataFrame) -> DataFrame:
    t, a = F.sum("typed_functions"), F.sum("total_functions")
    return by_module.agg(a.alias("total_functions"), t.alias("typed_functions"), share(t, a).alias("coverage"))


def generics(parameters: DataFrame) -> DataFrame:
    return parameters.groupBy("parameter_name").agg(F.count(F.lit(1)).alias("n"))


def decorators(marks: DataFrame, functions: DataFrame, modules: DataFrame) -> DataFrame:
    """Uses by decorator and module."""
    on = marks.where("target_type = 'function'").select("decorator_name", F.col("target_id").alias("id")).join(functions.select("id", "module_id"), "id")
    return on.groupBy("decorator_name", "module_id").agg(F.count(F.lit(1)).alias("n")).join(_named(modules), "module_id").select("decorator_name", "path", "n")


def decorated(marks: DataFrame, functions: DataFrame) -> DataFrame:
    """Decorators on each function that has some."""
    by = marks.where("target_type = 'function'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return by.join(functions.select("id", "name"), "id").select(F.col("id").alias("function_id"), "name", "n")


def inherits(inheritance: DataFrame, classes: DataFrame, modules: DataFrame) -> DataFrame:
    """Child and base by name and module; a base that is not known is null."""
    at = modules.select(F.col("id").alias("m"), "path")
    own = classes.join(at, F.col("module_id") == F.col("m")).select("id", "name", "path")
    child = own.select(F.col("id").alias("class_id"), F.col("name").alias("child"), F.col("path").alias("child_path"))
    base = own.select(F.col("id").alias("base_class_id"), F.col("name").alias("base"), F.col("path").alias("base_path"))
    return inheritance.join(child, "class_id").join(base, "base_class_id", "left").select("class_id", "child", "child_path", "base_class_id", "base", "base_path", "relationship_kind")


def parents(inheritance: DataFrame) -> DataFrame:
    return inheritance.groupBy("class_id").agg(F.count(F.lit(1)).alias("parent_count"))


def children(inheritance: DataFrame) -> DataFrame:
    return inheritance.where("base_class_id is not null").groupBy("base_class_id").agg(F.count(F.lit(1)).alias("child_count"))


def inheritance_stats(inheritance: DataFrame) -> DataFrame:
    several = parents(inheritance).agg(F.sum(flag(F.col("parent_count") > 1)).alias("multiple"))
    return inheritance.agg(F.count(F.lit(1)).alias("relations"), F.countDistinct("class_id").alias("children"), F.countDistinct("base_class_id").alias("bases")).crossJoin(several)


def class_kinds(classes: DataFrame) -> DataFrame:
    return classes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def call_edges(calls: DataFrame, functions: DataFrame, modules: DataFrame) -> DataFrame:
    """Calls whose target is known, with names and modules of both ends."""
    at = modules.select(F.col("id").alias("m"), "path")
    own = functions.join(at, F.col("module_id") == F.col("m")).select("id", "name", "path")
    src = own.select(F.col("id").alias("from_function_id"), F.col("name").alias("caller"), F.col("path").alias("caller_path"))
    dst = own.select(F.col("id").alias("to_function_id"), F.col("name").alias("callee"), F.col("path").alias("callee_path"))
    return calls.join(src, "from_function_id").join(dst, "to_function_id").select("id", "caller", "caller_path", "callee", "callee_path", "call_kind")


def entry_points(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that nobody calls."""
    called = calls.where("to_function_id is not null").select(F.col("to_function_id").alias("id")).distinct()
    return functions.join(called, "id", "left_anti").select(F.col("id").alias("function_id"), "name", "module_id")


def calls_out(calls: DataFrame, functions: DataFrame) -> DataFrame:
    by = calls.groupBy(F.col("from_function_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return by.join(functions.select("id", "name"), "id").select(F.col("id").alias("function_id"), "name", "n")


def calls_in(calls: DataFrame, functions: DataFrame) -> DataFrame:
    by = calls.where("to_function_id is not null").groupBy(F.col("to_function_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return by.join(functions.select("id", "name"), "id").select(F.col("id").alias("function_id"), "name", "n")


def call_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("caller").alias("callers"), F.countDistinct("callee").alias("callees"))


def class_complexity(classes: DataFrame, functions: DataFrame) -> DataFrame:
    by = functions.groupBy(F.col("class_id").alias("id")).agg(F.count(F.lit(1)).alias("methods"), F.sum("cyclomatic_complexity").alias("complexity"))
    return classes.join(by, "id").select(F.col("id").alias("class_id"), "name", "methods", "complexity")


def imported_list(imports: DataFrame) -> DataFrame:
    """All targets of a module in one text, in order."""
    return imports.groupBy("from_module_id").agg(F.array_join(F.array_sort(F.collect_list("to_module")), ",").alias("targets"))


def import_counts(imports: DataFrame) -> DataFrame:
    return imports.groupBy("from_module_id", "to_module").agg(F.count(F.lit(1)).alias("n"))
