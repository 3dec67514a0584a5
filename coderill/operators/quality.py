"""Combined measures: quality scores, recommendations, hotspots, hidden dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderill.functions.scalars import exact_mean, flag, share
from coderill.operators.resolve import resolve_any
from coderill.operators.temporal import coupled


def band(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def _typed(functions: DataFrame, hints: DataFrame) -> DataFrame:
    typed = hints.select(F.col("function_id").alias("id")).distinct()
    return functions.select("id").join(typed, "id", "left_semi").agg(F.count(F.lit(1)).alias("typed"))


def quality(functions: DataFrame, hints: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Scores from 0 to 100 of complexity, types and, given instability measures, of stability; weighed .3, .3, .4, or half
    and half without."""
    c = F.col("cyclomatic_complexity")
    base = functions.where(c > 0).agg(F.avg(c).alias("avg_complexity"), F.sum(flag(c > 15)).alias("high_complexity_count"), F.count(F.lit(1)).alias("complex_functions"))
    out = base.crossJoin(_typed(functions, hints)).crossJoin(functions.agg(F.count(F.lit(1)).alias("functions")))
    simple = F.greatest(F.lit(0.0), 100.0 - 5.0 * F.coalesce("avg_complexity", F.lit(0.0)))
    coverage = share(F.col("typed"), F.col("functions"))
    out = out.select(simple.alias("complexity_score"), coverage.alias("type_score"), F.coalesce("high_complexity_count", F.lit(0)).alias("high_complexity_count"))
    if measured is None:
        return out.withColumn("overall", 0.5 * F.col("complexity_score") + 0.5 * F.col("type_score")).withColumn("band", band(F.col("overall")))
    stable = measured.agg(exact_mean(F.col("instability")).alias("i"), F.coalesce(F.sum(flag(F.col("classification") == "high_risk")), F.lit(0)).alias("high_risk_modules"))
    out = out.crossJoin(stable).withColumn("stability_score", F.greatest(F.lit(0.0), 100.0 - 100.0 * F.coalesce("i", F.lit(0.0)))).drop("i")
    overall = 0.3 * F.col("complexity_score") + 0.3 * F.col("type_score") + 0.4 * F.col("stability_score")
    return out.withColumn("overall", overall).withColumn("band", band(F.col("overall")))


def recommendations(scored: DataFrame, most_complex: int = 10, least_typed: float = 50, least_overall: float = 60) -> DataFrame:
    """(topic, priority) of each rule that the scores set off."""

    def when(condition: Column, topic: str, priority: str) -> Column:
        return F.when(condition, F.struct(F.lit(topic).alias("topic"), F.lit(priority).alias("priority")))

    rules = F.array(
        when(F.col("high_complexity_count") > most_complex, "complexity", "high"), when(F.col("type_score") < least_typed, "types", "high"),
        when(F.col("high_risk_modules") > 0, "stability", "medium"), when(F.col("overall") < least_overall, "overall", "high"),
    )
    return scored.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("r")).select("r.topic", "r.priority")


def hotspots(modules: DataFrame, functions: DataFrame, measured: DataFrame, churned: DataFrame, least_complexity: int = 5, least_churn: int = 3) -> DataFrame:
    """Modules that are complex, often changed and much connected: complexity * commits * (ca + ce + 1)."""
    by = functions.groupBy(F.col("module_id")).agg(F.sum("cyclomatic_complexity").alias("total_complexity")).where(F.col("total_complexity") >= least_complexity)
    known = by.join(measured.select("module_id", "path", "ca", "ce", "instability"), "module_id")
    changed = churned.where(F.col("total_commits") >= least_churn).select(F.col("file_path").alias("path"), F.col("total_commits").alias("change_count"))
    score = F.col("total_complexity") * F.col("change_count") * (F.col("ca") + F.col("ce") + 1)
    return known.join(changed, "path").select("path", "total_complexity", "change_count", "ca", "ce", "instability", score.alias("hotspot_score"))


def hidden_dependencies(pairs: DataFrame, imports: DataFrame, modules: DataFrame, least_similarity: float = 0.3, least_count: int = 2) -> DataFrame:
    """Files that change together although neither imports the other."""
    met = resolve_any(imports, modules)
    src, dst = modules.select(F.col("id").alias("from_module_id"), F.col("path").alias("a")), modules.select(F.col("id").alias("module_id"), F.col("path").alias("b"))
    known = met.join(src, "from_module_id").join(dst, "module_id").select(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b")).distinct()
    return coupled(pairs, least_count, least_similarity).join(known, ["file_a", "file_b"], "left_anti")


def architecture(hot: DataFrame, cycles: DataFrame, hidden: DataFrame) -> DataFrame:
    """(kind, n, advice) of hotspots, cycles and hidden dependencies."""
    advice = {"hotspots": "split or test the busiest modules", "cycles": "break import cycles", "hidden": "make the dependency explicit"}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n", F.when(F.col("n") > 0, advice[kind]).alias("advice")) for kind, df in (("hotspots", hot), ("cycles", cycles), ("hidden", hidden))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
