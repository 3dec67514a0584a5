"""Reports over a repository's tables (or those of all): name to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderill.catalog import Catalog
from coderill.operators import activity, crosslang, ecosystem, graph, matrix, quality, structural, temporal


def page(df: DataFrame, size: int, number: int, *order: str | Column) -> DataFrame:
    """The ``number``-th page, from 1, of so many rows in an order; a top-k sort, of which the pages before are left out."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


class Reports:
    def __init__(self, catalog: Catalog, repo: str):
        self.catalog, self.repo = catalog, repo

    def table(self, name: str) -> DataFrame:
        return self.catalog.read(name, self.repo)

    def churn(self) -> DataFrame:
        return temporal.churn(self.table("file_changes"), self.table("commits"))

    def coupling(self, least_count: int = 2, least_similarity: float = 0.0) -> DataFrame:
        return temporal.coupled(self.table("temporal_coupling"), least_count, least_similarity)

    def authors(self) -> DataFrame:
        return temporal.author_stats(self.table("authors"), self.table("commits"), self.table("file_changes"))

    def ownership(self, file: str | None = None) -> DataFrame:
        df = self.table("author_ownership")
        return df if file is None else df.where(F.col("file_path") == file)

    def code_age(self, as_of: Column) -> DataFrame:
        return temporal.code_age(self.churn(), as_of)

    def summary(self) -> DataFrame:
        return temporal.summary(self.table("commits"), self.table("authors"), self.table("file_changes"), self.table("temporal_coupling"))

    def instability(self) -> DataFrame:
        return structural.instability(self.table("modules"), self.table("imports"))

    def complexity(self) -> DataFrame:
        return structural.module_complexity(self.table("modules"), self.table("functions"))

    def cycles(self) -> DataFrame:
        return graph.cycle_table(graph.components(graph.edges(self.table("imports"), self.table("modules"))))

    def hotspots(self, least_complexity: int = 5, least_churn: int = 3) -> DataFrame:
        return quality.hotspots(self.table("modules"), self.table("functions"), self.instability(), self.churn(), least_complexity, least_churn)

    def hidden(self, least_similarity: float = 0.3, least_count: int = 2) -> DataFrame:
        return quality.hidden_dependencies(self.table("temporal_coupling"), self.table("imports"), self.table("modules"), least_similarity, least_count)

    def api_boundaries(self) -> dict[str, DataFrame]:
        calls, ends = self.table("api_calls"), self.table("api_endpoints")
        met = crosslang.matches(calls, ends)
        return {"matched": met, "unmatched_calls": crosslang.unmatched_calls(calls, met), "unmatched_endpoints": crosslang.unmatched_endpoints(ends, met), "summary": crosslang.summary(calls, ends, met)}

    def call_graph(self) -> dict[str, DataFrame]:
        calls, functions, modules = self.table("calls"), self.table("functions"), self.table("modules")
        edges = structural.call_edges(calls, functions, modules)
        top = lambda df: df.orderBy(F.desc("n"), "function_id").limit(20)
        return {"calls": edges, "entry_points": structural.entry_points(functions, calls), "most_called": top(structural.calls_in(calls, functions)), "most_calling": top(structural.calls_out(calls, functions)), "stats": structural.call_stats(edges)}

    def commit_patterns(self, as_of: Column) -> dict[str, DataFrame]:
        commits, changes = self.table("commits"), self.table("file_changes")
        return {
            "frequency": temporal.commit_frequency(changes, commits).orderBy(F.desc("month"), "file_path").limit(100), "heat": activity.commit_time(commits),
            "active": activity.active_areas(changes, commits, as_of).orderBy(F.desc("recent_commits"), "file_path").limit(20), "trend": activity.latest_weeks(commits), "stats": activity.commit_stats(commits),
        }

    def polyglot(self) -> dict[str, DataFrame]:
        modules, langs, deps, managers = self.table("modules"), self.table("languages"), self.table("external_dependencies"), self.table("package_managers")
        return {
            "languages": structural.language_stats(langs, modules, self.table("functions")), "cross_imports": crosslang.cross_imports(self.table("imports"), modules, langs),
            "endpoints": crosslang.by_language(self.table("api_endpoints"), "endpoint_type", modules, langs), "calls": crosslang.by_language(self.table("api_calls"), "call_type", modules, langs),
            "shared_types": crosslang.by_type_system(self.table("shared_types")), "dependencies": ecosystem.by_manager(deps, managers), "conflicts": self.table("dependency_conflicts"),
        }

    def quality(self) -> dict[str, DataFrame]:
        scored = quality.quality(self.table("functions"), self.table("type_hints"), self.instability())
        return {"scores": scored, "recommendations": quality.recommendations(scored)}

    def matrices(self) -> dict[str, DataFrame]:
        index = matrix.index(self.table("modules").select("path"))
        return {
            "structural": matrix.nested(matrix.structural(self.table("imports"), self.table("modules"))), "temporal": matrix.nested(matrix.temporal(self.table("temporal_coupling"), self.table("file_changes"))),
            "files": index, "directories": matrix.ranges(index),
        }


def of_all(catalog: Catalog, make: Callable[[Reports], DataFrame]) -> DataFrame | None:
    """One report for every repository that has the tables it takes, with its name; None if none has."""
    out = None
    for r in catalog.repos():
        try:
            one = make(Reports(catalog, r)).withColumn("repo", F.lit(r))
        except FileNotFoundError:
            continue
        out = one if out is None else out.unionByName(one)
    return out
