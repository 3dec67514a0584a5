"""Command line: ``python -m coderill.cli --store DIR analyze-repo PATH`` and so on."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coderill import examples, ingest, sinks
from coderill.catalog import Catalog
from coderill.operators import temporal
from coderill.reports import Reports
from coderill.sources import git

GROUPS = ("churn", "coupling", "authors")
_ORDER = {"churn": ("total_churn", "file_path"), "coupling": ("jaccard_similarity", "file_a", "file_b"), "authors": ("total_commits", "email")}


def _metric(reports: Reports, name: str) -> DataFrame:
    first, *rest = _ORDER[name]
    return getattr(reports, name)().orderBy(F.desc(first), *rest)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="coderill")
    p.add_argument("--store", default="data")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("analyze-dir")
    x.add_argument("path")
    x.add_argument("--structure", action="store_true")
    sub.add_parser("analyze-repo").add_argument("path")
    x = sub.add_parser("show-metrics")
    x.add_argument("repo")
    for g in (*GROUPS, "all"):
        x.add_argument(f"--{g}", action="store_true")
    x.add_argument("--export-csv")
    x.add_argument("--export-json")
    sub.add_parser("compare-repos").add_argument("repos", nargs="+")
    sub.add_parser("list")
    x = sub.add_parser("regenerate-examples")
    x.add_argument("--folder", default="examples")
    x.add_argument("--clean", action="store_true")
    return p


def _named(path: str, group: str, several: bool) -> str:
    """One file for each group, so that none is written over."""
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}-{group}.{suffix}" if several and dot else f"{path}-{group}" if several else path


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = Catalog(spark, a.store)
    if a.command == "analyze-repo":
        print("analysed", ingest.analyse(spark, catalog, a.path))
    elif a.command == "analyze-dir":
        failed = 0
        for path in git.discover(a.path):
            try:
                print("analysed", ingest.analyse(spark, catalog, path, a.structure))
            except Exception as e:  # noqa: BLE001  (one bad repository doesn't end the run)
                failed += 1
                print(f"{path}: {e}", file=sys.stderr)
        return int(failed > 0)
    elif a.command == "regenerate-examples":
        for path in examples.make(a.folder, a.clean):
            name = git.repo_name(path)
            if a.clean:
                catalog.drop(name)
            print("analysed", ingest.analyse(spark, catalog, path))
            print(sinks.report_text(Reports(catalog, name).summary()))
    elif a.command == "list":
        print("\n".join(catalog.repos()))
    elif a.command == "show-metrics":
        if not catalog.exists(a.repo):
            print(f"{a.repo} is not in the store", file=sys.stderr)
            return 1
        reports = Reports(catalog, a.repo)
        print(sinks.report_text(reports.summary()))
        chosen = [g for g in GROUPS if getattr(a, g)]
        chosen = list(GROUPS) if a.all or not chosen else chosen
        for g in chosen:
            df = _metric(reports, g)
            print(g + "\n" + sinks.report_text(df))
            if a.export_csv:
                sinks.report_csv(df, _named(a.export_csv, g, len(chosen) > 1))
            if a.export_json:
                sinks.report_json(df, _named(a.export_json, g, len(chosen) > 1))
    else:
        known = [r for r in a.repos if catalog.exists(r)]
        if not known:
            print("none of these is in the store", file=sys.stderr)
            return 1
        parts = [Reports(catalog, r).authors().withColumn("repo", F.lit(r)) for r in known]
        churned = [Reports(catalog, r).churn().withColumn("repo", F.lit(r)) for r in known]
        for p in parts[1:]:
            parts[0] = parts[0].unionByName(p)
        for p in churned[1:]:
            churned[0] = churned[0].unionByName(p)
        print(sinks.report_text(parts[0].orderBy("repo", F.desc("total_commits"), "email"), 100))
        print(sinks.report_text(temporal.top_of_each(churned[0], "repo", [F.desc("total_churn"), F.asc("file_path")], 10).orderBy("repo", "place"), 100))
    return 0


if __name__ == "__main__":
    sys.exit(main())
