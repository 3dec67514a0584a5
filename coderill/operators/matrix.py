"""Sparse coupling matrices in coordinates, over files grouped by directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coderill.functions.scalars import directory
from coderill.operators.placing import meet, tasks
from coderill.operators.resolve import resolve_tiered
from coderill.operators.temporal import live


def index(files: DataFrame, depth: int = 1) -> DataFrame:
    """(path, dir, idx): distinct paths in order of directory and path, numbered from 0.

    The numbers are counted in two steps, so that no task sees all files: places within each directory, and a running sum of
    the directories' sizes.
    """
    n = tasks(files)
    own = files.select("path").distinct().withColumn("dir", directory(F.col("path"), depth))
    sizes = own.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("dir").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("dir", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("dir").orderBy("path")) - 1
    return own.repartition(n, "dir").withColumn("place", place).join(starts.repartition(n, "dir").hint("merge"), "dir").select("path", "dir", (F.col("start") + F.col("place")).cast("bigint").alias("idx"))


def ranges(indexed: DataFrame) -> DataFrame:
    """By directory: first index, last index + 1, files."""
    return indexed.groupBy("dir").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.count(F.lit(1)).alias("n"))


def _cells(pairs: DataFrame, indexed: DataFrame, a: str, b: str) -> DataFrame:
    rows, cols = indexed.select(F.col("path").alias(a), F.col("idx").alias("row")), indexed.select(F.col("path").alias(b), F.col("idx").alias("col"))
    return pairs.join(rows, a).join(cols, b).select("row", "col", "value")


def structural(imports: DataFrame, modules: DataFrame, depth: int = 1) -> DataFrame:
    """(row, col, value): imports of one module by another, self-imports left out."""
    n = tasks(imports, modules)
    placed = meet(modules.select("id", "path"), index(modules.select("path"), depth), "path", tasks(modules)).select("id", "idx")
    rows, cols = placed.select(F.col("id").alias("from_module_id"), F.col("idx").alias("row")), placed.select(F.col("id").alias("module_id"), F.col("idx").alias("col"))
    met = meet(meet(resolve_tiered(imports, modules), rows, "from_module_id", n), cols, "module_id", n).where("row <> col")
    return met.repartition(n, "row", "col").groupBy("row", "col").agg(F.sum("n").alias("value"))


def temporal(pairs: DataFrame, changes: DataFrame, least: float = 0.1, depth: int = 1) -> DataFrame:
    """(row, col, value): similarity of files that are still known, both ways round."""
    strong = pairs.where(F.col("jaccard_similarity") >= least).select(F.col("file_a").alias("a"), F.col("file_b").alias("b"), F.col("jaccard_similarity").alias("value"))
    both = strong.unionByName(strong.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    return _cells(both, index(live(changes).select(F.col("file_path").alias("path")), depth), "a", "b")


def nested(cells: DataFrame) -> DataFrame:
    """One row for each matrix row that has cells: (row, cells)."""
    return cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))


def stats(cells: DataFrame, indexed: DataFrame) -> DataFrame:
    files = indexed.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("dir").alias("directories"))
    return files.crossJoin(cells.agg(F.count(F.lit(1)).alias("cells"))).withColumn("cells_per_file", F.col("cells") / F.nullif(F.col("files"), F.lit(0)))
