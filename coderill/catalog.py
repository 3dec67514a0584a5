"""The store of analysed repositories: one Parquet table an entity, partitioned by ``repo``.

A repository is written whole, by replacing its partitions, so that analysing it again never doubles its rows. Reading one
repository prunes the other partitions.
"""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coderill.schemas import SCHEMAS, validate


#: Facts by file, so that files which did not change are not parsed again.
FACTS = "parsed_facts"


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, one for each key."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(key), key, "left_anti").select(old.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; of several new ones, the greatest in all columns."""
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(old.columns).withColumn("_new", F.lit(1)))
    last = F.max(F.struct("_new", *rest)).alias("_last")
    return both.groupBy(*key).agg(last).select(*(F.col(c) if c in key else F.col("_last")[c].alias(c) for c in old.columns))


def changed_files(scan: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (language, path, file_hash) is not yet known."""
    key = ["language", "path", "file_hash"]
    return scan.join(known.select(*key).distinct(), key, "left_anti")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _at(self, table: str, repo: str) -> str:
        return f"{self.root}/{table}/repo={quote(repo, safe=' .-_')}"

    def write(self, repo: str, table: str, df: DataFrame, strict: bool = True) -> None:
        """Replace the repository's part of the table. Strict: rows that break the schema's rules are an error.

        Rows are made once: they are written aside, checked as they lie there, and then take the old ones' place.
        """
        at, aside = self._at(table, repo), f"{self.root}/_staged/{table}-{uuid.uuid4().hex}"
        df.write.parquet(aside)
        bad = validate(self.spark.read.schema(df.schema).parquet(aside), table).limit(3).collect() if strict else []
        if bad:
            self._fs.delete(self._path(aside), True)
            raise ValueError(f"rows of {table} break its rules: {bad}")
        self._fs.delete(self._path(at), True)
        self._fs.mkdirs(self._path(at).getParent())
        if not self._fs.rename(self._path(aside), self._path(at)):
            raise OSError(f"can't move {aside} to {at}")

    def facts(self, repo: str) -> DataFrame | None:
        """What the parsers found in the repository's files when it was analysed last, by the hash of each file."""
        return self.read(FACTS, repo) if self._exists(self._at(FACTS, repo)) else None

    def read(self, table: str, repo: str | None = None) -> DataFrame:
        """All repositories' rows with ``repo``, or one's without."""
        if repo is None:
            if not self._exists(f"{self.root}/{table}"):
                raise FileNotFoundError(f"no table {table} in {self.root}")
            return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}").withColumn("repo", F.col("repo").cast("string"))
        if not self._exists(self._at(table, repo)):
            raise FileNotFoundError(f"{repo} has no {table}")
        return self.spark.read.parquet(self._at(table, repo))

    def repos(self) -> list[str]:
        """Names of repositories with a table at least, sorted."""
        found: set[str] = set()
        for table in SCHEMAS:
            if self._exists(f"{self.root}/{table}"):
                found |= {s.getPath().getName()[5:] for s in self._fs.listStatus(self._path(f"{self.root}/{table}")) if s.getPath().getName().startswith("repo=")}
        from urllib.parse import unquote

        return sorted(unquote(x) for x in found)

    def exists(self, repo: str) -> bool:
        return any(self._exists(self._at(table, repo)) for table in SCHEMAS)

    def drop(self, repo: str) -> None:
        for table in (*SCHEMAS, FACTS):
            if self._exists(self._at(table, repo)):
                self._fs.delete(self._path(self._at(table, repo)), True)

    def several(self, table: str, repos: list[str]) -> DataFrame:
        """Rows of the named repositories, those that are missing left out."""
        parts = [self.read(table, r).withColumn("repo", F.lit(r)) for r in repos if self._exists(self._at(table, r))]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMAS[table]).withColumn("repo", F.lit(""))
