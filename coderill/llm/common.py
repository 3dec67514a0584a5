"""What the operators of this package share: materialised tables, checked broadcasts and Arrow batches."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only up to so many bytes; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Texts are handed to the numpy kernels in slices of about so many bytes, whole texts only.
SLICE_BYTES = 1 << 19


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package where neither an installation nor PYTHONPATH does."""
    root = str(Path(__file__).resolve().parents[2])
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env = spark.sparkContext.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a session whose tasks run in this very process's machine, as in tests, gets a temporary one where it is unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="coderill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/coderill/{spark.sparkContext.applicationId}"
    if path not in _ends_with_driver:
        _ends_with_driver.add(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


_ends_with_driver: set[str] = set()
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside, but for the ``lasting`` ones, are deleted at the end."""
    made: list[str] = []
    before = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(before)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage and survives the loss of executors; the sizes of what follows are then known to the planner.
    """
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = _scratch.get()
    if made is not None and not lasting:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(uri: str):
    """File system and path of a folder or file; local ones may be given as plain paths."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name; ``run`` takes them by position."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


def column(name: str):
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(names: list[str]) -> list:
    return [column(x) for x in names]


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` of ``row_bytes`` stay under ``limit``, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def with_columns(schema: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in more.items())])


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column (in any case) has the name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of whole texts of about ``size`` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    lo = 0
    while lo < n:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield lo, hi
        lo = hi


def partitions_for(spark: SparkSession, total_bytes: int, each: int) -> int:
    return max(1, math.ceil(total_bytes / max(1, each)))
