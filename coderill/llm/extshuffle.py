"""Two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash of the record, its input partition and
its number among the equal records there, so copies of one record part like any others; pass 2 puts each bucket into a
canonical order and shuffles it by Fisher-Yates. Bucket after bucket, the result is one uniform permutation of the input. It
is the same for the same input partitions and seed: neither the order in which blocks arrive nor a repeated task changes it,
since the numbers of equal records are a set whatever order they come in.

Buckets take BUCKET_BYTES, or more where tasks have more memory. Beyond MOST_BUCKETS, records are first scattered into groups
of buckets, written to the shared folder, and each group is scattered on its own; so no shuffle has more than MOST_BUCKETS
outputs.

Defined cases: null ids and null texts are ordinary values and hash as such. Exactly equal rows are all kept; which of them
stands where is not observable. An empty table gives an empty result. Texts of any length stay whole. Columns of any other
name pass through; where ``shard`` or ``position`` exist already, the new ones get underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, columns, free_name, in_arrow, materialise, with_columns, workers_see_package

#: Bytes of a bucket, at least and at most; a task holds one bucket, and about twice as much while it permutes.
BUCKET_BYTES, MOST_BUCKET_BYTES = 32 << 20, 1 << 30
#: Buckets of one shuffle.
MOST_BUCKETS = 10_000
_UNITS = {"": 1 << 20, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1."""
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(np.arange(n, 1, -1)).tolist() if n > 1 else (), strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def payload_bytes(df: DataFrame) -> int:
    """Bytes in all string and binary columns, and 8 for each other one."""
    size = F.lit(0)
    for f in df.schema.fields:
        text = isinstance(f.dataType, (T.StringType, T.BinaryType))
        size = size + (F.coalesce(F.octet_length(column(f.name)), F.lit(0)) if text else F.lit(8))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def memory_of_task(spark: SparkSession) -> int:
    """Bytes of an executor's heap for each of its cores."""
    said = spark.conf.get("spark.executor.memory", "1g").lower().removesuffix("b")
    number = said.rstrip("kmgt")
    return int(number) * _UNITS[said[len(number) :]] // max(1, int(spark.conf.get("spark.executor.cores", "1")))


def plan(total_bytes: int, task_bytes: int, bucket_bytes: int | None = None, most: int = MOST_BUCKETS) -> tuple[int, int]:
    """(groups, buckets of each) for so many bytes, when a task has so much memory."""
    each = bucket_bytes or min(MOST_BUCKET_BYTES, max(BUCKET_BYTES, task_bytes // 32))
    n = max(1, -(-total_bytes // each))
    groups = -(-n // most)
    return groups, -(-n // groups)


def row_hash(df: DataFrame, seed: int):
    """Seeded 64-bit hash of all columns that can be hashed."""
    able = [column(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(F.lit(seed), *able)


def numbered(df: DataFrame, h: str, number: str) -> DataFrame:
    """``df`` with how many rows of its partition with the same ``h`` came before each."""
    at = df.columns.index(h)
    schema = with_columns(df.schema, **{number: T.LongType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            kinds, back, many = np.unique(b.column(at).to_numpy(), return_inverse=True, return_counts=True)
            names = kinds.tolist()
            before = np.array([seen.get(k, 0) for k in names], np.int64)
            for k, n, m in zip(names, before.tolist(), many.tolist(), strict=True):
                seen[k] = n + m
            order = np.argsort(back, kind="stable")
            rank = np.empty(len(back), np.int64)
            rank[order] = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before[back] + rank)], names=schema.names)

    return in_arrow(df, run, schema)


def external_shuffle(df: DataFrame, seed: int = 17, bucket_bytes: int | None = None, most: int = MOST_BUCKETS) -> DataFrame:
    """The columns of ``df`` with ``shard`` (the bucket) and ``position`` in it, from 0."""
    spark, names = df.sparkSession, df.columns
    workers_see_package(spark)
    shard, position, h, number = (free_name(names, x) for x in ("shard", "position", "row_hash", "row_number"))
    groups, each = plan(payload_bytes(df), memory_of_task(spark), bucket_bytes, most)
    keyed = numbered(df.withColumn(h, row_hash(df, seed)), h, number)
    keyed = keyed.withColumn(h, F.xxhash64(F.lit(seed), column(h), F.spark_partition_id(), column(number))).drop(column(number))
    schema = with_columns(df.schema, **{shard: T.IntegerType(), position: T.LongType()})
    # group, bucket and order within it take bits of their own
    part = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed ^ salt), column(h)), F.lit(n)).cast("int")
    if groups > 1:
        group = free_name(names, "bucket_group")
        keyed = keyed.withColumn(group, part(0x5EED, groups)).repartition(min(most, groups * each), column(group), part(0xA17, each))
        keyed = materialise(keyed, "scattered", lasting=True)
        pieces = [(k, keyed.where(column(group) == k).drop(column(group))) for k in range(groups)]
    else:
        pieces = [(0, keyed)]

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        # the hash comes last, the bucket before it
        first = pc.sort_indices(table.column(table.num_columns - 1).combine_chunks())
        at = table.column(table.num_columns - 2)[0].as_py()
        perm = first.take(pa.array(fisher_yates(len(first), np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, at])))))
        table = table.select(range(table.num_columns - 1))
        for lo in range(0, len(perm), 2048):
            for b in table.take(perm.slice(lo, 2048)).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(lo, lo + b.num_rows), pa.int64())], names=schema.names)

    def shuffled(k: int, rows: DataFrame) -> DataFrame:
        # each task holds one bucket
        own = rows.withColumn(shard, part(0xB0B, each)).repartitionById(each, column(shard))
        return in_arrow(own.select(*columns(names), (column(shard) + F.lit(k * each)).alias(shard), h), permute, schema)

    return reduce(DataFrame.unionAll, (shuffled(k, rows) for k, rows in pieces))


def write_shards(shuffled: DataFrame, path: str, shard: str = "shard") -> None:
    """One Parquet file a bucket, rows in shuffled order, under ``path/shard=N/``."""
    shuffled.write.mode("overwrite").partitionBy(shard).parquet(path)
