"""How many tasks a table is worth, and joins whose tasks stay small whatever the session's number of partitions is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Bytes of files for each of which there is a task (of the driver's lines, some 300,000 rows); small tables get more tasks, as
#: far as there are cores.
TASK_BYTES, LEAST_BYTES = 4 << 20, 1 << 20
#: Files of a table that may be broadcast by Spark's estimate, which takes bytes of files for bytes of rows.
BROADCAST_BYTES = 8 << 20


def file_bytes(*tables: DataFrame) -> int | None:
    """Bytes of what the tables are read from; None where that is not known (of rows from the driver or from RDDs)."""
    total = 0
    for df in tables:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves().iterator()
        while leaves.hasNext():
            total += int(str(leaves.next().stats().sizeInBytes()))
    return total if total < 1 << 60 else None


def tasks(*tables: DataFrame) -> int:
    """Tasks for what is made of the tables; the session's number of partitions where their size is not known."""
    size, spark = file_bytes(*tables), tables[0].sparkSession
    if size is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 + max(size // TASK_BYTES, min(size // LEAST_BYTES, spark.sparkContext.defaultParallelism - 1))


def meet(left: DataFrame, right: DataFrame, on: str | list[str], n: int, how: str = "inner") -> DataFrame:
    """A join in ``n`` tasks. Nothing is broadcast: what is exploded, or read from small files, is larger than it looks."""
    on = [on] if isinstance(on, str) else on
    return left.repartition(n, *on).join(right.repartition(n, *on).hint("merge"), on, how)


def sorted_in(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """All rows in order, sorted by up to ``n`` tasks."""
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)
