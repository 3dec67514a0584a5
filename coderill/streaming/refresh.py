"""An extension of ours: churn kept up to date as commits land in a folder.

Every micro-batch of file changes is summed by file and month and appended under its batch number, so that a batch that is
tried again replaces itself; ``current`` adds the sums up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coderill.functions.scalars import month

CHANGE = "commit_id bigint, file_path string, lines_added bigint, lines_deleted bigint, change_type string, timestamp timestamp"


def start(spark: SparkSession, landing: str, store: str, checkpoint: str) -> StreamingQuery:
    """Take all that is in the landing folder, batch by batch, then stop."""

    def merge(batch: DataFrame, number: int) -> None:
        by = batch.where("change_type <> 'D'").groupBy("file_path", month(F.col("timestamp")).alias("month"))
        by.agg(F.count(F.lit(1)).alias("changes"), F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("churn")).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return spark.readStream.schema(CHANGE).parquet(landing).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).groupBy("file_path", "month").agg(F.sum("changes").alias("changes"), F.sum("churn").alias("churn"))
