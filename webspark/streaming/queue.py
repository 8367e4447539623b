"""The work queue as a stream: state by row, replayed changes and retries harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which status a later change may replace; a row that is done or failed stays so.
FINAL = ("done", "failed")


def merge_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, status, seq): the state of each row after more changes. A change with a sequence number
    not above the one known, or to a row that is final, does nothing, so a batch that comes twice
    changes nothing. Both inputs: id, status, seq."""
    both = state.select("id", "status", "seq").unionByName(changes.select("id", "status", "seq"))
    final = F.col("status").isin(*FINAL)
    first_final = F.min_by("status", F.when(final, F.col("seq")))
    grouped = both.groupBy("id").agg(first_final.alias("ended"), F.min(F.when(final, F.col("seq"))).alias("at"), F.max_by("status", "seq").alias("last"), F.max("seq").alias("top"))
    return grouped.select("id", F.coalesce("ended", "last").alias("status"), F.coalesce("at", "top").alias("seq"))


def run_queue(spark: SparkSession, changes: DataFrame, state_path: str, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None):
    """A streaming query that keeps the state of the queue as files under ``state_path``.

    Each micro-batch reads the last version, merges its changes and writes the next version, numbered
    by the batch: a batch that is run again after a failure writes the same version again.
    """
    schema = "id bigint, status string, seq bigint"

    def step(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(schema).parquet(f"{state_path}/v={number - 1}") if number > 0 else spark.createDataFrame([], schema)
        merge_changes(old, batch).write.mode("overwrite").parquet(f"{state_path}/v={number}")
        if on_batch:
            on_batch(spark.read.schema(schema).parquet(f"{state_path}/v={number}"))

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
