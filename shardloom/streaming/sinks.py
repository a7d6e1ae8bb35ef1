"""Micro-batch output that a replay rewrites instead of repeating."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def start(stream: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
          available_now: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Run a stream into ``write_batch``; ``available_now`` ends it after the data that is there."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def finish(query: StreamingQuery) -> None:
    """Wait for an ``available_now`` run and raise what it raised."""
    query.awaitTermination()
    error = query.exception()
    if error is not None:
        raise error


def versions(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch's updated rows under a folder of the batch's number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of every key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "version"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("_row"))
    return newest.select(*keys, "_row.*")
