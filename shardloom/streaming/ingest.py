"""New parquet parts become shards as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from shardloom.plans.prepare import write_tar


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").parquet(path))


def shard_batches(path: str, max_bytes: int, max_rows: int, seed: int = 42, prefix: str = "dataset",
                  digits: int | None = None, least_bytes: int = 10_000_000) -> Callable[[DataFrame, int], None]:
    """Writer of one tar set per micro-batch: a replayed batch overwrites its own set."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write_tar(batch, f"{path}/batch-{batch_id:06d}", max_bytes, max_rows, seed,
                      prefix=f"{prefix}-{batch_id:06d}", digits=digits, least_bytes=least_bytes)
    return write
