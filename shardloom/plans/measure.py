"""Measured runs: prepare and load jobs as rows of a results table, and the sweep that resumes.

The clock stands around Spark actions that consume every row. Loader workers are the partitions of a load;
prefetching is Spark's own, so that axis is recorded and changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from shardloom.operators import runs
from shardloom.operators.loading import fixed_batch
from shardloom.operators.ordering import shuffle_through_buffer
from shardloom.plans.prepare import read_shards
from shardloom.session import exists
from shardloom.sources.listing import dir_stats

EPOCHS_SCHEMA = "run string, epoch long, samples long, elapsed_s double, throughput double"


def load_epoch(spark: SparkSession, source: str, path: str, batch_size: int, workers: int, epoch: int,
               seed: int = 42, shuffle_buffer: int = 100,
               transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One epoch as a loader delivers it: shards in the epoch's order, dealt to workers, a shuffle buffer per shard, batches.

    Adds ``batch`` and ``slot`` of the worker; ``transform`` runs on the samples before they are batched and keeps what it is
    not about. All of it depends on seed, epoch and the shard list, not on how tasks run.
    """
    rows = read_shards(spark, source, path, epoch=str(epoch), seed=str(seed), workers=str(workers))
    shuffled = shuffle_through_buffer(rows, shuffle_buffer, seed, epoch, within="shard")
    place = F.col("place") - F.col("arrived") + F.col("emitted")
    placed = shuffled.withColumns({"batch": fixed_batch(place, batch_size), "slot": F.pmod(place, F.lit(batch_size))})
    return placed if transform is None else transform(placed)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def measure_load(spark: SparkSession, name: str, source: str, path: str, batch_size: int = 256, workers: int = 8,
                 n_epochs: int = 2, **options) -> tuple[DataFrame, float]:
    """Per-epoch rows of one run, and its time to first batch: one batch of one worker, and nothing after it."""
    start = time.perf_counter()
    load_epoch(spark, source, path, batch_size, workers, 1, **options).take(batch_size)
    first = time.perf_counter() - start
    rows = []
    for epoch in range(1, n_epochs + 1):
        start = time.perf_counter()
        seen = Observation()
        rows_of = load_epoch(spark, source, path, batch_size, workers, epoch, **options)
        drain(rows_of.observe(seen, F.count(F.lit(1)).alias("samples")))
        elapsed = time.perf_counter() - start
        samples = seen.get["samples"]
        rows.append((name, epoch, samples, elapsed, samples / elapsed))
    return spark.createDataFrame(rows, EPOCHS_SCHEMA), first


def measure_prepare(spark: SparkSession, name: str, write: Callable[[], str]) -> DataFrame:
    """One preparation as a report row: seconds, size and files. Memory is in Spark's own metrics."""
    start = time.perf_counter()
    path = write()
    elapsed = time.perf_counter() - start
    return dir_stats(spark, path).select(
        F.lit(name).alias("name"), F.lit(elapsed).alias("time_s"), F.lit(elapsed).alias("write_s"),
        "size_mb", "n_files", F.lit(None).cast("double").alias("peak_ram_mb"))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """Results so far; an empty table before the first."""
    if not exists(spark, path):
        return spark.createDataFrame([], runs.RESULT_SCHEMA)
    return runs.read_results(spark, path)


def run_sweep(spark: SparkSession, sets: dict[str, tuple[str, str]], results: str, workers=(4, 8, 16),
              prefetch=(1, 2, 4), batch_sizes=(128, 256, 512, 1024), **options) -> DataFrame:
    """Measure every configuration that has no successful result yet; ``sets`` maps a name to (source, path).

    A failed run is recorded as failed and tried again by the next sweep.
    """
    axes = spark.createDataFrame(
        [(list(sets), list(workers), list(prefetch), list(batch_sizes))],
        "dataset array<string>, num_workers array<long>, prefetch_factor array<long>, batch_size array<long>")
    pending = runs.sweep_pending(runs.sweep_grid(axes), recorded(spark, results))
    # A sweep has some hundred configurations; each is a job of its own.
    for run in pending.orderBy("batch_size", "num_workers", "prefetch_factor", "dataset").collect():
        source, path = sets[run.dataset]
        try:
            epochs, first = measure_load(spark, run.dataset, source, path, run.batch_size, run.num_workers, **options)
            rate = runs.second_epoch_throughput(epochs).first().throughput
            outcome = (rate, first, "ok")
        except Exception as error:
            print(f"{run.dataset} with {run.num_workers} workers failed: {type(error).__name__}")
            outcome = (0.0, 0.0, "failed")
        row = spark.createDataFrame([(*run, *outcome)], runs.RESULT_SCHEMA)
        runs.append_results(row, results)
    return recorded(spark, results)
