"""Measurements of runs: resource series, epochs, stages, and the sweep over configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shardloom.functions.formatting import fixed, fixed_or_missing, mb_to_gb, table_row

AXES = ["dataset", "num_workers", "prefetch_factor", "batch_size"]
RESULT_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("num_workers", T.LongType()),
    T.StructField("prefetch_factor", T.LongType()),
    T.StructField("batch_size", T.LongType()),
    T.StructField("throughput", T.DoubleType()),
    T.StructField("ttfb", T.DoubleType()),
    T.StructField("status", T.StringType()),
])
MIB = 1024 * 1024


def resource_series(samples: DataFrame, tick: Column, cpus: int, total_bytes: int) -> DataFrame:
    """One row per monitored name and tick: memory and CPU summed over processes, CPU capped at all cores.

    ``samples``: name, ts (double seconds), rss_bytes, cpu_percent. Ticks need not be evenly spaced.
    """
    per_tick = samples.withColumn("tick", tick).groupBy("name", "tick").agg(
        F.min("ts").alias("ts"), F.sum("rss_bytes").alias("rss_bytes"), F.sum("cpu_percent").alias("_cpu"))
    starts = samples.groupBy("name").agg(F.min("ts").alias("start"))
    return per_tick.join(starts, "name").select(
        "name", "tick", (F.col("ts") - F.col("start")).alias("seconds"),
        (F.col("rss_bytes") / MIB).alias("ram_mb"), ram_percent(F.col("rss_bytes"), total_bytes).alias("ram_percent"),
        F.least(F.col("_cpu"), F.lit(100.0 * cpus)).alias("cpu_percent"))


def ram_percent(rss_bytes: Column, total_bytes: int) -> Column:
    return rss_bytes / F.lit(total_bytes) * 100


def peak_ram(series: DataFrame) -> DataFrame:
    return series.groupBy("name").agg(F.max("ram_mb").alias("peak_ram_mb"))


def running_peak(series: DataFrame, span: str | Column, order: str = "tick") -> DataFrame:
    """Peak so far at every tick. ``span`` cuts each name's ticks into ordered spans: peaks of earlier spans
    come from their maxima, so a long series of one name is not sorted in one task."""
    spans = series.withColumn("_span", F.col(span) if isinstance(span, str) else span)
    maxima = spans.groupBy("name", "_span").agg(F.max("ram_mb").alias("_max"))
    before = Window.partitionBy("name").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = maxima.select("name", "_span", F.max("_max").over(before).alias("_earlier"))
    inside = Window.partitionBy("name", "_span").orderBy(order).rowsBetween(Window.unboundedPreceding,
                                                                            Window.currentRow)
    return (spans.join(earlier, ["name", "_span"])
            .withColumn("peak_so_far", F.greatest(F.max("ram_mb").over(inside), F.col("_earlier")))
            .drop("_span", "_earlier"))


def epoch_throughput(batches: DataFrame, starts: DataFrame) -> DataFrame:
    """Samples, elapsed seconds and rate of each epoch. ``batches``: run, epoch, ts (seconds), samples; ``starts``:
    run, epoch, start_ts, taken before the first batch is fetched, so that batch's time counts like its rows."""
    ends = batches.groupBy("run", "epoch").agg(
        F.sum("samples").cast("long").alias("samples"), F.max("ts").alias("_last"))
    per_epoch = ends.join(starts, ["run", "epoch"], "left").select(
        "run", "epoch", "samples", (F.col("_last") - F.col("start_ts")).alias("elapsed_s"))
    # An epoch that took no time, or whose start is unknown, has no rate.
    return per_epoch.withColumn("throughput", F.when(F.col("elapsed_s") > 0, F.col("samples") / F.col("elapsed_s")))


def second_epoch_throughput(per_epoch: DataFrame, zero: float = 0.0) -> DataFrame:
    """The headline rate: the second epoch's, 0 for runs that stopped before it."""
    return per_epoch.groupBy("run").agg(
        F.coalesce(F.max(F.when(F.col("epoch") == 2, F.col("throughput"))), F.lit(zero)).alias("throughput"))


def time_to_first_batch(batches: DataFrame, starts: DataFrame) -> DataFrame:
    """First completed batch of the first epoch, from the run's start."""
    first = batches.filter("epoch = 1").groupBy("run").agg(F.min("ts").alias("first_ts"))
    return first.join(starts, "run").select("run", (F.col("first_ts") - F.col("start_ts")).alias("ttfb"))


def run_totals(batches: DataFrame, starts: DataFrame) -> DataFrame:
    """Samples and wall time of each run, from its start (``starts``: run, start_ts) to its last batch."""
    ends = batches.groupBy("run").agg(F.sum("samples").cast("long").alias("samples"), F.max("ts").alias("_last"))
    return ends.join(starts, "run", "left").select(
        "run", "samples", (F.col("_last") - F.col("start_ts")).alias("wall_s"))


def combine_stages(stages: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Two stages of a run as one: times add, peak memory is the larger."""
    return stages.filter(F.col("stage").isin(first, second)).groupBy("run").agg(
        F.lit(name).alias("stage"), F.sum("time_s").alias("time_s"), F.sum("write_s").alias("write_s"),
        F.max("peak_ram_mb").alias("peak_ram_mb"))


def worker_sweep(results: DataFrame, worker_counts: list[int]) -> DataFrame:
    """Formats by worker counts, one text cell of time, write time and peak memory each."""
    cell = F.concat_ws(" / ", fixed(F.avg("time_s")), fixed(F.avg("write_s")),
                       fixed_or_missing(F.max("peak_ram_mb")))
    table = results.groupBy("format").pivot("workers", worker_counts).agg(cell)
    return table.select("format", *[F.col(str(w)).alias(f"workers_{w}") for w in worker_counts])


def throughput_grid(results: DataFrame, workers: list[int] = [4, 8, 16]) -> DataFrame:
    """Mean throughput over prefetch factors, for the plotted worker counts."""
    return (results.filter(F.col("num_workers").isin(workers))
            .groupBy("dataset", "batch_size", "num_workers").agg(F.avg("throughput").alias("throughput")))


def ttfb_by_workers(results: DataFrame) -> DataFrame:
    return results.groupBy("dataset", "num_workers").agg(F.avg("ttfb").alias("ttfb"))


def distinct_axes(results: DataFrame) -> DataFrame:
    return results.select("dataset", "num_workers").distinct()


def sweep_grid(axes: DataFrame) -> DataFrame:
    """Every combination of the axis values. ``axes`` is one row of arrays, as ``axes_of`` gives."""
    grid = axes
    for name in AXES:
        grid = grid.withColumn(name, F.explode(name))
    return grid.select(*AXES)


def axes_of(**values: Column) -> list[Column]:
    return [F.sort_array(F.collect_set(column)).alias(name) for name, column in values.items()]


def sweep_pending(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Configurations still to run: only successful results block a rerun."""
    done = results.filter(F.col("status") == "ok").select(*AXES)
    return grid.join(done, AXES, "left_anti")


def sweep_progress(grid: DataFrame, results: DataFrame) -> DataFrame:
    done = results.filter(F.col("status") == "ok").select(*AXES).distinct().withColumn("_done", F.lit(1))
    return grid.join(done, AXES, "left").agg(
        F.count("_done").alias("completed"), F.count(F.lit(1)).alias("total"),
        (F.count("_done") / F.count(F.lit(1)) * 100).alias("percent"))


def read_results(spark, path: str) -> DataFrame:
    """Sweep results CSV, appended to by many runs: headers may repeat, a line of fewer than five fields is
    dropped, a number that does not parse becomes null. Without a status, a run that measured nothing failed."""
    fields = [*AXES, "throughput", "ttfb", "status"]
    # A field is what commas outside of quotes part; the writer escapes quotes with a backslash.
    bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*"', "")
    lines = spark.read.text(path).filter(F.size(F.split(bare, ",")) >= 5)
    parts = lines.select(F.from_csv(F.trim("value"), ", ".join(f"{f} string" for f in fields)).alias("p")).select("p.*")
    parts = parts.filter(~F.col("dataset").eqNullSafe("dataset"))
    throughput = F.col("throughput").try_cast("double")
    return parts.select(
        "dataset", *[F.col(name).try_cast("long").alias(name) for name in AXES[1:]], throughput.alias("throughput"),
        F.col("ttfb").try_cast("double").alias("ttfb"),
        F.coalesce("status", F.when(throughput > 0, "ok").otherwise("failed")).alias("status"))


def append_results(results: DataFrame, path: str) -> None:
    """Add rows in the column order of the table; every file starts with the header."""
    ordered = results.select(*AXES, "throughput", F.col("ttfb").alias("TTFB"), "status")
    ordered.write.mode("append").option("header", "true").csv(path)


def union_formats(**tables: DataFrame) -> DataFrame:
    """Results of several formats in one table, tagged by format; columns one lacks are null."""
    gathered = None
    for name, table in tables.items():
        tagged = table.withColumn("format", F.lit(name))
        gathered = tagged if gathered is None else gathered.unionByName(tagged, allowMissingColumns=True)
    return gathered


def stream_report_rows(results: DataFrame) -> DataFrame:
    """Summary table lines of loading runs: name, samples a second, seconds to the first batch, samples, wall seconds."""
    return results.withColumn("line", table_row(
        F.col("name"), fixed(F.col("throughput")), fixed(F.col("ttfb")), F.col("samples").cast("string"),
        fixed(F.col("wall_s"))))


def report_rows(results: DataFrame) -> DataFrame:
    """Summary table lines: name, times in seconds, size in GB, files and peak memory."""
    return results.withColumn("line", table_row(
        F.col("name"), fixed(F.col("time_s")), fixed(F.col("write_s")), mb_to_gb(F.col("size_mb")),
        F.col("n_files").cast("string"), fixed_or_missing(F.col("peak_ram_mb"))))
