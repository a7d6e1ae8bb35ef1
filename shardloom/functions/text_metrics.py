"""Metrics out of run logs: one log text per row, all regex work JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The wording of the run logs.
THROUGHPUT = (r"Average throughput: ([0-9.]+) images/sec", r"([0-9.]+) images/sec")
SAMPLES = (r"Total samples: ([0-9]+)", r"Processed ([0-9]+) samples")
ELAPSED = (r"Total time: ([0-9.]+)s", r"Processed .* in ([0-9.]+)s")
FIRST_BATCH = r"Time to first batch: ([0-9.]+)s"
EPOCH_LINE = r"Epoch ([0-9]+): Processed [0-9]+ samples in ([0-9.]+)s"
WRITE_TIME = r"Dataset write time:\s*([0-9.]+)"
TOTAL_TIME = r"Total script time:\s*([0-9.]+)"


def at_line_start(pattern: str) -> str:
    """Only at the start of a line, so a longer label that contains this one does not match."""
    return rf"(?m)^\s*{pattern}"


def first_match(log: Column, pattern: str, default: str = "0") -> Column:
    # regexp_extract gives "" both for no match and for an empty group; none of the groups here can be empty.
    return F.coalesce(F.nullif(F.regexp_extract(log, pattern, 1), F.lit("")), F.lit(default))


def last_match(log: Column, primary: str, fallback: str, default: str = "0") -> Column:
    """First match of the primary pattern, else the last match of the fallback."""
    found = F.nullif(F.regexp_extract(log, primary, 1), F.lit(""))
    # A reported "0" counts as not reported.
    found = F.nullif(found, F.lit("0"))
    return F.coalesce(found, F.try_element_at(F.regexp_extract_all(log, F.lit(fallback), 1), F.lit(-1)),
                      F.lit(default))


def epoch_times(log: Column) -> Column:
    """Map of epoch number to its time; of an epoch reported twice the later line counts."""
    numbers = F.regexp_extract_all(log, F.lit(EPOCH_LINE), 1)
    times = F.regexp_extract_all(log, F.lit(EPOCH_LINE), 2)
    pairs = F.zip_with(numbers, times, lambda n, t: F.struct(n.cast("int").alias("key"),
                                                             t.try_cast("double").alias("value")))
    latest = F.filter(
        F.transform(pairs, lambda p, i: F.struct(
            p["key"].alias("key"), p["value"].alias("value"),
            F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == p["key"]).alias("repeated"))),
        lambda p: ~p["repeated"])
    return F.map_from_entries(F.transform(latest, lambda p: F.struct(p["key"], p["value"])))


def epoch_time(log: Column, epoch: int) -> Column:
    """One entry of ``epoch_times``, 0 if the log has none, without building the map."""
    line = EPOCH_LINE.replace("([0-9]+)", str(epoch), 1)
    return F.coalesce(F.try_element_at(F.regexp_extract_all(log, F.lit(line), 1), F.lit(-1)).try_cast("double"),
                      F.lit(0.0))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Every log file as one row: file, log."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("log"))


def log_metrics(logs: DataFrame, log: str = "log") -> DataFrame:
    """The typed metrics row of every run log."""
    text = F.col(log)
    return logs.select(
        *[c for c in logs.columns if c != log],
        last_match(text, *THROUGHPUT).try_cast("double").alias("throughput"),
        last_match(text, *SAMPLES).try_cast("long").alias("samples"),
        last_match(text, *ELAPSED).try_cast("double").alias("elapsed_s"),
        first_match(text, FIRST_BATCH).try_cast("double").alias("time_to_first_batch"),
        epoch_time(text, 1).alias("epoch1_s"),
        epoch_time(text, 2).alias("epoch2_s"),
    )


def line_metrics(lines: DataFrame) -> DataFrame:
    """``log_metrics`` of logs that come as (file, start, line), as a table or as a stream.

    No pattern reaches over a line end, so the first and the last match of a log are those of its first and last line with
    one. State is one row a file, however long its log, and tasks add up their own lines before any shuffle.
    """
    line, start = F.col("line"), F.col("start")

    def first(pattern):
        found = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
        return F.min_by(found, F.when(found.isNotNull(), start))

    def last(pattern):
        found = F.try_element_at(F.regexp_extract_all(line, F.lit(pattern), 1), F.lit(-1))
        return F.max_by(found, F.when(found.isNotNull(), start))

    pairs = {"throughput": (THROUGHPUT, "double"), "samples": (SAMPLES, "long"), "elapsed_s": (ELAPSED, "double")}
    epochs = {f"epoch{n}_s": EPOCH_LINE.replace("([0-9]+)", str(n), 1) for n in (1, 2)}
    found = lines.groupBy("file").agg(
        *[first(patterns[0]).alias(f"first_{name}") for name, (patterns, _) in pairs.items()],
        *[last(patterns[1]).alias(f"last_{name}") for name, (patterns, _) in pairs.items()],
        first(FIRST_BATCH).alias("first_batch"), *[last(pattern).alias(name) for name, pattern in epochs.items()])
    return found.select(
        "file",
        *[F.coalesce(F.nullif(f"first_{name}", F.lit("0")), f"last_{name}", F.lit("0")).try_cast(kind).alias(name)
          for name, (_, kind) in pairs.items()],
        F.coalesce("first_batch", F.lit("0")).try_cast("double").alias("time_to_first_batch"),
        *[F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).alias(name) for name in epochs])
