"""Resource samples as a stream: name, event_time, ram (MB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def resource_windows(samples: DataFrame, width: str, late: str) -> DataFrame:
    """Peak and mean memory per name and window. Samples later than ``late`` no longer change their window."""
    return (samples.withWatermark("event_time", late)
            .groupBy("name", F.window("event_time", width).alias("window"))
            .agg(F.count(F.lit(1)).alias("n_samples"), F.max("ram_mb").alias("peak_ram_mb"),
                 F.sum("ram_mb").alias("_sum"))
            .select("name", F.unix_micros("window.start").alias("window_start"), "n_samples", "peak_ram_mb",
                    (F.col("_sum") / F.col("n_samples")).alias("mean_ram_mb")))


def running_peak(samples: DataFrame) -> DataFrame:
    """Peak so far per name: one number of state a name, however long the stream."""
    return samples.groupBy("name").agg(F.max("ram_mb").alias("peak_ram_mb"))
