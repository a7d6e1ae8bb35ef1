"""Streaming queries, run over what is there and read back as tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F, types as T

from shardloom.functions.text_metrics import line_metrics
from shardloom.plans import fixtures as fx
from shardloom.plans.catalog_runs import SQL_LOG_FILES
from shardloom.plans.prepare import read_shards
from shardloom.plans.registry import query
from shardloom.session import fresh_dir
from shardloom.sources.loglines import growing_lines
from shardloom.streaming.ingest import arriving, shard_batches
from shardloom.streaming.metrics import resource_windows, running_peak
from shardloom.streaming.sinks import finish, latest, start, versions

EPOCH_2024 = 1_704_067_200_000_000


def resource_stream(spark, sf_dir):
    """events as memory samples; cents make exact sums."""
    schema = fx.table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return rows.select(F.col("event_type").alias("name"), F.timestamp_micros(micros + EPOCH_2024).alias("event_time"),
                       F.round(F.col("value") * 100).cast("long").alias("ram_mb"))


@query("stream_resource_windows", f"""WITH {fx.SQL_EVENTS}
SELECT event_type AS name, micros // 86400000000 * 86400000000 + {EPOCH_2024} AS window_start, count(*) AS n_samples,
       max(cents) AS peak_ram_mb, sum(cents)::BIGINT / count(*)::DOUBLE AS mean_ram_mb FROM ev GROUP BY 1, 2""")
def stream_resource_windows(spark, sf_dir):
    path, checkpoint = fresh_dir(spark, "windows"), fresh_dir(spark, "windows-state")
    windows = resource_windows(resource_stream(spark, sf_dir), "1 day", "1 hour")
    finish(start(windows, versions(path), checkpoint, "update", available_now=True))
    return latest(spark, path, ["name", "window_start"])


@query("stream_running_peak", f"WITH {fx.SQL_EVENTS} SELECT event_type AS name, max(cents) AS peak_ram_mb FROM ev GROUP BY 1")
def stream_running_peak(spark, sf_dir):
    path, checkpoint = fresh_dir(spark, "peaks"), fresh_dir(spark, "peaks-state")
    finish(start(running_peak(resource_stream(spark, sf_dir)), versions(path), checkpoint, "update", available_now=True))
    return latest(spark, path, ["name"])


PART_BYTES = 64 << 20


@query("stream_ingest_counts", f"""WITH {fx.SQL_SAMPLES}
SELECT text, count(*) AS n_samples, sum(image_bytes)::BIGINT AS n_bytes FROM samples GROUP BY text""")
def stream_ingest_counts(spark, sf_dir):
    """Parts arrive one or two a batch; every batch leaves a tar set, and the sets read as one. A part of more than ``PART_BYTES``
    is several files."""
    parts, path, checkpoint = (fresh_dir(spark, label) for label in ("parts", "ingested", "ingest-state"))
    rows = fx.samples(spark, sf_dir)
    payload = rows.agg(F.sum(F.octet_length("image"))).first()[0] or 0
    files = max(1, math.ceil(payload / (3 * PART_BYTES)))
    rows.repartition(3 * files, "sample_id").write.parquet(parts)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    stream = arriving(spark, parts, schema, files_per_batch=2 * files)
    finish(start(stream, shard_batches(path, fx.TAR_BYTES, fx.TAR_ROWS, fx.SEED, least_bytes=0),
                 checkpoint,
                 available_now=True))
    written = read_shards(spark, "tarshards", path)
    return written.groupBy(F.decode("txt", "UTF-8").alias("text")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.octet_length("jpg")).alias("n_bytes"))


@query("stream_log_files", SQL_LOG_FILES)
def stream_log_files(spark, sf_dir):
    """Logs that grow: their first third, cut anywhere, then two thirds, then all, each by a run from the same checkpoint."""
    logs, path, checkpoint = (fresh_dir(spark, label) for label in ("logs", "log-metrics", "log-state"))
    for share in (1 / 3, 2 / 3, 1.0):
        fx.write_log_files(spark, sf_dir, logs, share)
        metrics = line_metrics(growing_lines(spark, logs))
        finish(start(metrics, versions(path), checkpoint, "update", available_now=True))
    return latest(spark, path, ["file"])
