"""Queries over logs, resource samples, runs and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions.text_metrics import (
    SAMPLES,
    THROUGHPUT,
    WRITE_TIME,
    at_line_start,
    epoch_time,
    epoch_times,
    first_match,
    last_match,
    line_metrics,
    log_metrics,
)
from shardloom.operators import runs
from shardloom.plans import fixtures as fx
from shardloom.plans.registry import query
from shardloom.session import fresh_dir
from shardloom.sources.listing import dir_stats
from shardloom.sources.loglines import log_lines

CPUS, MEMORY = 16, 64 * 1024**3


# A label without an anchor also matches inside longer labels that come earlier: both readings, side by side.
@query("log_first_match", f"""WITH {fx.SQL_STAGE_LOGS}
SELECT o_orderkey, regexp_extract(log, 'Dataset write time:\\s*([0-9.]+)', 1) AS anywhere,
       regexp_extract(log, '(?m)^\\s*Dataset write time:\\s*([0-9.]+)', 1) AS at_line_start, '0' AS absent
FROM stage_logs""")
def log_first_match(spark, sf_dir):
    log = F.col("log")
    return fx.stage_logs(spark, sf_dir).select(
        "o_orderkey", first_match(log, WRITE_TIME).alias("anywhere"),
        first_match(log, at_line_start(WRITE_TIME)).alias("at_line_start"),
        first_match(log, r"Index write time:\s*([0-9.]+)").alias("absent"))


def _sql_last(primary: str, fallback: str) -> str:
    return f"""coalesce(nullif(nullif(regexp_extract(log, '{primary}', 1), ''), '0'),
  regexp_extract_all(log, '{fallback}', 1)[-1], '0')"""


@query("log_last_match", f"""WITH {fx.SQL_LOGS}
SELECT event_id, {_sql_last(*THROUGHPUT)} AS throughput, {_sql_last(*SAMPLES)} AS samples FROM logs""")
def log_last_match(spark, sf_dir):
    log = F.col("log")
    return fx.run_logs(spark, sf_dir).select(
        "event_id", last_match(log, *THROUGHPUT).alias("throughput"), last_match(log, *SAMPLES).alias("samples"))


SQL_EPOCH_TIME = """coalesce(list_extract(list_filter(list_transform(
  regexp_extract_all(log, 'Epoch [0-9]+: Processed [0-9]+ samples in [0-9.]+s'),
  lambda l: CASE WHEN starts_with(l, 'Epoch {n}:') THEN regexp_extract(l, 'in ([0-9.]+)s', 1)::DOUBLE END),
  lambda t: t IS NOT NULL), -1), 0.0::DOUBLE)"""


@query("log_epoch_times", f"""WITH {fx.SQL_LOGS}
SELECT event_id, {SQL_EPOCH_TIME.format(n=1)} AS epoch1_s, {SQL_EPOCH_TIME.format(n=2)} AS epoch2_s,
       len(list_distinct(regexp_extract_all(log, 'Epoch ([0-9]+): Processed', 1)))::BIGINT AS n_epochs
FROM logs""")
def log_epoch_times(spark, sf_dir):
    log = F.col("log")
    return fx.run_logs(spark, sf_dir).select(
        "event_id", epoch_time(log, 1).alias("epoch1_s"), epoch_time(log, 2).alias("epoch2_s"),
        F.size(epoch_times(log)).cast("long").alias("n_epochs"))


@query("log_metrics", f"""WITH {fx.SQL_LOGS}
SELECT event_id, {_sql_last(*THROUGHPUT)}::DOUBLE AS throughput, {_sql_last(*SAMPLES)}::BIGINT AS samples,
  coalesce(regexp_extract_all(log, 'Processed [0-9]+ samples in ([0-9.]+)s', 1)[-1], '0')::DOUBLE AS elapsed_s,
  coalesce(nullif(regexp_extract(log, 'Time to first batch: ([0-9.]+)s', 1), ''), '0')::DOUBLE AS time_to_first_batch,
  {SQL_EPOCH_TIME.format(n=1)} AS epoch1_s, {SQL_EPOCH_TIME.format(n=2)} AS epoch2_s
FROM logs""")
def metrics_of_logs(spark, sf_dir):
    return log_metrics(fx.run_logs(spark, sf_dir))


SQL_LOG_FILES = f"""WITH {fx.SQL_LOGS},
files AS (SELECT event_id // {fx.LOGS_PER_FILE} AS run, string_agg(log, '' ORDER BY event_id) AS log FROM logs GROUP BY 1)
SELECT 'run-' || run || '.log' AS file, {_sql_last(*THROUGHPUT)}::DOUBLE AS throughput,
  {_sql_last(*SAMPLES)}::BIGINT AS samples,
  coalesce(regexp_extract_all(log, 'Processed [0-9]+ samples in ([0-9.]+)s', 1)[-1], '0')::DOUBLE AS elapsed_s,
  coalesce(nullif(regexp_extract(log, 'Time to first batch: ([0-9.]+)s', 1), ''), '0')::DOUBLE AS time_to_first_batch,
  {SQL_EPOCH_TIME.format(n=1)} AS epoch1_s, {SQL_EPOCH_TIME.format(n=2)} AS epoch2_s
FROM files"""


@query("log_files", SQL_LOG_FILES)
def log_files(spark, sf_dir):
    """Files of many runs' logs, cut into tasks of 20 kB."""
    path = fresh_dir(spark, "logs")
    fx.write_log_files(spark, sf_dir, path)
    return line_metrics(log_lines(spark, path, bytes_per_task="20000"))


SQL_EPOCHS = fx.SQL_BATCHES + """,
timed AS (SELECT *, ((epoch - 1) * 1296000)::DOUBLE AS start_ts FROM batches),
per_epoch AS (SELECT run, epoch, sum(samples)::BIGINT AS samples, max(ts) - min(start_ts) AS elapsed_s,
  sum(samples) / nullif(max(ts) - min(start_ts), 0) AS throughput FROM timed GROUP BY run, epoch),
totals AS (SELECT run, sum(samples)::BIGINT AS samples, max(ts) - (SELECT min(ts) FROM batches) AS wall_s,
  min(CASE WHEN epoch = 1 THEN ts END) - (SELECT min(ts) FROM batches) AS ttfb FROM batches GROUP BY run),
headline AS (SELECT run, coalesce(max(CASE WHEN epoch = 2 THEN throughput END), 0) AS throughput
  FROM per_epoch GROUP BY run)"""


def rounded(df, *columns, digits=6):
    for name in columns:
        df = df.withColumn(name, F.round(name, digits))
    return df


@query("epoch_throughput", f"""WITH {SQL_EPOCHS}
SELECT run, epoch, samples, round(elapsed_s, 6) AS elapsed_s, round(throughput, 9) AS throughput FROM per_epoch""")
def epoch_throughput(spark, sf_dir):
    per_epoch = runs.epoch_throughput(fx.run_batches(spark, sf_dir), fx.epoch_starts(spark, sf_dir))
    return rounded(rounded(per_epoch, "elapsed_s"), "throughput", digits=9)


@query("second_epoch_throughput", f"""WITH {SQL_EPOCHS}
SELECT run, round(throughput, 9) AS throughput FROM headline""")
def second_epoch_throughput(spark, sf_dir):
    per_epoch = runs.epoch_throughput(fx.run_batches(spark, sf_dir), fx.epoch_starts(spark, sf_dir))
    return rounded(runs.second_epoch_throughput(per_epoch), "throughput", digits=9)


@query("time_to_first_batch", f"""WITH {fx.SQL_BATCHES}
SELECT run, round(min(CASE WHEN epoch = 1 THEN ts END) - (SELECT min(ts) FROM batches), 6) AS ttfb
FROM batches GROUP BY run""")
def time_to_first_batch(spark, sf_dir):
    return rounded(runs.time_to_first_batch(fx.run_batches(spark, sf_dir), fx.run_starts(spark, sf_dir)), "ttfb")


@query("run_totals", f"""WITH {SQL_EPOCHS}
SELECT run, samples, round(wall_s, 6) AS wall_s FROM totals""")
def run_totals(spark, sf_dir):
    return rounded(runs.run_totals(fx.run_batches(spark, sf_dir), fx.run_starts(spark, sf_dir)), "wall_s")


@query("stream_report_rows", f"""WITH {SQL_EPOCHS}
SELECT run AS name, '| ' || run || ' | ' || format('{{:.2f}}', throughput) || ' | ' || format('{{:.2f}}', ttfb) || ' | '
  || samples || ' | ' || format('{{:.2f}}', wall_s) || ' |' AS line
FROM headline JOIN totals USING (run)""")
def stream_report_rows(spark, sf_dir):
    batches, starts = fx.run_batches(spark, sf_dir), fx.run_starts(spark, sf_dir)
    rates = runs.second_epoch_throughput(runs.epoch_throughput(batches, fx.epoch_starts(spark, sf_dir)))
    measured = rates.join(runs.time_to_first_batch(batches, starts), "run").join(runs.run_totals(batches, starts), "run")
    return runs.stream_report_rows(measured.withColumnRenamed("run", "name")).select("name", "line")


@query("dir_stats", f"""WITH f AS (SELECT DISTINCT lang FROM documents) SELECT count(*) AS n_files, TRUE AS has_bytes FROM f""")
def directory_stats(spark, sf_dir):
    path = fresh_dir(spark, "by-language")
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows.repartition("lang").write.partitionBy("lang").option("maxRecordsPerFile", 0).parquet(path)
    stats = dir_stats(spark, f"{path}/lang=*")
    return stats.select("n_files", (F.col("size_mb") > 0).alias("has_bytes"))


SQL_SERIES = fx.SQL_RESOURCES + f""",
series AS (
  SELECT name, hour AS tick, min(ts) AS ts, sum(rss_bytes)::BIGINT AS rss, least(sum(cpu_percent), {100.0 * CPUS}) AS cpu
  FROM resource GROUP BY name, hour),
timed AS (SELECT *, ts - min(ts) OVER (PARTITION BY name) AS seconds, rss / 1048576::DOUBLE AS ram_mb FROM series)"""


def series(spark, sf_dir):
    return runs.resource_series(fx.resource_samples(spark, sf_dir), F.col("hour"), CPUS, MEMORY)


@query("resource_series", f"""WITH {SQL_SERIES}
SELECT name, tick, round(seconds, 6) AS seconds, ram_mb, round(rss / {MEMORY}::DOUBLE * 100, 9) AS ram_percent,
       cpu::DOUBLE AS cpu_percent FROM timed""")
def resource_series(spark, sf_dir):
    return rounded(rounded(series(spark, sf_dir), "seconds"), "ram_percent", digits=9)


@query("ram_percent", f"""WITH {fx.SQL_RESOURCES}
SELECT name, pid, round(sum(rss_bytes)::BIGINT / {MEMORY}::DOUBLE * 100, 9) AS ram_percent FROM resource GROUP BY name, pid""")
def ram_percent(spark, sf_dir):
    held = fx.resource_samples(spark, sf_dir).groupBy("name", "pid").agg(F.sum("rss_bytes").alias("rss_bytes"))
    return rounded(held.select("name", "pid", runs.ram_percent(F.col("rss_bytes"), MEMORY).alias("ram_percent")),
                   "ram_percent", digits=9)


@query("peak_ram", f"WITH {SQL_SERIES} SELECT name, max(ram_mb) AS peak_ram_mb FROM timed GROUP BY name")
def peak_ram(spark, sf_dir):
    return runs.peak_ram(series(spark, sf_dir))


@query("running_peak", f"""WITH {SQL_SERIES}
SELECT name, tick, max(ram_mb) OVER (PARTITION BY name ORDER BY tick) AS peak_so_far FROM timed""")
def running_peak(spark, sf_dir):
    day = F.call_function("div", F.col("tick"), F.lit(24).cast("long"))
    return runs.running_peak(series(spark, sf_dir), day).select("name", "tick", "peak_so_far")


SQL_STAGES = """stages AS (
  SELECT o_custkey AS run, CASE WHEN o_orderstatus = 'O' THEN 'index' ELSE 'tar' END AS stage,
         sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT / 100.0::DOUBLE AS time_s,
         sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT / 200.0::DOUBLE AS write_s, max(o_totalprice) AS peak_ram_mb
  FROM orders GROUP BY 1, 2)"""


def stages(spark, sf_dir):
    """Stage timings: customers are runs, the order status tells the stage."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return fx.table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("run"), F.when(F.col("o_orderstatus") == "O", "index").otherwise("tar").alias("stage")
    ).agg((cents / 100.0).alias("time_s"), (cents / 200.0).alias("write_s"), F.max("o_totalprice").alias("peak_ram_mb"))


@query("combined_stage", f"""WITH {SQL_STAGES}
SELECT run, 'indexed tar' AS stage, round(sum(time_s), 6) AS time_s, round(sum(write_s), 6) AS write_s,
       max(peak_ram_mb) AS peak_ram_mb FROM stages GROUP BY run""")
def combined_stage(spark, sf_dir):
    return rounded(runs.combine_stages(stages(spark, sf_dir), "tar", "index", "indexed tar"), "time_s", "write_s")


SQL_PREPARED = """prepared AS (
  SELECT event_type AS format, [1, 2, 4, 8, 16][user_id % 5 + 1]::BIGINT AS workers, cents // 100 AS time_s,
         cents // 200 AS write_s, CASE WHEN event_type <> 'view' THEN cents // 50 END AS peak_ram_mb FROM ev)"""
PREPARE_WORKERS = [1, 2, 4, 8, 16]


def prepared(spark, sf_dir):
    """Preparation timings in whole seconds; one format was not profiled."""
    def whole(n):
        return F.call_function("div", F.col("cents"), F.lit(n).cast("long"))

    return fx.events(spark, sf_dir).select(
        F.col("event_type").alias("format"),
        fx.picked(PREPARE_WORKERS, F.col("user_id") % len(PREPARE_WORKERS)).alias("workers"),
        whole(100).alias("time_s"), whole(200).alias("write_s"),
        F.when(F.col("event_type") != "view", whole(50)).alias("peak_ram_mb"))


@query("worker_sweep", f"""WITH {fx.SQL_EVENTS}, {SQL_PREPARED},
cells AS (SELECT format, workers, format('{{:.2f}}', avg(time_s)) || ' / ' || format('{{:.2f}}', avg(write_s)) || ' / '
  || coalesce(format('{{:.1f}}', max(peak_ram_mb)::DOUBLE), 'N/A') AS cell FROM prepared GROUP BY 1, 2)
SELECT format, {', '.join(f"max(CASE WHEN workers = {w} THEN cell END) AS workers_{w}" for w in PREPARE_WORKERS)}
FROM cells GROUP BY format""")
def worker_sweep(spark, sf_dir):
    return runs.worker_sweep(prepared(spark, sf_dir), PREPARE_WORKERS)


@query("throughput_grid", f"""WITH {fx.SQL_RESULTS}
SELECT dataset, batch_size, num_workers, round(avg(throughput), 6) AS throughput FROM results
WHERE num_workers IN (4, 8, 16) GROUP BY 1, 2, 3""")
def throughput_grid(spark, sf_dir):
    return rounded(runs.throughput_grid(fx.results(spark, sf_dir)), "throughput")


@query("ttfb_by_workers", f"""WITH {fx.SQL_RESULTS}
SELECT dataset, num_workers, round(avg(ttfb), 6) AS ttfb FROM results GROUP BY 1, 2""")
def ttfb_by_workers(spark, sf_dir):
    return rounded(runs.ttfb_by_workers(fx.results(spark, sf_dir)), "ttfb")


@query("distinct_axes", f"WITH {fx.SQL_RESULTS} SELECT DISTINCT dataset, num_workers FROM results")
def distinct_axes(spark, sf_dir):
    return runs.distinct_axes(fx.results(spark, sf_dir))


@query("load_results", f"""WITH {fx.SQL_RESULTS}
SELECT dataset, num_workers, prefetch_factor, batch_size, CASE WHEN status = 'ok' THEN throughput END AS throughput, ttfb,
       status
FROM results""")
def load_results(spark, sf_dir):
    path = fresh_dir(spark, "results")
    rows = fx.results(spark, sf_dir)
    written = rows.withColumn("throughput", F.when(F.col("status") == "ok", F.col("throughput").cast("string"))
                              .otherwise("n/a"))
    runs.append_results(written, path)
    return runs.read_results(spark, path)


@query("append_results", f"""WITH {fx.SQL_RESULTS}
SELECT dataset, count(*) AS n_rows, sum(batch_size)::BIGINT AS batch_sizes FROM results GROUP BY dataset""")
def append_results(spark, sf_dir):
    """Two appends of disjoint halves read back as one table."""
    path = fresh_dir(spark, "appended")
    rows = fx.results(spark, sf_dir)
    runs.append_results(rows.filter("status = 'ok'"), path)
    runs.append_results(rows.filter("status <> 'ok'"), path)
    return runs.read_results(spark, path).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("batch_size").alias("batch_sizes"))


SQL_AXES = """axes_d AS (SELECT DISTINCT dataset FROM results), axes_w AS (SELECT DISTINCT num_workers FROM results),
axes_p AS (SELECT DISTINCT prefetch_factor FROM results), axes_b AS (SELECT DISTINCT batch_size FROM results),
grid AS (SELECT * FROM axes_d, axes_w, axes_p, axes_b)"""
SQL_DONE = """done AS (SELECT DISTINCT dataset, num_workers, prefetch_factor, batch_size FROM results
  WHERE status = 'ok')"""


def grid(spark, sf_dir):
    axes = fx.results(spark, sf_dir).agg(*runs.axes_of(**{name: F.col(name) for name in runs.AXES}))
    return runs.sweep_grid(axes)


@query("sweep_grid", f"WITH {fx.SQL_RESULTS}, {SQL_AXES} SELECT * FROM grid")
def sweep_grid(spark, sf_dir):
    return grid(spark, sf_dir)


@query("sweep_pending", f"""WITH {fx.SQL_RESULTS}, {SQL_AXES}, {SQL_DONE} SELECT * FROM grid EXCEPT SELECT * FROM done""")
def sweep_pending(spark, sf_dir):
    return runs.sweep_pending(grid(spark, sf_dir), fx.results(spark, sf_dir))


@query("sweep_progress", f"""WITH {fx.SQL_RESULTS}, {SQL_AXES}, {SQL_DONE}
SELECT (SELECT count(*) FROM done) AS completed, (SELECT count(*) FROM grid) AS total,
       round((SELECT count(*) FROM done) / (SELECT count(*) FROM grid) * 100, 6) AS percent""")
def sweep_progress(spark, sf_dir):
    return rounded(runs.sweep_progress(grid(spark, sf_dir), fx.results(spark, sf_dir)), "percent")


@query("union_formats", """SELECT 'pages' AS format, page_id AS id, octet_length(encode(html))::BIGINT AS n_bytes,
  NULL::VARCHAR AS role FROM pages UNION ALL SELECT 'conversations', conv_id, octet_length(encode(text)), role FROM conversations""")
def union_formats(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.octet_length("html").cast("long").alias("n_bytes"))
    turns = fx.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), F.octet_length("text").cast("long").alias("n_bytes"), "role")
    return runs.union_formats(pages=pages, conversations=turns)


@query("report_rows", f"""WITH files AS (
  SELECT source AS name, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) AS n_files,
         max(n_chars) AS longest FROM documents GROUP BY source)
SELECT name, '| ' || name || ' | ' || format('{{:.2f}}', bytes / 3000.0::DOUBLE) || ' | '
  || format('{{:.2f}}', bytes / 7000.0::DOUBLE) || ' | ' || format('{{:.2f}}', bytes::DOUBLE / 1024) || ' | ' || n_files
  || ' | ' || CASE WHEN longest > 10000 THEN format('{{:.1f}}', longest::DOUBLE) ELSE 'N/A' END || ' |' AS line
FROM files""")
def report_rows(spark, sf_dir):
    per_source = fx.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(
        F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n_files"),
        F.max("n_chars").alias("longest"))
    measured = per_source.select(
        "name", (F.col("bytes") / 3000.0).alias("time_s"), (F.col("bytes") / 7000.0).alias("write_s"),
        F.col("bytes").cast("double").alias("size_mb"), "n_files",
        F.when(F.col("longest") > 10000, F.col("longest")).alias("peak_ram_mb"))
    return runs.report_rows(measured).select("name", "line")
