"""The given tables in the shapes the operators take, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.sources.storage import locate, replacing

SEED = 42
# Limits scaled to the given tables: most documents fit many to a shard, and a few fill half of one.
TAR_BYTES, TAR_ROWS = 131_072, 50
MDS_BYTES = 65_536
CHUNK_BYTES = 65_536
# Smaller than the largest documents, so that some rows are larger than a shard.
TINY_BYTES = 8_192
WRITERS = 4

# Sweep axes.
WORKERS = [4, 8, 16, 32]
PREFETCH = [1, 2, 4]
BATCH_SIZES = [128, 256, 512, 1024]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (sample_id, image.content, text.content)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"),
        F.struct(F.encode("text", "UTF-8").alias("content")).alias("image"),
        F.struct(F.concat("lang", F.lit("/"), "source").alias("content")).alias("text"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (sample_id, image, text)."""
    return nested_samples(spark, sf_dir).select(
        "sample_id", F.col("image.content").alias("image"), F.col("text.content").alias("text"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose text is null where no label covers the document."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), "quality")
    return samples(spark, sf_dir).join(labels, "sample_id", "left").select(
        "sample_id", "image", F.when(F.col("quality").isNotNull(), F.col("text")).alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with integer cents and microseconds since the start of 2024."""
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id", "value",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").alias("micros"))


def picked(values: list, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (index + 1).cast("int"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep results: one event is one run of a configuration."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("dataset"),
        picked(WORKERS, F.col("user_id") % len(WORKERS)).alias("num_workers"),
        picked(PREFETCH, F.col("event_id") % len(PREFETCH)).alias("prefetch_factor"),
        picked(BATCH_SIZES, F.floor(F.col("event_id") / 3) % len(BATCH_SIZES)).alias("batch_size"),
        F.col("value").alias("throughput"), (F.col("value") / 100).alias("ttfb"),
        F.when(F.col("cents") > 30000, "ok").otherwise("failed").alias("status"))


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process samples: name, pid, ts, rss_bytes, cpu_percent, hourly tick."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("name"), F.col("user_id").alias("pid"), (F.col("micros") / 1e6).alias("ts"),
        (F.col("cents") * 10_000).alias("rss_bytes"), F.floor(F.col("cents") / 100).cast("double").alias("cpu_percent"),
        F.call_function("div", F.col("micros"), F.lit(3_600_000_000)).alias("hour"))


def run_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch completions: run, epoch (first and second half of the month), ts, samples."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("run"), (F.call_function("div", F.col("micros"), F.lit(1_296_000_000_000)) + 1).alias("epoch"),
        (F.col("micros") / 1e6).alias("ts"), F.lit(1).cast("long").alias("samples"))


def epoch_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each epoch of a run began: the halves of the month."""
    return run_batches(spark, sf_dir).select("run", "epoch").distinct().withColumn(
        "start_ts", ((F.col("epoch") - 1) * 1_296_000).cast("double"))


def run_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of the month are started together, by its first event."""
    batches = run_batches(spark, sf_dir)
    return batches.select("run").distinct().withColumn("start_ts", batches.agg(F.min("ts")).scalar())


def decimal_text(cents) -> F.Column:
    return F.concat(F.call_function("div", cents, F.lit(100)).cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loader log per event; every fifth run stopped before its summary."""
    rate, first = decimal_text(F.col("cents")), decimal_text(F.col("cents") + 137)
    return events(spark, sf_dir).select("event_id", F.concat(
        F.lit("Starting benchmark with batch size 256\n"),
        F.lit("Epoch 1: Processed "), F.col("user_id"), F.lit(" samples in "), first, F.lit("s ("), rate,
        F.lit(" images/sec)\n"),
        F.when(F.col("event_id") % 7 != 0, F.concat(
            F.lit("Epoch 2: Processed "), F.col("user_id") + 1, F.lit(" samples in "), rate, F.lit("s ("), first,
            F.lit(" images/sec)\n"))).otherwise(F.lit("")),
        F.when(F.col("event_id") % 5 != 0, F.concat(
            F.lit("\nBenchmark Summary:\n  Total samples: "), F.col("user_id") * 2 + 1,
            F.lit("\n  Throughput: "), first, F.lit(" images/sec\n  Time to first batch: "), rate, F.lit("s\n")))
        .otherwise(F.lit(""))).alias("log"))


LOGS_PER_FILE = 500


def write_log_files(spark: SparkSession, sf_dir: str, path: str, share: float = 1.0) -> None:
    """A file for every 500 runs, with its logs one after another, or its first bytes. A repeated task writes the same file."""
    run = F.call_function("div", F.col("event_id"), F.lit(LOGS_PER_FILE))
    logs = F.array_sort(F.collect_list(F.struct("event_id", "log")))
    whole = run_logs(spark, sf_dir).groupBy(run.alias("run")).agg(
        F.array_join(F.transform(logs, lambda s: s["log"]), "").alias("log"))

    def put(rows):
        filesystem, base = locate(path)
        filesystem.create_dir(base, recursive=True)
        for row in rows:
            content = row.log.encode()
            with replacing(filesystem, f"{base}/run-{row.run}.log") as out:
                out.write(content[:int(len(content) * share)])

    whole.foreachPartition(put)


def stage_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preparation log per order; an earlier label contains the one that is asked for."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    own, before = decimal_text(cents), decimal_text(cents + F.col("o_custkey") * 100 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(
        F.lit("Timing Summary:\nTar preparation time: 1.00 seconds\nTarDataset write time: "), before,
        F.lit(" seconds\n\nCombined Metrics:\nDataset write time: "), own, F.lit(" seconds\n")).alias("log"))


def rasters(spark: SparkSession, sf_dir: str, height: int = 8, width: int = 8, channels: int = 1) -> DataFrame:
    """embeddings as uint8 rasters: each vector scaled to 0..255 between its least and greatest value."""
    vectors = table(spark, sf_dir, "embeddings")
    low, high = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    scaled = F.transform("embedding", lambda v: F.least(
        F.floor((v.cast("double") - low) / F.nullif(high - low, F.lit(0.0)) * 256).cast("int"), F.lit(255)))
    # A constant vector is one level.
    levels = F.when(high > low, scaled).otherwise(F.transform("embedding", lambda v: F.lit(0)))
    # Two hex digits a level: the bytes of the raster.
    data = F.unhex(F.array_join(F.transform(levels, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    return vectors.select(
        F.col("vec_id").alias("sample_id"), F.lit(height).alias("height"), F.lit(width).alias("width"),
        F.lit(channels).alias("channels"), data.alias("data"))


# The same shapes in SQL.

SQL_SAMPLES = """samples AS (
  SELECT doc_id AS sample_id, encode(text) AS image, lang || '/' || source AS text, source AS file,
         octet_length(encode(text))::BIGINT AS image_bytes,
         octet_length(encode(lang || '/' || source))::BIGINT AS text_bytes
  FROM documents)"""

SQL_ORDERED = SQL_SAMPLES + f""",
sized AS (SELECT *, image_bytes + text_bytes AS size, md5('{SEED}:0:' || sample_id) AS order_key FROM samples),
ordered AS (SELECT *, row_number() OVER (ORDER BY order_key, sample_id) - 1 AS pos,
  (sum(size) OVER (ORDER BY order_key, sample_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS cum FROM sized)"""

SQL_EVENTS = """ev AS (
  SELECT event_id, event_type, user_id, value, CAST(round(value * 100) AS BIGINT) AS cents,
         epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS micros
  FROM events)"""


def _sql_list(values) -> str:
    return "[" + ", ".join(str(v) for v in values) + "]"


SQL_RESULTS = SQL_EVENTS + f""",
results AS (
  SELECT event_type AS dataset,
         {_sql_list(WORKERS)}[user_id % {len(WORKERS)} + 1]::BIGINT AS num_workers,
         {_sql_list(PREFETCH)}[event_id % {len(PREFETCH)} + 1]::BIGINT AS prefetch_factor,
         {_sql_list(BATCH_SIZES)}[event_id // 3 % {len(BATCH_SIZES)} + 1]::BIGINT AS batch_size,
         value AS throughput, value / 100 AS ttfb,
         CASE WHEN cents > 30000 THEN 'ok' ELSE 'failed' END AS status
  FROM ev)"""

SQL_RESOURCES = SQL_EVENTS + """,
resource AS (
  SELECT event_type AS name, user_id AS pid, micros / 1e6 AS ts, cents * 10000 AS rss_bytes,
         (cents // 100)::DOUBLE AS cpu_percent, micros // 3600000000 AS hour
  FROM ev)"""

SQL_BATCHES = SQL_EVENTS + """,
batches AS (
  SELECT event_type AS run, micros // 1296000000000 + 1 AS epoch, micros / 1e6 AS ts, 1::BIGINT AS samples FROM ev)"""


def _sql_decimal(cents: str) -> str:
    return f"(({cents}) // 100 || '.' || lpad((({cents}) % 100)::VARCHAR, 2, '0'))"


SQL_LOGS = SQL_EVENTS + f""",
logs AS (
  SELECT event_id, 'Starting benchmark with batch size 256' || chr(10)
    || 'Epoch 1: Processed ' || user_id || ' samples in ' || {_sql_decimal('cents + 137')} || 's ('
    || {_sql_decimal('cents')} || ' images/sec)' || chr(10)
    || CASE WHEN event_id % 7 <> 0 THEN 'Epoch 2: Processed ' || (user_id + 1) || ' samples in '
       || {_sql_decimal('cents')} || 's (' || {_sql_decimal('cents + 137')} || ' images/sec)' || chr(10) ELSE '' END
    || CASE WHEN event_id % 5 <> 0 THEN chr(10) || 'Benchmark Summary:' || chr(10) || '  Total samples: '
       || (user_id * 2 + 1) || chr(10) || '  Throughput: ' || {_sql_decimal('cents + 137')} || ' images/sec' || chr(10)
       || '  Time to first batch: ' || {_sql_decimal('cents')} || 's' || chr(10) ELSE '' END AS log
  FROM ev)"""

SQL_STAGE_LOGS = f"""stage_logs AS (
  SELECT o_orderkey, 'Timing Summary:' || chr(10) || 'Tar preparation time: 1.00 seconds' || chr(10)
    || 'TarDataset write time: ' || {_sql_decimal('c + o_custkey * 100 + 1')} || ' seconds' || chr(10) || chr(10)
    || 'Combined Metrics:' || chr(10) || 'Dataset write time: ' || {_sql_decimal('c')} || ' seconds' || chr(10) AS log
  FROM (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))"""


def sql_rasters(vectors: str = "embeddings") -> str:
    return f"""rasters AS (
  SELECT vec_id AS sample_id, list_transform(embedding, lambda v: CASE WHEN hi > lo
    THEN least(floor((v::DOUBLE - lo) / (hi - lo) * 256)::INTEGER, 255) ELSE 0 END) AS levels
  FROM (SELECT *, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM {vectors})
  WHERE embedding IS NOT NULL)"""


def sql_rolled(rows: str, limit: int, policy: str, max_rows: int | None = None, size: str = "size",
               group: str = "0", order: str = "order_key, sample_id", source: str = "sized") -> str:
    """One row at a time through the rollover rule: CTEs ending in ``rolled`` (grp, n, shard, slot, ...)."""
    full = "r.bytes >= {0}".format(limit) if policy == "overshoot" else "r.bytes + s.sz > {0}".format(limit)
    if max_rows is not None:
        full = f"({full} OR r.slot + 1 >= {max_rows})"
    return rows + f""",
seq AS MATERIALIZED (
  SELECT {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS n, sample_id, {size} AS sz
  FROM {source}),
rolled AS (
  SELECT grp, n, sample_id, sz, 0::BIGINT AS shard, 0::BIGINT AS slot, sz::BIGINT AS bytes FROM seq WHERE n = 1
  UNION ALL
  SELECT s.grp, s.n, s.sample_id, s.sz,
         CASE WHEN {full} THEN r.shard + 1 ELSE r.shard END,
         CASE WHEN {full} THEN 0 ELSE r.slot + 1 END,
         CASE WHEN {full} THEN s.sz ELSE r.bytes + s.sz END
  FROM rolled r JOIN seq s ON s.grp = r.grp AND s.n = r.n + 1)"""
