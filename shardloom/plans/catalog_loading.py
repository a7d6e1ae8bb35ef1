"""Queries that hand shards and rows to workers, batches and epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators.assignment import by_count
from shardloom.operators.loading import (
    batch_sizes,
    batches,
    collate,
    effective_workers,
    epochs,
    range_start,
    range_worker,
    round_robin,
    virtual_epoch,
    with_total,
    worker_slices,
)
from shardloom.operators.ordering import with_positions
from shardloom.plans import fixtures as fx
from shardloom.plans.catalog_rows import ORDER, ordered
from shardloom.plans.registry import query
from shardloom.session import stage

WORKERS, CPUS, SLICE, BATCH = 8, 16, 10, 32
SHARD_ROWS = 130

SQL_SHARDS = fx.SQL_ORDERED + f""",
shards AS (SELECT pos // {SHARD_ROWS} AS shard, min(pos) AS first_pos, count(*) AS n_rows FROM ordered GROUP BY 1)"""


def positions(spark, sf_dir):
    return with_positions(ordered(spark, sf_dir), ORDER).drop("bucket_no")


def shards(spark, sf_dir):
    """Shards of a fixed row count, with the total over all of them."""
    grouped = positions(spark, sf_dir).groupBy(by_count(F.col("pos"), SHARD_ROWS).alias("shard")).agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_rows"))
    return with_total(grouped, fx.samples(spark, sf_dir))


@query("worker_roundrobin", f"""WITH {SQL_SHARDS}
SELECT shard % {WORKERS} AS worker, count(*) AS n_shards, sum(n_rows)::BIGINT AS n_rows FROM shards GROUP BY 1""")
def worker_roundrobin(spark, sf_dir):
    dealt = shards(spark, sf_dir).withColumn("worker", round_robin(F.col("shard"), WORKERS))
    return dealt.groupBy("worker").agg(F.count(F.lit(1)).alias("n_shards"), F.sum("n_rows").alias("n_rows"))


@query("effective_workers", f"""WITH {SQL_SHARDS}, n AS (SELECT count(*) AS n_shards FROM shards),
{fx.SQL_RESULTS}
SELECT num_workers, n_shards, least(num_workers, n_shards, {CPUS}) AS effective, count(*) AS n_runs
FROM results, n GROUP BY ALL""")
def effective_worker_counts(spark, sf_dir):
    counted = shards(spark, sf_dir).agg(F.count(F.lit(1)))
    runs = fx.results(spark, sf_dir).withColumn("n_shards", counted.scalar())
    return runs.groupBy("num_workers", "n_shards").agg(F.count(F.lit(1)).alias("n_runs")).withColumn(
        "effective", effective_workers(F.col("num_workers"), F.col("n_shards"), CPUS))


@query("worker_ranges", f"""WITH {fx.SQL_ORDERED}, n AS (SELECT count(*) AS total FROM ordered)
SELECT pos * {WORKERS} // total AS worker, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_rows,
       min((pos * {WORKERS} // total * total + {WORKERS - 1}) // {WORKERS}) AS computed_start
FROM ordered, n GROUP BY 1""")
def worker_ranges(spark, sf_dir):
    rows = with_total(positions(spark, sf_dir), fx.samples(spark, sf_dir))
    worker = range_worker(F.col("pos"), WORKERS, F.col("total"))
    return rows.groupBy(worker.alias("worker"), "total").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n_rows")).select(
        "worker", "first_pos", "last_pos", "n_rows",
        range_start(F.col("worker"), WORKERS, F.col("total")).alias("computed_start"))


@query("worker_slices", f"""WITH {SQL_SHARDS}, n AS (SELECT count(*) AS total FROM ordered),
portions AS (
  SELECT pos * {WORKERS} // total AS worker, pos // {SHARD_ROWS} AS shard, min(pos) - min(first_pos) AS low,
         count(*) AS p
  FROM ordered JOIN shards ON shard = pos // {SHARD_ROWS}, n GROUP BY 1, 2),
pieces AS (SELECT *, greatest(1, round_even(p / {SLICE}.0, 0)::BIGINT) AS k FROM portions)
SELECT worker, shard, i AS slice, low + i * p // k AS "begin", low + (i + 1) * p // k AS "end"
FROM (SELECT *, unnest(range(k)) AS i FROM pieces)""")
def slices(spark, sf_dir):
    return worker_slices(shards(spark, sf_dir), WORKERS, SLICE)


# Rows of a worker stay in the seeded order; its buckets are those of the order.
SQL_WORKERS = fx.SQL_ORDERED + f""",
dealt AS (SELECT sample_id, order_key, pos // {SHARD_ROWS} % {WORKERS} AS worker FROM ordered),
batched AS (SELECT *, (row_number() OVER (PARTITION BY worker ORDER BY order_key, sample_id) - 1) // {BATCH} AS batch,
  (row_number() OVER (PARTITION BY worker ORDER BY order_key, sample_id) - 1) % {BATCH} AS slot,
  count(*) OVER (PARTITION BY worker) AS n FROM dealt)"""


def dealt(spark, sf_dir):
    rows = positions(spark, sf_dir)
    return stage(rows.withColumn("worker", round_robin(by_count(F.col("pos"), SHARD_ROWS), WORKERS)).drop("pos"))


def batched(spark, sf_dir, drop_last=False):
    return batches(dealt(spark, sf_dir), BATCH, ORDER, ("worker",), "bucket", drop_last)


@query("batch_partial", f"WITH {SQL_WORKERS} SELECT worker, batch, slot, sample_id FROM batched")
def batch_partial(spark, sf_dir):
    return batched(spark, sf_dir).select("worker", "batch", "slot", "sample_id")


@query("batch_drop_last", f"""WITH {SQL_WORKERS}
SELECT worker, batch, slot, sample_id FROM batched WHERE (batch + 1) * {BATCH} <= n""")
def batch_drop_last(spark, sf_dir):
    return batched(spark, sf_dir, drop_last=True).select("worker", "batch", "slot", "sample_id")


@query("batch_sizes", f"WITH {SQL_WORKERS} SELECT worker, batch, count(*) AS batch_rows FROM batched GROUP BY 1, 2")
def sizes_of_batches(spark, sf_dir):
    return batch_sizes(batched(spark, sf_dir), ("worker",), BATCH)


@query("collate_batches", f"""WITH {SQL_WORKERS}
SELECT worker, batch, count(*) AS n_rows, string_agg(sample_id, ',' ORDER BY slot) AS sample_ids,
       string_agg(text, ',' ORDER BY slot) AS texts
FROM batched JOIN samples USING (sample_id) GROUP BY 1, 2""")
def collate_batches(spark, sf_dir):
    texts = fx.samples(spark, sf_dir).select("sample_id", "text")
    rows = batched(spark, sf_dir).join(texts, "sample_id")
    stacked = collate(rows, ("worker",), ["sample_id", "text"])
    return stacked.select("worker", "batch", F.size("sample_id").cast("long").alias("n_rows"),
                          F.array_join("sample_id", ",").alias("sample_ids"), F.array_join("text", ",").alias("texts"))


@query("virtual_epoch", f"""WITH {fx.SQL_ORDERED}, n AS (SELECT count(*) AS total FROM ordered),
targets AS (SELECT unnest(range((total // {BATCH} + 1) * {BATCH})) AS epoch_pos FROM n)
SELECT epoch_pos, epoch_pos // {BATCH} AS batch, epoch_pos % {BATCH} AS slot, sample_id
FROM targets, n JOIN ordered ON pos = epoch_pos % total""")
def virtual_epoch_rows(spark, sf_dir):
    rows = with_total(positions(spark, sf_dir), fx.samples(spark, sf_dir))
    return virtual_epoch(rows, BATCH, F.col("total")).select("epoch_pos", "batch", "slot", "sample_id")


@query("multi_epoch", f"""WITH shuffled AS (
  SELECT epoch, doc_id AS sample_id,
    row_number() OVER (PARTITION BY epoch ORDER BY md5('{fx.SEED}:' || epoch || ':' || doc_id), doc_id) - 1 AS pos
  FROM documents, (SELECT unnest([1, 2]) AS epoch))
SELECT epoch, pos // {BATCH} AS batch, pos % {BATCH} AS slot, sample_id FROM shuffled""")
def multi_epoch(spark, sf_dir):
    rows = epochs(fx.samples(spark, sf_dir).select("sample_id"), 2, fx.SEED)
    return batches(rows, BATCH, ORDER, ("epoch",), "bucket").select("epoch", "batch", "slot", "sample_id")
