"""Physical plans: what must reach the scan, and what must never appear."""

import re

import pytest
from pyspark.sql import functions as F

from shardloom.operators.attach import by_boundaries
from shardloom.operators.assignment import Rollover, roll_shards
from shardloom.operators.ordering import with_order
from shardloom.plans import catalog, fixtures as fx
from shardloom.plans.prepare import cluster_by_shard, narrow
from shardloom.session import stage

# Queries whose rows go through a Python kernel by design; all others stay in the JVM.
KERNELS = {
    "assign_join", "file_status", "written_sample_index", "batched_scan_stats", "buffer_shuffle", "chunk_roundtrip", "indexed_tar_roundtrip", "mds_roundtrip",
    "preprocess_pipeline", "preprocess_samples", "raster_normalize", "raster_resize", "raster_rgb", "reconcile", "shard_digest", "shard_fit",
    "shard_fit_oversized", "shard_manifest", "shard_small_rows", "shard_overshoot", "shard_per_writer", "skip_corrupt_shards",
    "stream_ingest_counts", "tar_roundtrip", "tar_sample_index",
}
PYTHON = re.compile(r"\b(ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas|"
                    r"FlatMapCoGroupsInPandas|PythonMapInArrow)\b")
# Window over rows without a partition: one task would see the table.
LONE_WINDOW = re.compile(r"\bWindow \[[^\]]*\], \[[^\]]*\]\s*$", re.M)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    return {name: plan_of(function(spark, sf_dir)) for name, function in catalog.QUERIES.items()}


def test_no_pairs_of_rows(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_python_only_where_declared(plans):
    # Data sources written in Python show as scans, not as row functions.
    assert {n for n, p in plans.items() if PYTHON.search(p)} <= KERNELS


def test_text_is_not_read_for_ids(spark, sf_dir):
    for name in ("seeded_shuffle", "epoch_shuffle", "sample_key", "worker_ranges", "virtual_epoch", "multi_epoch"):
        schemas = re.findall(r"ReadSchema: (\S+)", plan_of(catalog.QUERIES[name](spark, sf_dir)))
        assert schemas and set(schemas) <= {"struct<doc_id:bigint>", "struct<>"}, name


def test_counts_read_no_column(spark, sf_dir):
    plan = plan_of(catalog.QUERIES["count_samples"](spark, sf_dir))
    assert "ReadSchema: struct<>" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    from shardloom.operators.runs import throughput_grid

    results = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("dataset"), F.lit(1).alias("batch_size"), F.col("user_id").alias("num_workers"),
        F.col("value").alias("throughput"))
    assert "PushedFilters: [In(user_id, [16,4,8])]" in plan_of(throughput_grid(results))


def test_payload_is_shuffled_once(spark, sf_dir):
    """Up to the write, image bytes cross one exchange: the one that gathers shards."""
    flat = fx.samples(spark, sf_dir)
    assigned = stage(roll_shards(narrow(flat, F.octet_length("image")), Rollover(50_000), ["order_key", "sample_id"],
                                 n_rows=1000))
    rows = by_boundaries(flat, assigned).withColumn("shard_task", F.col("shard"))
    plan = plan_of(cluster_by_shard(rows, 1, 8, ["order_key", "sample_id"]))
    exchanges = re.findall(r"(?:- |  )Exchange (\w+\([^,]*)", plan)
    # Manifest rows meet their neighbours by shard; payload rows move to their shard's task.
    assert sum("direct_shuffle_partition_id" in e for e in exchanges) == 1
    assert all("shard" in e for e in exchanges)
    assert "BroadcastHashJoin" in plan


def test_narrow_rows_are_shuffled_once(spark, sf_dir):
    """Ranking, the step functions and the numbering of rows share one exchange."""
    rows = narrow(fx.samples(spark, sf_dir), F.octet_length("image"))
    rolled = roll_shards(rows, Rollover(50_000), ["order_key", "sample_id"], n_rows=1000)
    rolled.collect()
    final = plan_of(rolled).split("== Initial Plan ==")[0]
    assert len(re.findall(r"Scan ExistingRDD\[sample_id", final)) == 2  # the rows, and their bucket totals
    assert "ReusedExchange [sample_id" in final


def test_positions_never_rank_a_whole_table(spark):
    from shardloom.operators.ordering import with_positions

    plan = plan_of(with_positions(with_order(spark.range(100).withColumnRenamed("id", "sample_id")),
                                  ["order_key", "sample_id"]))
    ranks = [line for line in plan.splitlines() if "row_number()" in line and "windowspecdefinition" in line
             and "sample_id" in line]
    assert ranks and all("windowspecdefinition(bucket" in line for line in ranks)
