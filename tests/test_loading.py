"""Published arithmetic of worker ranges, slices and epochs, and batching under skew."""

import itertools

import pytest
from pyspark.sql import functions as F

from shardloom.operators.loading import (
    batches,
    range_start,
    range_worker,
    virtual_epoch,
    worker_slices,
)
from shardloom.operators.assignment import by_count
from shardloom.operators.ordering import with_order
from shardloom.sources.indexed_tar import portions, slice_starts

N = 88_514
# First rows of the 23 shards of a published run.
SHARD_STARTS = [0, 3820, 7727, 11611, 15540, 19347, 23124, 26986, 30830, 34680, 38556, 42465, 46256, 50102, 53965,
                57813, 61780, 65668, 69623, 73525, 77355, 81216, 85098]
WORKER_STARTS = [0, 11065, 22129, 33193, 44257, 55322, 66386, 77450]


def published_shards(spark):
    rows = [(n, start, end - start, N) for n, (start, end) in enumerate(itertools.pairwise([*SHARD_STARTS, N]))]
    return spark.createDataFrame(rows, "shard long, first_pos long, n_rows long, total long")


def test_worker_starts(spark):
    starts = spark.range(8).select(range_start(F.col("id"), 8, F.lit(N)).alias("s")).collect()
    assert [r.s for r in starts] == WORKER_STARTS
    borders = spark.createDataFrame([(p,) for s in WORKER_STARTS[1:] for p in (s - 1, s)], "pos long")
    workers = [r.w for r in borders.select(range_worker(F.col("pos"), 8, F.lit(N)).alias("w")).collect()]
    assert workers == [w for n in range(7) for w in (n, n + 1)]


def test_published_slices(spark):
    slices = worker_slices(published_shards(spark), 8).collect()
    per_worker = [sum(s.worker == w for s in slices) for w in range(8)]
    assert per_worker == [110, 110, 111, 111, 111, 111, 110, 111]
    first = [(s.begin, s.end) for s in sorted(slices, key=lambda s: (s.shard, s.begin))
             if s.shard == 2 and s.worker == 1 and s.begin < 3884]
    assert [b for b, _ in first] == [3338, 3447, 3556, 3665, 3774]
    last = max((s for s in slices if s.worker == 7), key=lambda s: (s.shard, s.begin))
    assert (last.shard, last.begin, last.end) == (22, 3315, 3416)


def test_reader_portions_agree_with_the_operator(spark):
    entries = [{"file": str(n), "samples": end - start} for n, (start, end) in
               enumerate(itertools.pairwise([*SHARD_STARTS, N]))]
    cut = [(p["worker"], int(p["file"]), n, int(p["low"] + s)) for p in portions(entries, 8)
           for n, s in enumerate(slice_starts(p["high"] - p["low"], 100))]
    slices = worker_slices(published_shards(spark), 8).collect()
    assert sorted(cut) == sorted((s.worker, s.shard, s.slice, s.begin) for s in slices)


@pytest.mark.parametrize("size, steps, rows", [(256, 346, 88_576), (1024, 87, 89_088)])
def test_virtual_epoch_totals(spark, size, steps, rows):
    placed = spark.range(N).withColumnRenamed("id", "pos")
    epoch = virtual_epoch(placed, size, F.lit(N)).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("batch").alias("b"), F.max("epoch_pos").alias("m")).first()
    assert (epoch.n, epoch.b, epoch.m) == (rows, steps, rows - 1)


def test_virtual_epoch_of_whole_batches_and_of_few_rows(spark):
    for n, size in ((64, 32), (5, 32)):
        epoch = virtual_epoch(spark.range(n).withColumnRenamed("id", "pos"), size, F.lit(n)).orderBy("epoch_pos")
        rows = epoch.collect()
        assert [r.epoch_pos for r in rows] == list(range((n // size + 1) * size))
        assert [r.pos for r in rows] == [p % n for p in range(len(rows))]


def test_fixed_batches(spark):
    assert spark.range(N).select(by_count(F.col("id"), 100).alias("b")).distinct().count() == 886


def test_batches_of_a_hot_worker(spark):
    table = spark.range(3000).select(F.col("id").alias("sample_id"),
                                     F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("worker"))
    batched = batches(with_order(table, digits=2), 32, ["order_key", "sample_id"], ("worker",), "bucket").collect()
    for worker in range(7):
        mine = sorted((r for r in batched if r.worker == worker), key=lambda r: r.pos)
        assert [r.batch * 32 + r.slot for r in mine] == list(range(len(mine)))
        assert [r.order_key for r in mine] == sorted(r.order_key for r in mine)
    assert len(batched) == 3000
