"""Orders, positions and splits for any partitioning."""

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from shardloom.operators.ordering import (
    in_file_order,
    in_seeded_order,
    range_buckets,
    ratio_bounds,
    shuffle_through_buffer,
    split_samples,
    split_shards,
    with_positions,
)
from shardloom.plans import catalog, catalog_rows


def ids(spark, n=500, partitions=7):
    return spark.range(n).withColumnRenamed("id", "sample_id").repartition(partitions)


def test_seeded_order(spark):
    orders = {(seed, epoch, p): [r.sample_id for r in in_seeded_order(ids(spark, partitions=p), seed, epoch).collect()]
              for seed, epoch, p in ((1, 0, 3), (1, 0, 50), (2, 0, 3), (1, 1, 3))}
    assert orders[1, 0, 3] == orders[1, 0, 50] and sorted(orders[1, 0, 3]) == list(range(500))
    assert len({tuple(o) for o in orders.values()}) == 3


@pytest.mark.parametrize("buckets", [1, 4, 40])
def test_positions_where_one_file_holds_most_rows(spark, buckets):
    rows = ids(spark).select(F.when(F.col("sample_id") < 400, "big").otherwise(F.format_string("f%03d", "sample_id"))
                             .alias("file"), F.col("sample_id").alias("row"))
    cut = range_buckets(rows, ["file", "row"], buckets)
    largest = cut.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert largest <= max(500 // buckets * 2, 30)
    placed = with_positions(cut, ["file", "row"]).orderBy("pos").collect()
    assert [r.pos for r in placed] == list(range(500))
    assert [(r.file, r.row) for r in placed] == sorted((r.file, r.row) for r in placed)
    assert [(r.file, r.row) for r in in_file_order(rows, "file", "row").collect()] == [(r.file, r.row) for r in placed]


def test_ratio_splits(spark):
    assert ratio_bounds([1, 0, 0], ["a", "b", "c"]) == [("a", 0.0, 1.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0)]
    for bad in ([0, 0], [-1, 2], [1]):
        with pytest.raises(ValueError):
            ratio_bounds(bad, ["a", "b"])
    shards = spark.range(20).withColumnRenamed("id", "shard")
    cut = {r.shard: r.split for r in split_shards(shards, 20, [8, 1, 1]).collect()}
    assert [cut[n] for n in range(20)] == ["train"] * 16 + ["val"] * 2 + ["test"] * 2
    assert {r.split for r in split_shards(shards, 20, [1, 0, 0]).collect()} == {"train"}
    counts = {r.split: r["count"] for r in split_samples(ids(spark, 4000), [8, 1, 1]).groupBy("split").count().collect()}
    assert 3000 < counts["train"] < 3400 and 300 < counts["val"] < 500 and 300 < counts["test"] < 500


@pytest.mark.parametrize("buffer_rows", [1, 10, 1000])
def test_shuffle_buffer(spark, buffer_rows):
    rows = spark.range(0, 300, 1, 2).withColumnRenamed("id", "sample_id")
    shuffled = shuffle_through_buffer(rows, buffer_rows, seed=3).withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.sample_id for r in shuffled) == list(range(300))
    for p in (0, 1):
        mine = sorted((r for r in shuffled if r.p == p), key=lambda r: r.emitted)
        assert [r.emitted for r in mine] == list(range(150))
        assert all(r.emitted >= r.arrived - buffer_rows for r in mine)
        in_order = [r.arrived for r in mine] == list(range(150))
        assert in_order == (buffer_rows == 1)
    again = shuffle_through_buffer(rows, buffer_rows, seed=3).collect()
    assert {(r.sample_id, r.emitted) for r in again} == {(r.sample_id, r.emitted) for r in shuffled}


def test_large_files_go_on_in_further_parts(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_rows, "FILE_BYTES", 50_000, raising=False)
    monkeypatch.setattr(catalog_rows, "fresh_dir", lambda spark, label: f"file://{tmp_path}/{label}")
    found = catalog_rows.parquet_order(spark, sf_dir)
    assert len(list((tmp_path / "two-files").rglob("part-*.parquet"))) > 4
    assert differences(found, connect(sf_dir), catalog.ORACLES["parquet_order"]) == []
