"""Late rows, replays and restarts."""

from oracle import connect, differences
from pyspark.sql import functions as F

from shardloom.plans import catalog, catalog_streams
from shardloom.plans.prepare import read_shards
from shardloom.session import fresh_dir
from shardloom.streaming.ingest import arriving, shard_batches
from shardloom.streaming.metrics import resource_windows, running_peak
from shardloom.streaming.sinks import finish, latest, start, versions

SCHEMA = "name string, event_time timestamp, ram_mb double"


def put(spark, path, rows):
    spark.createDataFrame([(n, t, v) for n, t, v in rows], "name string, s long, ram_mb double").select(
        "name", F.timestamp_seconds("s").alias("event_time"), "ram_mb").coalesce(1).write.mode("append").parquet(path)


def test_rows_behind_the_watermark_are_dropped(spark):
    source, out, state = (fresh_dir(spark, label) for label in ("src", "out", "state"))

    def drain():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        finish(start(resource_windows(stream, "1 minute", "2 minutes"), versions(out), state, "update", True))
        return {(r.name, r.window_start // 60_000_000): (r.n_samples, r.peak_ram_mb, r.mean_ram_mb)
                for r in latest(spark, out, ["name", "window_start"]).collect()}

    put(spark, source, [("a", 10, 5.0), ("a", 20, 7.0), ("b", 70, 1.0)])
    assert drain() == {("a", 0): (2, 7.0, 6.0), ("b", 1): (1, 1.0, 1.0)}
    put(spark, source, [("a", 1000, 2.0), ("a", 30, 9.0)])
    assert drain()[("a", 0)] == (3, 9.0, 7.0)
    # The watermark now stands at 1000 s less two minutes.
    put(spark, source, [("a", 40, 100.0), ("a", 890, 4.0)])
    result = drain()
    assert result[("a", 0)] == (3, 9.0, 7.0) and result[("a", 14)] == (1, 4.0, 4.0)


def test_peak_survives_a_restart(spark):
    source, out, state = (fresh_dir(spark, label) for label in ("src", "out", "state"))
    for rows, expected in (([("a", 1, 5.0), ("b", 1, 3.0)], {"a": 5.0, "b": 3.0}),
                           ([("a", 2, 4.0), ("b", 2, 8.0)], {"a": 5.0, "b": 8.0})):
        put(spark, source, rows)
        finish(start(running_peak(spark.readStream.schema(SCHEMA).parquet(source)), versions(out), state, "update", True))
        assert {r.name: r.peak_ram_mb for r in latest(spark, out, ["name"]).collect()} == expected


def test_a_replayed_batch_rewrites_its_shards(spark):
    source, out, state = (fresh_dir(spark, label) for label in ("src", "out", "state"))
    table = spark.range(60).select(F.col("id").alias("sample_id"), F.encode(F.repeat(F.lit("x"), 20), "UTF-8").alias("image"),
                                   F.col("id").cast("string").alias("text"))
    table.repartition(3, "sample_id").write.parquet(source)
    write = shard_batches(out, 300, 9, digits=1, least_bytes=0)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    finish(start(arriving(spark, source, table.schema, files_per_batch=1), twice, state, available_now=True))
    rows = read_shards(spark, "tarshards", out).select(F.decode("txt", "UTF-8").cast("long").alias("id"), "shard").collect()
    assert sorted(r.id for r in rows) == list(range(60))
    assert len({r.shard.split("/")[0] for r in rows}) == 3


def test_large_parts_are_several_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_streams, "PART_BYTES", 100_000, raising=False)
    monkeypatch.setattr(catalog_streams, "fresh_dir", lambda spark, label: f"file://{tmp_path}/{label}")
    found = catalog_streams.stream_ingest_counts(spark, sf_dir)
    assert differences(found, connect(sf_dir), catalog.ORACLES["stream_ingest_counts"]) == []
    assert len(list((tmp_path / "parts").glob("part-*.parquet"))) > 3
    assert len(list((tmp_path / "ingested").glob("batch-*"))) == 2
