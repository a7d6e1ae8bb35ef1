"""Logs, results files, reports and listings against the published wording and figures."""

import pytest
from pyspark.sql import functions as F

from shardloom.functions.formatting import fixed, fixed_or_missing, mb_to_gb
from shardloom.functions.paths import is_shard_name, normalize_uri
from shardloom.functions.payload import byte_count, decode_text, encode_columns
from shardloom.functions.text_metrics import (
    TOTAL_TIME,
    WRITE_TIME,
    at_line_start,
    epoch_time,
    epoch_times,
    first_match,
    log_metrics,
    read_logs,
)
from shardloom.operators import runs
from shardloom.sources.listing import count_per_file, dir_stats, list_parquet, list_shards

# Log texts in the wording that must match, and figures that were published with them.
STAGE_LOG = """Timing Summary:
TarDataset preparation time: 31.03 seconds
TarDataset write time: 24.51 seconds
Index dataset write time: 5.28 seconds

Combined Metrics:
Converter execution time: 5.28 seconds
Dataset write time: 29.79 seconds
Total script time: 37.67 seconds
"""
RUN_LOG = """Time to first batch: 2.7670s
Epoch 1: Processed 88514 samples in 38.97s (2271.35 images/sec)
Epoch 2: Processed 88514 samples in 33.42s (2648.20 images/sec)

Benchmark Summary:
  Total samples: 177028
  Wall time: 72.39s
  Throughput: 2648.20 images/sec
  Time to first batch: 2.7670s
"""


def one(spark, column, **values):
    names = ", ".join(values)
    return spark.createDataFrame([tuple(values.values())], names.split(", ")).select(column.alias("v")).first().v


def test_longer_label_does_not_answer(spark):
    log = F.col("log")
    assert one(spark, first_match(log, WRITE_TIME), log=STAGE_LOG) == "24.51"
    assert one(spark, first_match(log, at_line_start(WRITE_TIME)), log=STAGE_LOG) == "29.79"
    assert one(spark, first_match(log, TOTAL_TIME), log=STAGE_LOG) == "37.67"
    assert one(spark, first_match(log, "no such ([0-9]+)"), log=STAGE_LOG) == "0"


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(RUN_LOG)
    (tmp_path / "b.log").write_text("Error running: out of memory\n")
    (tmp_path / "c.log").write_text("Epoch 1: Processed 10 samples in 2.00s (5.00 images/sec)\n")
    rows = {r.file: r for r in log_metrics(read_logs(spark, str(tmp_path))).collect()}
    assert rows["a.log"][1:] == (2648.20, 177028, 33.42, 2.7670, 38.97, 33.42)
    assert rows["b.log"][1:] == (0.0, 0, 0.0, 0.0, 0.0, 0.0)
    assert rows["c.log"][1:] == (5.0, 10, 2.0, 0.0, 2.0, 0.0)


def test_later_line_of_an_epoch_counts(spark):
    log = "Epoch 2: Processed 1 samples in 3.5s\nEpoch 2: Processed 1 samples in 4.5s\n"
    assert one(spark, epoch_time(F.col("log"), 2), log=log) == 4.5
    assert one(spark, epoch_times(F.col("log")), log="Epoch 1: Processed 1 samples in 9.0s\n" + log) == {1: 9.0, 2: 4.5}
    assert one(spark, epoch_times(F.col("log")), log="nothing") == {}


def test_results_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "dataset,num_workers,prefetch_factor,batch_size,throughput,TTFB\nTar,4,1,128,1365.09,2.3087\n"
        "MDS,4,1,128,n/a,25.9\nbroken,4\nChunks,8,2,256,3097.14\n"
        "dataset,num_workers,prefetch_factor,batch_size,throughput,TTFB\nTar,16,4,1024,2987.78,7.3442\n")
    rows = sorted(runs.read_results(spark, str(tmp_path)).collect())
    assert [tuple(r) for r in rows] == [
        ("Chunks", 8, 2, 256, 3097.14, None, "ok"), ("MDS", 4, 1, 128, None, 25.9, "failed"),
        ("Tar", 4, 1, 128, 1365.09, 2.3087, "ok"), ("Tar", 16, 4, 1024, 2987.78, 7.3442, "ok")]


# Published throughput of one format at one worker count, over prefetch factors and batch sizes.
PUBLISHED = {128: (1365.09, 1455.34, 1449.55), 256: (1366.72, 1456.2, 1453.99), 512: (1368.16, 1444.9, 1451.89),
             1024: (1352.27, 1448.43, 1435.06)}


def test_published_means(spark):
    rows = [("Tar", 4, p, b, v, v / 1000, "ok") for b, values in PUBLISHED.items() for p, v in zip((1, 2, 4), values)]
    results = spark.createDataFrame(rows, runs.RESULT_SCHEMA)
    overall = results.agg(F.avg("throughput")).first()[0]
    assert round(overall, 2) == 1420.63
    grid = {r.batch_size: r.throughput for r in runs.throughput_grid(results, [4]).collect()}
    assert grid == {b: pytest.approx(sum(v) / 3) for b, v in PUBLISHED.items()}


def test_failed_runs_do_not_block_a_rerun(spark):
    axes = spark.createDataFrame([(["Tar", "MDS"], [4, 8], [1], [128])],
                                 "dataset array<string>, num_workers array<long>, prefetch_factor array<long>, "
                                 "batch_size array<long>")
    grid = runs.sweep_grid(axes)
    results = spark.createDataFrame([("Tar", 4, 1, 128, 0.0, 0.0, "failed"), ("Tar", 8, 1, 128, 9.0, 1.0, "ok"),
                                     ("Tar", 8, 1, 128, 9.5, 1.0, "ok")], runs.RESULT_SCHEMA)
    assert {(r.dataset, r.num_workers) for r in runs.sweep_pending(grid, results).collect()} == {
        ("Tar", 4), ("MDS", 4), ("MDS", 8)}
    progress = runs.sweep_progress(grid, results).first()
    assert (progress.completed, progress.total, progress.percent) == (1, 4, 25.0)


def test_full_sweep_has_144_configurations(spark):
    axes = spark.createDataFrame([(["a", "b", "c", "d"], [4, 8, 16], [1, 2, 4], [128, 256, 512, 1024])],
                                 "dataset array<string>, num_workers array<long>, prefetch_factor array<long>, "
                                 "batch_size array<long>")
    assert runs.sweep_grid(axes).count() == 144


def test_two_decimals_round_as_printf(spark):
    values = [0.125, 0.375, 1.005, 2.675, 1234567.891, 0.0, -0.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [f"{v:.2f}" for v in values]
    assert one(spark, mb_to_gb(F.col("v")), v=3250.0) == f"{3250 / 1024:.2f}"
    assert one(spark, fixed_or_missing(F.lit(None).cast("double")), v=1) == "N/A"


def test_uris(spark):
    for uri, expected in {"s3://bucket/a//b/": "s3://bucket/a/b/tar", "bucket": "s3://bucket/tar",
                          "bucket/x": "s3://bucket/x/tar"}.items():
        assert one(spark, normalize_uri(F.col("u"), "tar")["uri"], u=uri) == expected
    assert one(spark, normalize_uri(F.col("u"), "tar")["uri"], u="") is None


def test_shard_names(spark):
    for name, expected in {"x/dataset-train-000001.tar": True, "dataset-val-000001.tar": False,
                           "dataset-train-000001.tar.idx": False}.items():
        assert one(spark, is_shard_name(F.col("n")), n=name) is expected


def test_sizes_in_words(spark):
    for text, expected in {"64MB": 64_000_000, "1GB": 10**9, " 1.5 KiB ": 1536, "7": 7, "3 parsecs": None}.items():
        assert one(spark, byte_count(F.col("t")), t=text) == expected


def test_column_types_are_checked_before_a_job(spark):
    table = spark.createDataFrame([(b"x", "t", 1)], "image binary, text string, idx int")
    assert dict(encode_columns(table, {"image": "jpeg", "text": "str", "idx": "int"}).dtypes)["idx"] == "bigint"
    for wrong in ({"image": "str"}, {"text": "int"}, {"idx": "nothing"}, {"absent": "str"}):
        with pytest.raises(ValueError):
            encode_columns(table, wrong)


def test_malformed_text(spark):
    table = spark.createDataFrame([(b"caf\xc3\xa9",), (b"\xff!",)], "b binary")
    assert [r.t for r in table.select(decode_text(table, "b", strict=False).alias("t")).collect()] == ["café", "�!"]
    with pytest.raises(Exception):
        table.select(decode_text(table, "b").alias("t")).collect()


def test_listings(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "deep" / "t.parquet"))
    (tmp_path / "dataset-train-000000.tar").write_bytes(b"0" * 1024)
    (tmp_path / "other.txt").write_text("x")
    assert list_parquet(spark, str(tmp_path)).count() == 3
    assert [r.name for r in list_shards(spark, str(tmp_path)).collect()] == ["dataset-train-000000.tar"]
    for wrong in (str(tmp_path / "absent"), str(tmp_path / "other.txt")):
        with pytest.raises(ValueError):
            list_parquet(spark, wrong)
    (tmp_path / "empty").mkdir()
    for nothing in ("empty", "absent"):
        assert tuple(dir_stats(spark, str(tmp_path / nothing)).first()) == (0.0, 0)


def test_unreadable_files_are_skipped(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "part-9.parquet").write_bytes(b"PAR1 not really PAR1")
    assert [r.n_rows for r in count_per_file(spark, str(tmp_path / "t")).collect()] == [10]
    with pytest.raises(Exception):
        count_per_file(spark, str(tmp_path / "t"), skip_corrupt=False).collect()


def test_running_peak_over_spans(spark):
    rows = [("a", t, float(v)) for t, v in enumerate([5, 3, 9, 1, 2, 8, 12, 0])] + [("b", 0, 1.0)]
    series = spark.createDataFrame(rows, "name string, tick long, ram_mb double")
    peaks = runs.running_peak(series, F.floor(F.col("tick") / 3)).orderBy("name", "tick").collect()
    assert [r.peak_so_far for r in peaks] == [5, 5, 9, 9, 9, 9, 12, 12, 1]
