"""Appends, damaged archives, equal file names, names with commas, and sessions started elsewhere."""

import io
import os
import subprocess
import sys
import tarfile

import pytest
from pyspark.sql import functions as F

from shardloom.operators import runs
from shardloom.plans import fixtures as fx
from shardloom.plans.catalog_raster import mixed
from shardloom.sources.indexed_tar import sample_offsets
from shardloom.sources.listing import count_per_file
from shardloom.sources.mds import CODECS, compressed, decompressed
from shardloom.sources.tar import samples_of

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shards(spark, rows, first):
    return spark.range(rows).coalesce(1).select(F.lit(first).cast("long").alias("shard"), F.format_string("k%05d", "id").alias("__key__"),
                                    F.encode(F.col("id").cast("string"), "UTF-8").alias("jpg"))


def test_append_keeps_what_is_there(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    read = lambda: spark.read.format("tarshards").schema("shard string, __key__ string, jpg binary").load(path).count()
    shards(spark, 10, 0).write.format("tarshards").mode("append").save(path)
    with pytest.raises(Exception, match="under other numbers"):
        shards(spark, 3, 0).write.format("tarshards").mode("append").save(path)
    assert read() == 10
    shards(spark, 3, 1).write.format("tarshards").mode("append").save(path)
    assert read() == 13


@pytest.mark.parametrize("damage", ["header", "cut"])
def test_damaged_archives_are_errors(tmp_path, damage):
    path = tmp_path / "x.tar"
    with tarfile.open(path, "w", format=tarfile.USTAR_FORMAT) as archive:
        for i in range(10):
            member = tarfile.TarInfo(f"k{i}.jpg")
            member.size = 100
            archive.addfile(member, io.BytesIO(bytes(100)))
    data = bytearray(path.read_bytes())
    if damage == "header":
        data[5 * 1024:5 * 1024 + 200] = b"\xff" * 200
    else:
        del data[6 * 1024:]
    path.write_bytes(data)
    for read in (samples_of, sample_offsets):
        with open(path, "rb") as stream, pytest.raises(tarfile.ReadError, match="damaged or cut"):
            list(read(stream))


def test_equal_names_in_two_folders(spark, tmp_path):
    for folder, rows in (("a", 5), ("b", 7)):
        spark.range(rows).coalesce(1).write.parquet(f"{tmp_path}/{folder}")
        (made,) = (tmp_path / folder).glob("part-*.parquet")
        made.rename(tmp_path / folder / "part-0.parquet")
    found = count_per_file(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()
    assert sorted((r.file, r.n_rows) for r in found) == [("part-0.parquet", 5), ("part-0.parquet", 7)]
    assert len({r.path for r in found}) == 2


def test_names_with_commas_and_quotes(spark, tmp_path):
    names = ["a,b", 'say "x", then', "plain", "tail,"]
    rows = [(n, 1, 2, 3, None if n == "plain" else 4.5, 0.5, "failed" if n == "plain" else "ok") for n in names]
    table = spark.createDataFrame(rows, "dataset string, num_workers long, prefetch_factor long, batch_size long, "
                                        "throughput double, ttfb double, status string").select(
        *runs.AXES, "throughput", "ttfb", "status")
    runs.append_results(table, f"{tmp_path}/r")
    runs.append_results(table, f"{tmp_path}/r")
    assert sorted(map(tuple, runs.read_results(spark, f"{tmp_path}/r").collect()), key=repr) == sorted(
        [tuple(r) for r in table.collect()] * 2, key=repr)


def test_tar_reads_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from shardloom.session import build_session
from shardloom.sources import register
import os
spark = register(build_session("away", "local[2]", **{{"spark.ui.enabled": "false"}}))
sys.path.remove({ROOT!r})
path = "file://{tmp_path}/set"
rows = spark.range(4).coalesce(1).selectExpr("0L as shard", "string(id) as __key__", "encode(string(id), 'UTF-8') as jpg")
rows.write.format("tarshards").mode("append").save(path)
assert spark.read.format("tarshards").schema("shard string, __key__ string, jpg binary").load(path).count() == 4
print("read")
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=120)
    assert "read" in done.stdout, done.stderr[-1500:]


@pytest.mark.parametrize("mode", ["FAILFAST", "DROPMALFORMED", "PERMISSIVE"])
def test_a_fault_of_the_storage_fails_in_every_mode(spark, tmp_path, mode):
    path = f"file://{tmp_path}/set"
    for first in (0, 1):
        shards(spark, 5, first).write.format("tarshards").mode("append").save(path)
    gone = tmp_path / "set" / "dataset-train-000001.tar"
    gone.rename(tmp_path / "elsewhere.tar")
    read = spark.read.format("tarshards").schema("shard string, __key__ string, jpg binary, _corrupt string").option("mode", mode)
    with pytest.raises(Exception, match="dataset-train-000001"):
        read.load(path).collect()
    (tmp_path / "elsewhere.tar").rename(gone)
    assert read.load(path).count() == 10


@pytest.mark.parametrize("codec", CODECS)
def test_damaged_streams_are_damage(codec):
    good = compressed(bytes(range(256)) * 40, codec)
    assert decompressed(good, codec) == bytes(range(256)) * 40
    with pytest.raises((ValueError, EOFError)):
        decompressed(b"\x01" * 64, codec)


def test_rejected_rasters_add_up(spark, sf_dir):
    from shardloom.operators.raster import rejected, usable

    rows = spark.createDataFrame(
        [(1, 2, 2, 1, bytearray(4)), (2, 2, 2, 1, bytearray(3)), (3, 2, 1, 2, bytearray(4)), (4, 2, 2, 1, None),
         (5, None, 2, 1, bytearray(4))], "sample_id long, height int, width int, channels int, data binary")
    assert [r.sample_id for r in usable(rows).collect()] == [1]
    assert {(r.sample_id, r.reason) for r in rejected(rows).collect()} == {
        (2, "bytes differ from shape"), (3, "channels"), (4, "no data"), (5, "bytes differ from shape")}
    given = mixed(spark, sf_dir)
    assert usable(given).count() + rejected(given).count() == fx.table(spark, sf_dir, "embeddings").count()


def test_constant_vectors_are_one_level(spark, tmp_path):
    spark.createDataFrame([(0, [0.5] * 64), (1, [float(i) for i in range(64)])],
                          "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.sample_id: bytes(r.data) for r in fx.rasters(spark, str(tmp_path)).collect()}
    assert found == {0: bytes(64), 1: bytes(min(i * 256 // 63, 255) for i in range(64))}


def test_an_epoch_of_one_batch_has_a_rate(spark):
    batches = spark.createDataFrame([("a", 1, 12.0, 8), ("a", 2, 20.0, 8), ("b", 1, 9.0, 4)],
                                    "run string, epoch long, ts double, samples long")
    starts = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 16.0)], "run string, epoch long, start_ts double")
    found = {(r.run, r.epoch): (r.elapsed_s, r.throughput) for r in runs.epoch_throughput(batches, starts).collect()}
    assert found == {("a", 1): (2.0, 4.0), ("a", 2): (4.0, 2.0), ("b", 1): (None, None)}
    total = runs.run_totals(batches, spark.createDataFrame([("a", 10.0)], "run string, start_ts double"))
    assert {(r.run, r.samples, r.wall_s) for r in total.collect()} == {("a", 16, 10.0), ("b", 4, None)}


def test_buckets_follow_the_rows(spark, monkeypatch):
    from shardloom.operators import ordering

    monkeypatch.setattr(ordering.bucket_digits, "__defaults__", (100,))
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 100)
    for n, buckets in ((100, 16), (10_000, 256), (1_000_000, 16**4)):
        ids = spark.range(n).withColumnRenamed("id", "sample_id")
        width = ordering.with_order(ids).select(F.max(F.length("bucket"))).first()[0]
        assert 16**width == buckets
    ranged = ordering.range_buckets(spark.range(10_000), ["id"])
    assert ranged.select(F.countDistinct("bucket")).first()[0] > 50


@pytest.mark.parametrize("name", ["append_shards", "preprocess_pipeline"])
def test_the_first_query_of_a_session_writes_its_set(sf_dir, name):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from shardloom.plans import catalog
from shardloom.session import build_session
spark = build_session("first", "local[4]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}})
print("rows:", catalog.QUERIES[{name!r}](spark, {sf_dir!r}).count() > 0)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    assert "rows: True" in done.stdout, done.stderr[-1500:]
