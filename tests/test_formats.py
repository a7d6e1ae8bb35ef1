"""Shard files: round trips, independent readers, damage, retries and misuse."""

import glob
import hashlib
import io
import json
import os
import struct
import tarfile

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from shardloom.operators.checks import reconcile
from shardloom.plans.prepare import read_shards, write_chunks, write_mds, write_tar
from shardloom.session import fresh_dir
from shardloom.sources.indexed_tar import prepare_index, tar_sample_index
from shardloom.sources.mds import read_samples
from shardloom.sources.storage import locate
from shardloom.sources.tar import TarWriter


def local(path):
    return locate(path)[1]


@pytest.fixture(scope="module")
def flat(spark):
    image = F.encode(F.repeat(F.concat(F.lit("é"), F.col("id").cast("string")), (F.col("id") * 13 % 90).cast("int")), "UTF-8")
    return spark.range(300).select(F.col("id").alias("sample_id"), image.alias("image"),
                                   F.concat(F.lit("caption "), "id").alias("text"))


@pytest.fixture(scope="module")
def tar_path(spark, flat):
    return write_tar(flat, fresh_dir(spark, "tar"), 2000, 40, least_bytes=0, hashes="sha256,crc32")


def contents(flat):
    return {r.sample_id: (bytes(r.image), r.text) for r in flat.collect()}


def test_tar_with_the_plain_tar_reader(flat, tar_path):
    found = {}
    for name in sorted(glob.glob(f"{local(tar_path)}/*.tar")):
        with tarfile.open(name) as archive:
            held = rows = 0
            for member in archive:
                key, part = member.name.split(".")
                data = archive.extractfile(member).read()
                found.setdefault(int(key.removeprefix("train_")), {})[part] = data
                assert member.mtime == 0
                rows += part == "txt"
                held += len(data)
            assert rows <= 40 and held < 2000 + 500
    expected = contents(flat)
    assert {k: (v["jpg"], v["txt"].decode()) for k, v in found.items()} == expected


def test_tar_index_describes_the_files(tar_path):
    index = json.load(open(f"{local(tar_path)}/index.json"))
    assert [s["file"] for s in index["shards"]] == [f"dataset-train-{n:06d}.tar" for n in range(len(index["shards"]))]
    for shard in index["shards"]:
        data = open(f"{local(tar_path)}/{shard['file']}", "rb").read()
        assert len(data) == shard["bytes"] and len(data) % 10240 == 0
        assert hashlib.sha256(data).hexdigest() == shard["hashes"]["sha256"]
    assert not [f for f in os.listdir(local(tar_path)) if f.endswith(".part")]


def test_writing_again_gives_the_same_bytes(spark, flat, tar_path):
    again = write_tar(flat.repartition(5), fresh_dir(spark, "tar"), 2000, 40, least_bytes=0, digits=2)
    for name in sorted(os.listdir(local(tar_path))):
        if name.endswith(".tar"):
            assert open(f"{local(tar_path)}/{name}", "rb").read() == open(f"{local(again)}/{name}", "rb").read()


def test_read_modes_of_a_truncated_shard(spark, flat):
    path = write_tar(flat, fresh_dir(spark, "tar"), 2000, 40, least_bytes=0)
    victim = f"{local(path)}/dataset-train-000001.tar"
    data = open(victim, "rb").read()
    open(victim, "wb").write(data[:6000])
    with pytest.raises(Exception):
        read_shards(spark, "tarshards", path).collect()
    kept = read_shards(spark, "tarshards", path, mode="DROPMALFORMED").count()
    assert 260 <= kept < 300
    rows = read_shards(spark, "tarshards", path, "shard string, __key__ string, jpg binary, _corrupt string",
                       mode="PERMISSIVE").collect()
    assert sum(r._corrupt is None for r in rows) == kept
    assert [r.shard for r in rows if r._corrupt] == ["dataset-train-000001.tar"]


def test_shard_filter_prunes_files(spark, tar_path):
    rows = read_shards(spark, "tarshards", tar_path).filter(F.col("shard") == "dataset-train-000002.tar")
    assert rows.rdd.getNumPartitions() == 1
    assert {r.shard for r in rows.select("shard").collect()} == {"dataset-train-000002.tar"}
    everything = read_shards(spark, "tarshards", tar_path, bytes_per_task="1")
    assert everything.rdd.getNumPartitions() > 5


def test_split_and_prefix_select_shards(spark, tar_path):
    assert read_shards(spark, "tarshards", tar_path, split="train", prefix="dataset").count() == 300
    assert read_shards(spark, "tarshards", tar_path, split="val", prefix="dataset").count() == 0


@pytest.mark.parametrize("compression", ["", "zstd", "gz"])
def test_mds_round_trip(spark, flat, compression):
    path = write_mds(flat, fresh_dir(spark, "mds"), 2500, compression=compression, hashes="sha1,crc32")
    rows = read_shards(spark, "mds", path).collect()
    assert {r.idx: (bytes(r.image), r.text) for r in rows} == contents(flat) and len(rows) == 300
    index = json.load(open(f"{local(path)}/index.json"))
    assert all(s["raw_data"]["bytes"] <= 2500 for s in index["shards"])
    assert index["shards"][0]["column_names"] == ["idx", "image", "text"]
    for shard in index["shards"]:
        stored = shard["zip_data"] or shard["raw_data"]
        data = open(f"{local(path)}/{stored['basename']}", "rb").read()
        assert hashlib.sha1(data).hexdigest() == stored["hashes"]["sha1"]


def test_mds_layout(spark, flat):
    path = write_mds(flat, fresh_dir(spark, "mds"), 2500)
    data = open(f"{local(path)}/shard.00000.mds", "rb").read()
    n = struct.unpack("<I", data[:4])[0]
    offsets = struct.unpack(f"<{n + 1}I", data[4:4 + 4 * (n + 1)])
    header = json.loads(data[4 + 4 * (n + 1):offsets[0]])
    assert offsets[-1] == len(data) and header["column_encodings"] == ["int", "jpeg", "str"]
    sizes = struct.unpack("<2I", data[offsets[0]:offsets[0] + 8])
    assert 8 + 8 + sum(sizes) == offsets[1] - offsets[0]
    with pytest.raises(ValueError):
        list(read_samples(data[:-1], header))


def test_mds_random_access_by_shard(spark, flat):
    path = write_mds(flat, fresh_dir(spark, "mds"), 2500)
    rows = read_shards(spark, "mds", path).filter("shard = 'shard.00003.mds'")
    assert 0 < rows.count() < 300 and rows.rdd.getNumPartitions() == 1


def test_chunks_keep_order_and_nulls(spark, flat):
    half = flat.withColumn("text", F.when(F.col("sample_id") % 2 == 0, F.col("text")))
    path = write_chunks(half, fresh_dir(spark, "chunks"), F.col("sample_id") % 3, F.col("sample_id") % 6,
                        F.col("sample_id"), 3000, rows_per_part=20)
    index = json.load(open(f"{local(path)}/index.json"))
    assert sum(c["chunk_size"] for c in index["chunks"]) == 300 and index["config"]["compression"] == "zstd"
    read = read_shards(spark, "chunks", path).collect()
    expected = contents(half)
    assert sorted(((bytes(r.image_bytes), r.text) for r in read), key=repr) == sorted(expected.values(), key=repr)
    # Independent reading: the plain codec and the offsets.
    order = []
    for number in range(sum(c["filename"].startswith("chunk-1-") for c in index["chunks"])):
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(
            open(f"{local(path)}/chunk-1-{number}.zstd.bin", "rb").read())
        n = struct.unpack("<I", raw[:4])[0]
        offsets = struct.unpack(f"<{n + 1}I", raw[4:8 + 4 * n])
        assert offsets[-1] == len(raw)
        for at in offsets[:-1]:
            size = struct.unpack("<I", raw[at:at + 4])[0]
            order.append(raw[at + 8:at + 8 + size])
    mine = [i for f in (1, 4) for i in range(300) if i % 6 == f]
    assert order == [expected[i][0] for i in mine]


def test_every_sample_is_written_once(spark, flat):
    path = write_mds(flat, fresh_dir(spark, "mds"), 4000)
    ids = read_shards(spark, "mds", path).select(F.col("idx").alias("sample_id"))
    assert reconcile(flat, ids).count() == 0
    broken = ids.filter("sample_id <> 7").unionByName(ids.filter("sample_id = 8")).unionByName(
        spark.createDataFrame([(999,)], "sample_id long"))
    found = {r.sample_id: r.problem for r in reconcile(flat, broken).collect()}
    assert found == {7: "missing", 8: "duplicated", 999: "unexpected"}


def test_bad_rows_are_set_aside(spark, flat):
    some = flat.withColumn("text", F.when(F.col("sample_id") > 9, F.col("text")))
    path, rejects = fresh_dir(spark, "tar"), fresh_dir(spark, "rejects")
    write_tar(some, path, 2000, 40, least_bytes=0, rejects=rejects)
    assert read_shards(spark, "tarshards", path).count() == 290
    assert {(r.sample_id, r.reason) for r in spark.read.parquet(rejects).collect()} == {
        (n, "missing text") for n in range(10)}


def test_overwrite_drops_old_shards(spark, flat):
    path = write_tar(flat, fresh_dir(spark, "tar"), 2000, 40, least_bytes=0)
    before = len(glob.glob(f"{local(path)}/*.tar"))
    write_tar(flat, path, 20_000, 400, least_bytes=0)
    assert len(glob.glob(f"{local(path)}/*.tar")) < before
    assert read_shards(spark, "tarshards", path).count() == 300


def test_rows_that_are_not_clustered_fail(spark, flat):
    rows = flat.select((F.col("sample_id") % 2).alias("shard"), F.col("sample_id").cast("string").alias("__key__"), "image")
    with pytest.raises(Exception, match="two tasks|not sorted"):
        rows.repartition(4).write.format("tarshards").mode("overwrite").save(fresh_dir(spark, "tar"))
    with pytest.raises(ValueError, match="shard"):
        TarWriter({"path": "/x"}, rows.drop("shard").schema, True)


def test_index_in_place_and_slices(spark, flat, tar_path):
    samples = {(r.shard, r.row): r for r in tar_sample_index(spark, tar_path).collect()}
    assert len(samples) == 300
    for (shard, _), row in list(samples.items())[:20]:
        with open(f"{local(tar_path)}/{shard}", "rb") as stream:
            stream.seek(row.begin)
            with tarfile.open(fileobj=io.BytesIO(stream.read(row.end - row.begin)), mode="r|") as archive:
                names = [m.name for m in archive]
        assert names == [f"{row.key}.jpg", f"{row.key}.txt"]
    shards = prepare_index(spark, tar_path, {"image": "jpg", "caption": "txt"}, (1, 0, 0))
    assert {s["split"] for s in shards} == {"train"} and sum(s["samples"] for s in shards) == 300
    rows = read_shards(spark, "tarslices", tar_path, workers="5", max_len="7").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(300))
    assert [r.worker for r in rows] == [p * 5 // 300 for p in range(300)]
    assert {r["__key__"]: bytes(r.image) for r in rows} == {
        f"train_{k:07d}": v[0] for k, v in contents(flat).items()}
    assert rows[0].caption.startswith("caption ")


def test_split_shards_of_an_index(spark, flat):
    path = write_tar(flat, fresh_dir(spark, "tar"), 2000, 40, least_bytes=0)
    shards = prepare_index(spark, path, {"image": "jpg", "caption": "txt"}, (8, 1, 1))
    sizes = {name: sum(s["samples"] for s in shards if s["split"] == name) for name in ("train", "val", "test")}
    assert min(sizes.values()) > 0
    for name, size in sizes.items():
        assert read_shards(spark, "tarslices", path, workers="3", split=name).count() == size


def test_a_foreign_tar_set(spark, tmp_path):
    for n in range(2):
        with tarfile.open(tmp_path / f"benchmark-train-{n:06d}.tar", "w") as archive:
            for i in range(3):
                for part, data in (("jpg", b"\xff\xd8\xff" + bytes([i])), ("txt", b"t")):
                    member = tarfile.TarInfo(f"dir/{n}{i}.{part}")
                    member.size = len(data)
                    archive.addfile(member, io.BytesIO(data))
    rows = read_shards(spark, "tarshards", str(tmp_path), split="train", prefix="benchmark").collect()
    assert sorted(r["__key__"] for r in rows) == ["dir/00", "dir/01", "dir/02", "dir/10", "dir/11", "dir/12"]
    assert all(bytes(r.jpg).startswith(b"\xff\xd8\xff") and bytes(r.txt) == b"t" for r in rows)


def test_a_row_larger_than_a_shard(spark):
    table = spark.createDataFrame([(n, bytes([n % 251]) * (50_000 if n == 3 else 10), "t") for n in range(20)],
                                  "sample_id long, image binary, text string")
    path = write_mds(table, fresh_dir(spark, "mds"), 1000)
    index = json.load(open(f"{local(path)}/index.json"))
    assert [s["samples"] for s in index["shards"] if s["raw_data"]["bytes"] > 1000] == [1]
    assert read_shards(spark, "mds", path).count() == 20


def test_arrow_types_of_the_readers(spark, tar_path):
    batches = read_shards(spark, "tarshards", tar_path).toArrow()
    assert batches.schema.field("jpg").type in (pa.binary(), pa.large_binary())
