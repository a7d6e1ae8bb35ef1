"""What a set says about itself: samples as their writer lists them, damaged shards, the status of files."""

import io
import tarfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from shardloom.operators.ordering import with_file_rows
from shardloom.plans import fixtures as fx
from shardloom.plans.prepare import read_shards, write_tar
from shardloom.session import fresh_dir
from shardloom.sources.indexed_tar import sample_offsets, tar_sample_index
from shardloom.sources.listing import damaged, file_status, list_shards
from shardloom.sources.storage import ForwardReader, locate, read_json
from shardloom.sources.tar import SAMPLES, read_listing


class Counted:
    """A file on a store, where each read is a request."""

    def __init__(self, data):
        self.data, self.requests, self.bytes = data, 0, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.requests += 1
        found = self.data[at:at + n]
        self.bytes += len(found)
        return found


def archive(n, size):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w", format=tarfile.USTAR_FORMAT) as out:
        for i in range(n):
            for part in ("jpg", "txt"):
                member = tarfile.TarInfo(f"k{i}.{part}")
                member.size = size
                out.addfile(member, io.BytesIO(bytes(size)))
    return held.getvalue()


@pytest.mark.parametrize("size, block, most", [(3000, 1 << 18, 4), (100_000, 1 << 16, 82), (0, 512, 90)])
def test_headers_are_read_in_blocks(size, block, most):
    data = archive(40, size)
    source = Counted(data)
    assert list(sample_offsets(ForwardReader(source, block))) == list(sample_offsets(io.BytesIO(data)))
    # Small members share a block; large ones are skipped over and cost at most a request each.
    assert source.requests <= most and source.bytes <= len(data) + most * block
    if size > block:
        assert source.bytes < len(data)


def test_writers_list_their_samples(spark, sf_dir):
    def write(**options):
        return write_tar(fx.samples(spark, sf_dir), fresh_dir(spark, "tar"), fx.TAR_BYTES, 20, least_bytes=0, **options)

    listed, plain = write(offsets=True), write()
    read = lambda path: sorted(map(tuple, tar_sample_index(spark, path).collect()))
    assert read(listed) == read(plain)
    filesystem, base = locate(listed)
    entries = read_json(filesystem, f"{base}/index.json")["shards"]
    assert all(read_listing(filesystem, f"{base}/{e['file']}{SAMPLES}").num_rows == e["samples"] for e in entries)
    # The shards themselves are not opened: the index is the same without their bytes.
    for e in entries:
        with filesystem.open_output_stream(f"{base}/{e['file']}") as stream:
            stream.write(b"")
    assert read(listed) == read(plain)
    # An overwrite without listings takes them away with their shards.
    rows = spark.range(5).select(F.lit(0).cast("long").alias("shard"), F.col("id").cast("string").alias("__key__"),
                                 F.encode(F.col("id").cast("string"), "UTF-8").alias("jpg")).coalesce(1)
    rows.write.format("tarshards").mode("overwrite").save(listed)
    assert sorted(i.base_name for i in filesystem.get_file_info(pafs.FileSelector(base))) == ["dataset-train-000000.tar", "index.json"]
    assert list_shards(spark, listed).count() == 1


def test_dropped_shards_are_reported(spark, tmp_path):
    path, report = f"file://{tmp_path}/set", f"file://{tmp_path}/report"
    rows = spark.range(30).coalesce(1).select((F.col("id") / 10).cast("long").alias("shard"), F.col("id").cast("string").alias("__key__"),
                                              F.encode(F.col("id").cast("string"), "UTF-8").alias("jpg"))
    rows.write.format("tarshards").mode("overwrite").save(path)
    schema = "shard string, __key__ string, jpg binary"
    read = lambda **o: read_shards(spark, "tarshards", path, schema, report=report, **o)
    assert read().count() == 30 and damaged(spark, report).count() == 0
    file = tmp_path / "set" / "dataset-train-000001.tar"
    file.write_bytes(file.read_bytes()[:4 * 1024])
    for mode, n in (("DROPMALFORMED", 23), ("DROPMALFORMED", 23), ("PERMISSIVE", 23)):
        assert read(mode=mode).filter("jpg is not null").count() == n
        # Whether the last sample before the cut has all its members isn't known, so it isn't delivered.
        (row,) = damaged(spark, report).collect()
        assert (row.shard, row.delivered, row.samples) == ("dataset-train-000001.tar", 3, 10) and "cut" in row.reason
    with pytest.raises(Exception, match="damaged or cut"):
        read(mode="FAILFAST").collect()


def test_file_status(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/set/a")
    spark.range(0).coalesce(1).write.parquet(f"{tmp_path}/set/b")
    (tmp_path / "set" / "c.parquet").write_bytes(b"PAR1 no footer")
    found = sorted((r.status, r.n_rows, r.reason is None) for r in file_status(spark, f"{tmp_path}/set").collect())
    assert found[:1] == [("damaged", None, False)] and [f for f in found if f[0] == "ok"] == [("ok", 7, True)]
    assert sorted(f[0] for f in found) == ["damaged", "empty", "ok"]


def test_rows_of_files_are_numbered(spark, tmp_path):
    path = f"{tmp_path}/set"
    (spark.range(20_000).repartitionById(2, (F.col("id") % 2).cast("int")).sortWithinPartitions(F.desc("id"))
     .write.option("parquet.block.size", 4096).option("parquet.page.size", 512).parquet(path))
    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(f).num_row_groups for f in tmp_path.glob("set/*.parquet")]
    assert len(groups) == 2 and min(groups) > 1
    rows = with_file_rows(spark.read.option("maxPartitionBytes", "4k").parquet(path)).orderBy("file", "row").collect()
    assert [r.id for r in rows] == [*range(19_998, -1, -2), *range(19_999, 0, -2)]
    assert [r.row for r in rows] == [*range(10_000)] * 2
