"""Files appear whole, failed attempts leave nothing, repeated attempts change nothing."""

import io
import os

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from shardloom.session import qualified, shared_root
from shardloom.sources import storage
from shardloom.sources.chunks import ChunkWriter
from shardloom.sources.mds import MdsWriter
from shardloom.sources.tar import TarWriter

SCHEMA = StructType([StructField("shard", LongType()), StructField("__key__", StringType()), StructField("jpg", BinaryType())])


def batch(shards, size=100):
    return pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int64()), "__key__": [f"k{n}" for n in range(len(shards))],
                                       "jpg": [bytes(size)] * len(shards)})


def test_paths():
    assert storage.locate("file:/tmp/x/")[1] == "/tmp/x" and storage.locate("/tmp/x")[1] == "/tmp/x"
    assert storage.locate("file:///tmp/x")[1] == "/tmp/x"


def test_qualified_paths(spark):
    assert qualified(spark, "/tmp/x") == "file:/tmp/x"
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_root(spark) == configured.rstrip("/")


@pytest.mark.parametrize("writer", [TarWriter, MdsWriter, ChunkWriter])
def test_a_failed_attempt_leaves_no_file(tmp_path, writer):
    def rows():
        yield batch([0, 0, 1])
        raise OSError("executor lost")

    attempt = writer({"path": str(tmp_path)}, SCHEMA, True)
    with pytest.raises(OSError):
        attempt.write(rows())
    # In the job's folder the finished shard stays until a retry replaces it; the open one is gone.
    (folder,) = tmp_path.iterdir()
    assert folder.name.startswith("_") and len(os.listdir(folder)) == 1
    before = {n: (folder / n).read_bytes() for n in os.listdir(folder)}
    retry, again = (attempt.write(iter([batch([0, 0, 1])])) for _ in range(2))
    assert [e["file"] for e in retry.entries] == [e["file"] for e in again.entries] and len(retry.entries) == 2
    assert all((folder / n).read_bytes() == data for n, data in before.items())
    assert sorted(os.listdir(folder)) == sorted(e["file"] for e in retry.entries)
    attempt.commit([retry])
    assert sorted(os.listdir(tmp_path)) == sorted(["index.json", *(e["file"] for e in retry.entries)])


def test_a_task_without_rows(tmp_path):
    attempt = TarWriter({"path": str(tmp_path)}, SCHEMA, True)
    message = attempt.write(iter([batch([])]))
    assert message.entries == []
    attempt.commit([message, None])
    assert os.listdir(tmp_path) == ["index.json"]


def test_two_tasks_with_one_shard(tmp_path):
    attempt = TarWriter({"path": str(tmp_path)}, SCHEMA, True)
    messages = [attempt.write(iter([batch([0])])), attempt.write(iter([batch([0])]))]
    with pytest.raises(ValueError, match="two tasks"):
        attempt.commit(messages)


def test_object_stores_get_complete_content_only(monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "is_object_store", lambda filesystem: True)
    filesystem = pafs.LocalFileSystem()
    with pytest.raises(RuntimeError):
        with storage.replacing(filesystem, f"{tmp_path}/a") as stream:
            stream.write(b"half")
            raise RuntimeError
    assert os.listdir(tmp_path) == []
    with storage.replacing(filesystem, f"{tmp_path}/a") as stream:
        stream.write(b"whole")
    assert (tmp_path / "a").read_bytes() == b"whole"


def test_tar_shards_are_held_the_same_way(monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "is_object_store", lambda filesystem: True)
    writer = TarWriter({"path": str(tmp_path)}, SCHEMA, True)
    writer.commit([writer.write(iter([batch([3, 3])]))])
    data = (tmp_path / "dataset-train-000003.tar").read_bytes()
    import tarfile

    assert tarfile.open(fileobj=io.BytesIO(data)).getnames() == ["k0.jpg", "k1.jpg"]
