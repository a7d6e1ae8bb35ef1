"""Sets are what was committed last, whenever a job or its driver is lost."""

import os

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from shardloom.plans.prepare import read_shards
from shardloom.sources import commits
from shardloom.sources.chunks import ChunkWriter
from shardloom.sources.listing import list_shards
from shardloom.sources.mds import MdsWriter
from shardloom.sources.tar import TarWriter

SCHEMA = StructType([StructField("shard", LongType()), StructField("__key__", StringType()), StructField("jpg", BinaryType())])
FORMATS = {"tarshards": TarWriter, "mds": MdsWriter, "chunks": ChunkWriter}
LOCAL = pafs.LocalFileSystem()


def batch(shards, mark):
    return pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int64()), "__key__": [f"{mark}{n}" for n in range(len(shards))],
                                       "jpg": [mark.encode()] * len(shards)})


def written(path, kind, mark, shards, overwrite=True):
    job = FORMATS[kind]({"path": str(path)}, SCHEMA, overwrite)
    return job, [job.write(iter([batch(shards, mark)]))]


def keys(spark, kind, path):
    rows = read_shards(spark, kind, str(path), "shard string, __key__ string, jpg binary")
    return sorted((r["__key__"], bytes(r.jpg).decode()) for r in rows.collect())


def expected(mark, n):
    return [(f"{mark}{i}", mark) for i in range(n)]


@pytest.mark.parametrize("kind", FORMATS)
def test_aborted_jobs_leave_the_set(spark, tmp_path, kind):
    job, messages = written(tmp_path, kind, "a", [0, 0, 1, 2])
    job.commit(messages)
    before = sorted(os.listdir(tmp_path))
    for overwrite, shards in ((True, [0, 1]), (False, [7, 8])):
        job, messages = written(tmp_path, kind, "b", shards, overwrite)
        assert keys(spark, kind, tmp_path) == expected("a", 4)
        if kind == "tarshards":
            assert list_shards(spark, str(tmp_path)).count() == 3
        job.abort(messages)
        assert sorted(os.listdir(tmp_path)) == before
    assert keys(spark, kind, tmp_path) == expected("a", 4)


@pytest.mark.parametrize("kind", FORMATS)
@pytest.mark.parametrize("moved", [0, 1, 2])
def test_a_lost_driver_is_made_up_for(spark, tmp_path, kind, moved, monkeypatch):
    """The journal is there and some files have moved: the new set is read, and the next writer finishes it."""
    job, messages = written(tmp_path, kind, "a", [0, 0, 1, 2])
    job.commit(messages)
    job, messages = written(tmp_path, kind, "b", [0, 1, 1])
    monkeypatch.setattr(commits, "finish", lambda filesystem, base: None)
    job.commit(messages)
    monkeypatch.undo()
    folder = commits.folder_of(str(tmp_path), job.job)
    for name in sorted(os.listdir(folder))[:moved]:
        LOCAL.move(f"{folder}/{name}", f"{tmp_path}/{name}")
    job.abort(messages)  # what Spark does when the commit call was lost
    assert keys(spark, kind, tmp_path) == expected("b", 3)
    job, messages = written(tmp_path, kind, "c", [5], overwrite=False)
    job.commit(messages)
    assert keys(spark, kind, tmp_path) == sorted(expected("b", 3) + expected("c", 1))
    assert not [n for n in os.listdir(tmp_path) if n.startswith("_")] and len(os.listdir(tmp_path)) == 4


def test_two_appends_of_one_number(tmp_path):
    (first, messages), (second, others) = (written(tmp_path, "tarshards", m, [3], overwrite=False) for m in "ab")
    first.commit(messages)
    with pytest.raises(ValueError, match="meanwhile"):
        second.commit(others)
    second.abort(others)
    assert sorted(os.listdir(tmp_path)) == ["dataset-train-000003.tar", "index.json"]


def test_hidden_jobs_are_no_foreign_shards(spark, tmp_path):
    """A set without an index is listed, but not what a job is writing into it."""
    job, messages = written(tmp_path / "sets" / "one", "tarshards", "a", [0])
    job.commit(messages)
    written(tmp_path / "sets" / "two", "tarshards", "b", [0])
    assert keys(spark, "tarshards", tmp_path / "sets") == expected("a", 1)
    os.remove(tmp_path / "sets" / "one" / "index.json")
    assert keys(spark, "tarshards", tmp_path / "sets") == expected("a", 1)


def test_spark_aborts_and_retries(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    rows = spark.range(30).coalesce(1).select((F.col("id") / 10).cast("long").alias("shard"), F.col("id").cast("string").alias("__key__"),
                                              F.encode(F.col("id").cast("string"), "UTF-8").alias("jpg"))
    rows.write.format("tarshards").mode("overwrite").save(path)
    lost = rows.withColumn("jpg", F.when(F.col("shard") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("jpg")))
    for mode, shift in (("overwrite", 0), ("append", 10)):
        with pytest.raises(Exception, match="lost"):
            lost.withColumn("shard", F.col("shard") + shift).write.format("tarshards").mode(mode).save(path)
        assert sorted(os.listdir(tmp_path / "set")) == [f"dataset-train-{n:06d}.tar" for n in range(3)] + ["index.json"]
        assert len(keys(spark, "tarshards", path)) == 30
