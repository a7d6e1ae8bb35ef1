"""Sets whose index is in lists: planned without an entry per shard, appended and overwritten list by list."""

import os

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql.datasource import EqualTo
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from shardloom.plans.prepare import read_shards
from shardloom.sources import commits, shardlists
from shardloom.sources.indexed_tar import tar_sample_index
from shardloom.sources.storage import read_json
from shardloom.sources.tar import TarReader, TarWriter

SCHEMA = StructType([StructField("shard", LongType()), StructField("__key__", StringType()), StructField("jpg", BinaryType())])
LOCAL = pafs.LocalFileSystem()
DDL = "shard string, __key__ string, jpg binary"


def written(path, mark, shards, overwrite=True, per_list=4):
    options = {"path": str(path), **({"shards_per_list": str(per_list)} if per_list else {})}
    job = TarWriter(options, SCHEMA, overwrite)
    rows = pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int64()), "__key__": [f"{mark}{n:03d}" for n in shards],
                                       "jpg": [mark.encode() * (n + 1) for n in shards]})
    return job, [job.write(iter([rows]))]


def put(path, mark, shards, **how):
    job, messages = written(path, mark, shards, **how)
    job.commit(messages)


def name(n):
    return f"dataset-train-{n:06d}.tar"


def keys(spark, path, **options):
    return sorted(r["__key__"] for r in read_shards(spark, "tarshards", str(path), DDL, **options).collect())


def reader(path, **options):
    return TarReader({"path": str(path), **options}, StructType([StructField("shard", StringType()), *SCHEMA.fields[1:]]))


def test_index_has_a_line_per_list(spark, tmp_path):
    put(tmp_path, "a", range(10))
    index = read_json(LOCAL, f"{tmp_path}/index.json")
    assert index["shards"] == [] and index["per_list"] == 4
    assert [(x["number"], x["shards"], x["samples"], x["first"], x["last"]) for x in index["lists"]] == [
        (0, 4, 4, name(0), name(3)), (1, 4, 4, name(4), name(7)), (2, 2, 2, name(8), name(9))]
    assert keys(spark, tmp_path) == [f"a{n:03d}" for n in range(10)]
    assert keys(spark, tmp_path, split="val") == []
    assert tar_sample_index(spark, str(tmp_path)).count() == 10


def test_planning_reads_no_list(tmp_path, monkeypatch):
    """Tasks get slices of lists, which they read; a filter leaves the lists that may hold its shards."""
    put(tmp_path, "a", range(40))
    read, found = shardlists.read, []
    monkeypatch.setattr(shardlists, "read", lambda *a: pytest.fail("a list was read"))
    whole = reader(tmp_path, bytes_per_task="25000")
    planned = whole.partitions()
    few = reader(tmp_path)
    assert list(few.pushFilters([EqualTo(("shard",), name(17))])) == []
    one = few.partitions()
    monkeypatch.setattr(shardlists, "read", read)
    assert len(planned) == 20 and [p.listed["number"] for p in one] == [4]
    for piece in planned:
        found += [k for b in whole.read(piece) for k in b.column("__key__").to_pylist()]
    assert sorted(found) == [f"a{n:03d}" for n in range(40)] and len(set(found)) == 40
    assert [k for b in few.read(one[0]) for k in b.column("__key__").to_pylist()] == ["a017"]


def test_slices_cover_a_list_once(tmp_path):
    entries = [{"shard": n, "file": name(n), "samples": 1, "bytes": b} for n, b in enumerate([5, 0, 900, 1, 1, 70, 0, 40])]
    (line,) = shardlists.write(LOCAL, str(tmp_path), "job", entries, 100)
    for target in (1, 10, 100, 10_000):
        pieces = shardlists.slices([line], None, target, None)
        held = [e["file"] for p in pieces for e in shardlists.of_slice(LOCAL, str(tmp_path), p, lambda e: True)]
        assert held == [e["file"] for e in entries]
    empty = [{**e, "bytes": 0} for e in entries]
    (line,) = shardlists.write(LOCAL, str(tmp_path), "none", empty, 100)
    pieces = shardlists.slices([line], None, 0, None)
    assert len(shardlists.of_slice(LOCAL, str(tmp_path), pieces[0], lambda e: True)) == len(entries)


def test_appends_replace_the_lists_they_add_to(spark, tmp_path):
    put(tmp_path, "a", [0, 1, 4, 5, 8])
    before = {x["number"]: x["file"] for x in read_json(LOCAL, f"{tmp_path}/index.json")["lists"]}
    put(tmp_path, "b", [2, 12], overwrite=False, per_list=None)
    after = {x["number"]: x["file"] for x in read_json(LOCAL, f"{tmp_path}/index.json")["lists"]}
    assert set(after) == {0, 1, 2, 3} and after[1] == before[1] and after[2] == before[2] and after[0] != before[0]
    assert not os.path.exists(f"{tmp_path}/{before[0]}")
    assert keys(spark, tmp_path) == ["a000", "a001", "a004", "a005", "a008", "b002", "b012"]
    with pytest.raises(ValueError, match="is in the set"):
        written(tmp_path, "c", [5], overwrite=False)
    job, messages = written(tmp_path, "c", [6], overwrite=False)
    put(tmp_path, "d", [6], overwrite=False)
    with pytest.raises(ValueError, match="meanwhile"):
        job.commit(messages)
    job.abort(messages)
    assert "d006" in keys(spark, tmp_path) and "c006" not in keys(spark, tmp_path)


@pytest.mark.parametrize("first,second", [(4, 3), (4, None), (None, 4)])
def test_overwrites_leave_nothing_behind(spark, tmp_path, first, second):
    put(tmp_path, "a", range(9), per_list=first)
    put(tmp_path, "b", [1, 2, 5], per_list=second)
    assert keys(spark, tmp_path) == ["b001", "b002", "b005"]
    assert sorted(n for n in os.listdir(tmp_path) if n.endswith(".tar")) == [name(1), name(2), name(5)]
    lists = [n for n in os.listdir(tmp_path) if n.startswith("_shards")]
    assert len(lists) == (2 if second else 0)


@pytest.mark.parametrize("moved", [0, 2, 4])
def test_a_lost_driver(spark, tmp_path, moved, monkeypatch):
    """Some files of a committed job have moved, lists among them: the new set is read, and the next append finishes it."""
    put(tmp_path, "a", range(6))
    job, messages = written(tmp_path, "b", [6, 7], overwrite=False)
    monkeypatch.setattr(commits, "finish", lambda filesystem, base: None)
    job.commit(messages)
    monkeypatch.undo()
    folder = commits.folder_of(str(tmp_path), job.job)
    for file in sorted(os.listdir(folder))[:moved]:
        LOCAL.move(f"{folder}/{file}", f"{tmp_path}/{file}")
    expected = [f"a{n:03d}" for n in range(6)] + ["b006", "b007"]
    assert keys(spark, tmp_path) == expected
    put(tmp_path, "c", [8], overwrite=False)
    assert keys(spark, tmp_path) == [*expected, "c008"] and not os.path.exists(folder)


def test_epochs_and_workers_see_all_shards(spark, tmp_path):
    put(tmp_path, "a", range(10))
    put(tmp_path / "plain", "a", range(10), per_list=None)
    read = lambda path: [(r.worker, r.place, r["__key__"]) for r in read_shards(
        spark, "tarshards", str(path), DDL + ", worker int, place long", workers="3", epoch="1").orderBy("worker", "place").collect()]
    assert read(tmp_path) == read(tmp_path / "plain") and len(read(tmp_path)) == 10


def test_a_lost_list_is_an_error(spark, tmp_path):
    put(tmp_path, "a", range(3))
    line = read_json(LOCAL, f"{tmp_path}/index.json")["lists"][0]
    with pytest.raises(FileNotFoundError):
        shardlists.read(LOCAL, str(tmp_path / "none"), line)
