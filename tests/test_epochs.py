"""Epochs on load: which shards a task plans, what a buffer emits, what a batch holds."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from shardloom.operators.loading import stack_tensors
from shardloom.operators.ordering import shuffle_through_buffer
from shardloom.operators.raster import preprocess
from shardloom.plans import fixtures as fx
from shardloom.plans.measure import load_epoch
from shardloom.plans.prepare import read_shards, write_mds, write_tar
from shardloom.session import fresh_dir
from shardloom.sources.indexed_tar import SliceReader, prepare_index
from shardloom.sources.shardfiles import deal, epoch_order
from shardloom.sources.tar import TarReader


@pytest.fixture(scope="module")
def tar_path(spark, sf_dir):
    return write_tar(fx.samples(spark, sf_dir), fresh_dir(spark, "tar"), fx.TAR_BYTES, 20, least_bytes=0)


def planned(path, filters=(), **options):
    reader = TarReader({"path": path, **options}, None)
    left = list(reader.pushFilters(list(filters)))
    return [[f["file"] for f in p.files] for p in reader.partitions()], left


def test_partitions_follow_the_epoch(tar_path):
    (plain, _), (one, _), (again, _), (two, _) = (planned(tar_path, **o) for o in (
        {"workers": "3"}, *({"workers": "3", "epoch": e, "seed": "7"} for e in ("1", "1", "2"))))
    assert one == again and one != two and one != plain and len(one) == 3
    files = sorted(f for run in plain for f in run)
    assert all(sorted(f for run in runs for f in run) == files for runs in (one, two))
    order = sorted(files, key=lambda f: hashlib.md5(f"7:1:{f}".encode()).hexdigest())
    assert one == [order[w::3] for w in range(3)]
    (more, _) = planned(tar_path, workers="99", epoch="1", seed="7")
    assert more == [[f] for f in order]
    (cut, _) = planned(tar_path, workers="3", epoch="1", seed="7", bytes_per_task="1")
    assert sorted(f for run in cut for f in run) == files and all(len(run) == 1 for run in cut)


def test_a_worker_plans_its_own_share(tar_path):
    every, _ = planned(tar_path, workers="3", epoch="1")
    above = GreaterThan(("place",), 3)
    mine, left = planned(tar_path, [EqualTo(("worker",), 1), above], workers="3", epoch="1")
    assert mine == [every[1]] and left == [above]
    some, left = planned(tar_path, [In(("worker",), (0, 2)), In(("shard",), (every[2][0], every[1][0]))], workers="3", epoch="1")
    assert some == [[every[2][0]]] and left == []
    # Without workers there is no such column to decide by.
    assert planned(tar_path, [EqualTo(("worker",), 1)])[1] == [EqualTo(("worker",), 1)]


def test_places_do_not_depend_on_filters_or_tasks(spark, tar_path):
    def read(**options):
        rows = read_shards(spark, "tarshards", tar_path, workers="3", epoch="4", **options)
        return {(r.worker, r.place): r["__key__"] for r in rows.select("worker", "place", "__key__").collect()}

    every = read()
    assert read(bytes_per_task="1") == every
    assert {w for w, _ in every} == {0, 1, 2}
    for worker in range(3):
        assert sorted(p for w, p in every if w == worker) == list(range(sum(w == worker for w, _ in every)))
    only = read_shards(spark, "tarshards", tar_path, workers="3", epoch="4").filter("worker = 2").collect()
    assert {(2, r.place): r["__key__"] for r in only} == {k: v for k, v in every.items() if k[0] == 2}


def test_uncounted_shards_are_one_task_a_worker():
    shards = [{"file": str(n), "bytes": 1} for n in range(5)]
    assert [[s["first"] for s in mine] for mine in deal(epoch_order(shards, 1, 1), 2)] == [[0, None, None], [0, None]]


def test_slices_of_one_worker(spark, tar_path):
    prepare_index(spark, tar_path, {"image": "jpg", "caption": "txt"})

    def runs(filters=(), **options):
        reader = SliceReader({"path": tar_path, "workers": "4", **options}, None)
        assert list(reader.pushFilters(list(filters))) == []
        return [p.portions for p in reader.partitions()]

    every = runs(bytes_per_task="1")
    assert all(len(run) == 1 for run in every) and {run[0]["worker"] for run in every} == set(range(4))
    mine = runs([EqualTo(("worker",), 2)])
    assert len(mine) == 1 and mine[0] == [p for run in every for p in run if p["worker"] == 2]
    file = mine[0][0]["file"]
    assert all(p["file"] == file for run in runs([EqualTo(("shard",), file)]) for p in run)
    rows = read_shards(spark, "tarslices", tar_path, workers="4", max_len="10")
    expected = sorted((r.pos, r["__key__"]) for r in rows.collect() if r.worker == 2)
    assert sorted((r.pos, r["__key__"]) for r in rows.filter("worker = 2").collect()) == expected and expected


def plain_buffer(n, size, seed, epoch, run):
    draw = lambda i: hashlib.md5(f"{seed}:{epoch}:{run}:{i}".encode()).hexdigest()
    slots, sent = [], []
    for i in range(n):
        if len(slots) < size:
            slots.append(i)
        else:
            k = int(draw(i)[:8], 16) % size
            sent.append(slots[k])
            slots[k] = i
    return sent + sorted(slots, key=draw)


@pytest.mark.parametrize("size", [1, 7, 500])
def test_buffer_is_a_plain_loop_for_any_batches(spark, size):
    rows = spark.range(700).select(F.when(F.col("id") < 300, "a").when(F.col("id") < 301, "b").otherwise("c").alias("shard"), "id")
    first = {"a": (0, 300), "b": (300, 1), "c": (301, 399)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for per_batch, tasks in ((13, 1), (5000, 3)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(per_batch))
            dealt = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "id")
            found.append(sorted(map(tuple, shuffle_through_buffer(dealt, size, 5, 2, "shard").collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1]
    for shard, (start, n) in first.items():
        mine = sorted((r[3], r[1] - start) for r in found[0] if r[0] == shard)
        assert mine == list(enumerate(plain_buffer(n, size, 5, 2, shard)))


def test_epochs_are_the_same_for_any_tasks(spark, sf_dir):
    path = write_mds(fx.samples(spark, sf_dir), fresh_dir(spark, "mds"), fx.MDS_BYTES)
    read = lambda epoch, **o: {(r.worker, r.batch, r.slot): r.idx for r in load_epoch(
        spark, "mds", path, 16, 3, epoch, shuffle_buffer=10, **o).select("worker", "batch", "slot", "idx").collect()}
    one, two = read(1), read(2)
    assert one == read(1) and one != two and sorted(one.values()) == sorted(two.values())
    assert len(one) == fx.samples(spark, sf_dir).count()


def tensors(spark, n, sides=lambda i: 2):
    rows = [(i, i // 23, f"k{i}", 1, sides(i), 2, [float(i)] * (2 * sides(i))) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, worker int, key string, channels int, height int, width int, "
                                       "values array<float>").coalesce(1)


@pytest.mark.parametrize("drop_last", [False, True])
@pytest.mark.parametrize("packed", [False, True])
def test_batches_carry_over_arrow_batches(spark, drop_last, packed):
    rows = tensors(spark, 60)
    if packed:
        rows = rows.withColumn("values", F.encode("key", "UTF-8"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        found = stack_tensors(rows, 10, "worker", ("sample_id", "key"), drop_last).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = [(w, b, list(range(w * 23 + b * 10, min(w * 23 + b * 10 + 10, w * 23 + 23, 60)))) for w in range(3) for b in range(3)]
    expected = [e for e in expected if e[2] and (len(e[2]) == 10 or not drop_last)]
    assert [(r.worker, r.batch, r.sample_id) for r in found] == expected
    for r in found:
        assert r.shape == [r.n_rows, 1, 2, 2] and r.key == [f"k{i}" for i in r.sample_id]
        if packed:
            assert bytes(r.tensor) == "".join(r.key).encode()
        else:
            assert r.tensor == [float(i) for i in r.sample_id for _ in range(4)]


def test_batches_of_two_shapes_are_refused(spark):
    with pytest.raises(Exception, match="differ in height"):
        stack_tensors(tensors(spark, 9, lambda i: 1 + i // 5), 8).collect()
    assert stack_tensors(tensors(spark, 0), 8).collect() == []


def test_transform_carries_columns_and_order(spark):
    rng = np.random.default_rng(4)
    shapes = [(5, 4, 1), (5, 4, 3), (3, 3, 2), (6, 4, 4), (5, 4, 1)] * 6
    rows = [(i, f"k{i}", h, w, c, bytearray(rng.integers(0, 256, h * w * c, dtype=np.uint8).tobytes()) if i % 7 else None)
            for i, (h, w, c) in enumerate(shapes)]
    table = spark.createDataFrame(rows, "sample_id long, key string, height int, width int, channels int, data binary").coalesce(1)
    kept = [r[0] for r in rows if r[4] != 2 and r[5] is not None]
    found = preprocess(table, side=6, keep=("key",)).collect()
    assert [(r.sample_id, r.key) for r in found] == [(i, f"k{i}") for i in kept]
    alone = {r.sample_id: r["values"] for r in preprocess(table.repartition(20), side=6).collect()}
    assert {r.sample_id: r["values"] for r in found} == alone
    whole = preprocess(table, side=6, random_crop=False).collect()
    assert [r.sample_id for r in whole] == kept and all(len(r["values"]) == 108 for r in whole)
