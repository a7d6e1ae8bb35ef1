"""Measured runs and the sweep that resumes."""

from pyspark.sql import functions as F

from shardloom.operators import runs
from shardloom.plans import fixtures as fx
from shardloom.plans.measure import load_epoch, measure_load, measure_prepare, recorded, run_sweep
from shardloom.plans.prepare import write_mds, write_tar
from shardloom.session import fresh_dir


def test_load_epochs(spark, sf_dir):
    path = write_tar(fx.samples(spark, sf_dir), fresh_dir(spark, "tar"), fx.TAR_BYTES, fx.TAR_ROWS, least_bytes=0)
    n = fx.samples(spark, sf_dir).count()
    one, two = ({(r["__key__"]): (r.worker, r.batch, r.emitted) for r in
                 load_epoch(spark, "tarshards", path, 16, 4, epoch).collect()} for epoch in (1, 2))
    assert len(one) == n and one.keys() == two.keys() and one != two
    assert {w for w, _, _ in one.values()} == {w for w, _, _ in two.values()}
    epochs, first = measure_load(spark, "tar", "tarshards", path, 16, 4, n_epochs=2)
    rows = epochs.orderBy("epoch").collect()
    assert [(r.epoch, r.samples) for r in rows] == [(1, n), (2, n)] and first > 0
    assert runs.second_epoch_throughput(epochs).first().throughput == rows[1].throughput


def test_sweep_resumes(spark, sf_dir):
    path = write_mds(fx.samples(spark, sf_dir), fresh_dir(spark, "mds"), fx.MDS_BYTES)
    results = fresh_dir(spark, "results")
    sets = {"good": ("mds", path), "broken": ("mds", path + "-absent")}
    axes = dict(workers=[2], prefetch=[1], batch_sizes=[16, 32])
    first = run_sweep(spark, sets, results, **axes)
    assert {(r.dataset, r.status): r["count"] for r in first.groupBy("dataset", "status").count().collect()} == {
        ("good", "ok"): 2, ("broken", "failed"): 2}
    again = run_sweep(spark, {**sets, "broken": ("mds", path)}, results, **axes)
    assert {(r.dataset, r.status): r["count"] for r in again.groupBy("dataset", "status").count().collect()} == {
        ("good", "ok"): 2, ("broken", "failed"): 2, ("broken", "ok"): 2}
    before = recorded(spark, results).count()
    assert run_sweep(spark, sets, results, **axes).count() == before


def test_prepare_row(spark, sf_dir):
    flat = fx.samples(spark, sf_dir)
    row = measure_prepare(spark, "mds", lambda: write_mds(flat, fresh_dir(spark, "mds"), fx.MDS_BYTES))
    line = runs.report_rows(row).select("line", F.col("n_files") > 1, F.col("size_mb") > 0).first()
    assert line[0].startswith("| mds | ") and line[0].endswith(" | N/A |") and line[1] and line[2]
