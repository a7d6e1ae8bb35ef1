"""Headline jobs at one scale, timed around actions that consume every row.

Prints one JSON line. ``queries`` are seconds of a warm session; a first pass over the smallest tables warms
the JVM and the Python workers and is not timed. ``detail`` has the rates, sizes and memory beside them.
"""

from __future__ import annotations

import json
import os
import resource
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from shardloom.operators.raster import preprocess  # noqa: E402
from shardloom.plans import catalog, fixtures as fx  # noqa: E402
from shardloom.plans.catalog_shards import filed_samples, writer_of_file  # noqa: E402
from shardloom.plans.prepare import read_shards, write_chunks, write_mds, write_tar  # noqa: E402
from shardloom.session import build_session, fresh_dir  # noqa: E402
from shardloom.sources import register  # noqa: E402
from shardloom.sources.indexed_tar import prepare_index  # noqa: E402
from shardloom.sources.listing import list_files  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001"))
# The reference's limits, scaled with its 3 GB to the tens of MB here: the same few dozen shards.
TAR_BYTES, MDS_BYTES, CHUNK_BYTES = 1 << 20, 1 << 19, 500_000
# Queries of the catalog that have no file output of their own.
CATALOG = ["scan_samples", "seeded_shuffle", "shard_overshoot", "shard_fit", "shard_per_writer", "shard_manifest",
           "shard_digest", "worker_slices", "batch_partial", "virtual_epoch", "multi_epoch", "collate_batches",
           "raster_normalize", "log_metrics", "resource_series", "running_peak", "throughput_grid", "reconcile",
           "stream_resource_windows"]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def jobs(spark, sf_dir):
    """(name, function returning details) in order; later ones read what earlier ones wrote."""
    paths = {}
    samples = fx.samples(spark, sf_dir)
    n = fx.table(spark, sf_dir, "documents").count()

    def written(name, path):
        paths[name] = path
        stats = list_files(spark, path).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
        return {"rows": n, "out_mb": round(stats.b / 1e6, 2), "files": stats.n}

    def prepare_tar():
        return written("tarshards", write_tar(samples, fresh_dir(spark, "bench-tar"), TAR_BYTES, 10_000, least_bytes=0))

    def prepare_mds():
        return written("mds", write_mds(samples, fresh_dir(spark, "bench-mds"), MDS_BYTES))

    def prepare_chunks():
        return written("chunks", write_chunks(filed_samples(spark, sf_dir), fresh_dir(spark, "bench-chunks"),
                                              writer_of_file(), F.col("file"), F.col("sample_id"), CHUNK_BYTES))

    def index_tar():
        prepare_index(spark, paths["tarshards"], {"image": "jpg", "caption": "txt"})
        return {"rows": n}

    def load(source, **options):
        def run():
            drain(read_shards(spark, source, paths[source], **options))
            return {"rows": n}
        return run

    def load_slices():
        drain(read_shards(spark, "tarslices", paths["tarshards"], workers="8", max_len="100"))
        return {"rows": n}

    def first_batch(source):
        def run():
            return {"rows": len(read_shards(spark, source, paths[source]).limit(256).collect())}
        return run

    def rasters(packed):
        def run():
            # One small file is one partition; a kernel that multiplies its input wants all cores.
            spread = fx.rasters(spark, sf_dir).repartition(int(CPUS))
            drain(preprocess(spread, side=224, packed=packed))
            return {"rows": fx.table(spark, sf_dir, "embeddings").count()}
        return run

    listed = [("prepare_tar", prepare_tar), ("prepare_mds", prepare_mds), ("prepare_chunks", prepare_chunks),
              ("index_tar", index_tar), ("load_tar", load("tarshards")), ("load_mds", load("mds")),
              ("load_chunks", load("chunks")), ("load_slices", load_slices),
              ("first_batch_tar", first_batch("tarshards")), ("first_batch_mds", first_batch("mds")),
              ("first_batch_chunks", first_batch("chunks")), ("preprocess_224", rasters(False)),
              ("preprocess_224_packed", rasters(True))]
    for name in CATALOG:
        listed.append((name, lambda name=name: drain(catalog.QUERIES[name](spark, sf_dir)) or {}))
    return listed


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    register(spark)
    if os.path.isdir(WARM_DIR):
        for _, job in jobs(spark, WARM_DIR):
            job()
    seconds, detail = {}, {}
    for name, job in jobs(spark, SF_DIR):
        start = time.perf_counter()
        facts = job()
        seconds[name] = round(time.perf_counter() - start, 3)
        if facts.get("rows"):
            facts["rows_per_s"] = round(facts["rows"] / seconds[name], 1)
        if facts:
            detail[name] = facts
    detail["peak_python_driver_mb"] = round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    detail["jvm_heap_mb"] = round((runtime.totalMemory() - runtime.freeMemory()) / 1e6, 1)
    print(json.dumps({"metric": "warm wall clock of all jobs", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                      "cpus": int(CPUS), "detail": detail}))
    spark.stop()


if __name__ == "__main__":
    main()
