"""Table to shards, end to end.

The payload is read once for its size and once for the write, and shuffled once, by shard. Everything between
runs on a narrow staged table of (id, order key, size).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shardloom.functions.paths import sample_key
from shardloom.functions.payload import payload_size
from shardloom.operators.assignment import Rollover, check_limits, roll_shards
from shardloom.operators.attach import by_boundaries, by_file_rows
from shardloom.operators.ordering import bucket_digits, range_buckets, with_order
from shardloom.operators.samples import split_valid
from shardloom.session import qualified, stage
from shardloom.sources import register
from shardloom.sources.chunks import chunk_number, item_size
from shardloom.sources.mds import header_of, shard_overhead, stored_size

TASK_BYTES = 1 << 30
MDS_COLUMNS = {"image": "jpeg", "text": "str", "idx": "int"}


def narrow(samples: DataFrame, size: Column, seed: int = 42, digits: int | None = None) -> DataFrame:
    """Staged (sample_id, size, order_key, bucket): the only pass that reads payloads before the write."""
    digits = digits or bucket_digits(samples.count())
    return stage(with_order(samples.select("sample_id", size.cast("long").alias("size")), seed, digits=digits))


def assign(samples: DataFrame, rule: Rollover, size: Column, seed: int = 42, digits: int | None = None) -> DataFrame:
    """Staged shard assignment in the seeded order, over 16**digits buckets; as many as the rows ask for by default."""
    rows = narrow(samples, size, seed, digits)
    return stage(roll_shards(rows, rule, ["order_key", "sample_id"], n_rows=rows.count(), keep=["sample_id", "size"]))


def cluster_by_shard(rows: DataFrame, total_bytes: int, n_shards: int, order_by: list[str]) -> DataFrame:
    """Whole shards per task, each in order: the one payload shuffle."""
    tasks = max(1, min(n_shards, max(math.ceil(total_bytes / TASK_BYTES),
                                     rows.sparkSession.sparkContext.defaultParallelism)))
    placed = rows.repartitionById(tasks, F.pmod("shard_task", F.lit(tasks)).cast("int"))
    return placed.sortWithinPartitions("shard", *order_by)


def write_shards(payload: DataFrame, assigned: DataFrame, source: str, path: str, seed: int = 42,
                 **options: str) -> str:
    """Write a payload table, one column per stored field, by a seeded-order assignment."""
    spark = register(payload.sparkSession)
    path = qualified(spark, path)
    totals = assigned.agg(F.sum("size").alias("bytes"), F.max("shard").alias("last")).first()
    if totals["last"] is None:
        raise ValueError("no samples to write")
    rows = by_boundaries(payload, assigned, seed, n_shards=totals["last"] + 1).withColumn("shard_task", F.col("shard"))
    rows = cluster_by_shard(rows, totals["bytes"], totals["last"] + 1, ["order_key", "sample_id"])
    stored = [c for c in payload.columns if c != "sample_id"]
    rows.select("shard", *stored).write.format(source).mode("overwrite").options(**options).save(path)
    return path


def set_aside(flat: DataFrame, rejects: str | None, need_text: bool = True) -> DataFrame:
    """The rows a format can hold; the others go to ``rejects`` with their reason, if that is wanted."""
    good, bad = split_valid(flat, need_text=need_text)
    if rejects:
        bad.drop("image").write.mode("overwrite").parquet(rejects)
    return good


def write_tar(flat: DataFrame, path: str, max_bytes: int = 2 << 26, max_rows: int = 10_000, seed: int = 42,
              prefix: str = "dataset", split: str = "train", hashes: str = "", digits: int | None = None,
              assigned: DataFrame | None = None, rejects: str | None = None, least_bytes: int = 10_000_000,
              offsets: bool = False, shards_per_list: int | None = None) -> str:
    """Tar shards ``<prefix>-<split>-NNNNNN.tar`` of (sample_id, image, text). With ``shards_per_list`` the index is kept in
    lists of so many shards, which readers plan from without an entry per shard."""
    check_limits(max_bytes, max_rows, least_bytes)
    # Counted before rows are set aside: this count reads footers, the other one payloads.
    digits = digits or bucket_digits(flat.count())
    flat = set_aside(flat, rejects)
    image, text = F.col("image"), F.col("text")
    if assigned is None:
        assigned = assign(flat, Rollover(max_bytes, "overshoot", max_rows), payload_size(image, text), seed, digits)
    payload = flat.select("sample_id", sample_key(F.col("sample_id"), split).alias("__key__"),
                          image.alias("jpg"), F.encode(text, "UTF-8").alias("txt"))
    return write_shards(payload, assigned, "tarshards", path, seed, prefix=prefix, split=split, hashes=hashes,
                        offsets=str(offsets).lower(),
                        **({} if shards_per_list is None else {"shards_per_list": str(shards_per_list)}))


def write_mds(flat: DataFrame, path: str, size_limit: int = 1 << 26, seed: int = 42, compression: str = "",
              hashes: str = "", digits: int | None = None, assigned: DataFrame | None = None,
              rejects: str | None = None) -> str:
    """MDS shards of (image, text, idx); the limit counts stored bytes, as the format's writer does."""
    digits = digits or bucket_digits(flat.count())
    flat = set_aside(flat, rejects)
    payload = flat.select("sample_id", "image", "text", F.col("sample_id").cast("long").alias("idx"))
    if assigned is None:
        names = [h for h in hashes.split(",") if h]
        header = header_of(MDS_COLUMNS, size_limit, compression or None, names)
        size = stored_size({c: F.col(c) for c in ("image", "text")}, MDS_COLUMNS)
        rule = Rollover(size_limit - shard_overhead(header), "fit")
        assigned = assign(flat, rule, size, seed, digits)
    return write_shards(payload, assigned, "mds", path, seed, columns=json.dumps(MDS_COLUMNS),
                        size_limit=str(size_limit), compression=compression, hashes=hashes)


def write_chunks(flat: DataFrame, path: str, writer: Column, file: Column, row: Column, chunk_bytes: int = 64_000_000,
                 chunk_rows: int | None = None, compression: str = "zstd", hashes: str = "",
                 rows_per_part: int = 20_000, rejects: str | None = None) -> str:
    """Chunks in file order: files go to writers, each writer rolls chunks of its own. Text may be null.

    ``rows_per_part`` is the stretch of a file in which a payload row looks for its chunk: some ten chunks long.
    """
    flat = set_aside(flat, rejects, need_text=False)
    spark = register(flat.sparkSession)
    path = qualified(spark, path)
    assigned = stage(assign_writers(flat, writer, file, row, item_size(F.col("image"), F.col("text")),
                                    Rollover(chunk_bytes, "fit", chunk_rows)))
    totals = assigned.agg(F.sum("size").alias("bytes"), F.count_if(F.col("slot") == 0).alias("n")).first()
    if not totals["n"]:
        raise ValueError("no samples to write")

    def part(of_row):
        return F.call_function("div", of_row.cast("long"), F.lit(rows_per_part).cast("long")).alias("_part")

    payload = flat.select("*", file.alias("_file"), row.cast("long").alias("_row"), part(row))
    runs = assigned.select("writer", "shard", F.col("file").alias("_file"), F.col("row").alias("_row"),
                           part(F.col("row")))
    rows = by_file_rows(payload, runs, "_file", "_row", "_part", chunk_number(F.col("writer"), F.col("shard")))
    rows = rows.withColumn("shard_task", F.hash("shard"))
    rows = cluster_by_shard(rows, totals["bytes"], totals["n"], ["_file", "_row"])
    (rows.select("shard", F.col("image").alias("image_bytes"), "text").write.format("chunks").mode("overwrite")
     .options(compression=compression, chunk_bytes=str(chunk_bytes), hashes=hashes).save(path))
    return path


def assign_writers(flat: DataFrame, writer: Column, file: Column, row: Column, size: Column, rule: Rollover,
                   buckets: int | None = None) -> DataFrame:
    """Per-writer rollover in file order; a writer or file of any size spreads over range buckets."""
    rows = stage(flat.select("sample_id", writer.cast("long").alias("writer"), file.alias("file"),
                             row.cast("long").alias("row"), size.cast("long").alias("size")))
    ranged = range_buckets(rows, ["writer", "file", "row", "sample_id"], buckets)
    return roll_shards(ranged, rule, ["file", "row", "sample_id"], group=("writer",), n_rows=rows.count()).drop("bucket")


def read_shards(spark: SparkSession, source: str, path: str, schema: str | None = None, **options: str) -> DataFrame:
    options.setdefault("min_tasks", str(spark.sparkContext.defaultParallelism))
    reader = register(spark).read.format(source).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(qualified(spark, path))
