"""File listings and file-level rules; contents are never read."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.functions.paths import is_shard_name
from shardloom.operators.ordering import range_buckets, with_positions
from shardloom.session import exists, qualified
from shardloom.sources.storage import locate


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, name, bytes`` of every file under a path; ``content`` is not selected, so only metadata is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def list_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The sorted parquet files under a directory, or a single file; anything else is an error."""
    filesystem, inner = locate(qualified(spark, path))
    kind = filesystem.get_file_info(inner).type
    if kind == FileType.NotFound or (kind == FileType.File and not inner.endswith(".parquet")):
        raise ValueError(f"{path} is neither a parquet file nor a directory")
    return list_files(spark, path, "*.parquet").orderBy("path")


def list_shards(spark: SparkSession, path: str, split: str = "train", prefix: str = "dataset") -> DataFrame:
    return list_files(spark, path).filter(is_shard_name(F.col("name"), split, prefix)).orderBy("name")


def count_per_file(spark: SparkSession, *paths: str, skip_corrupt: bool = True) -> DataFrame:
    """``path, file, n_rows`` per file with rows. No column is read, so parquet answers from its footers."""
    rows = (spark.read.option("recursiveFileLookup", "true")
            .option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(*paths))
    return rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"))


def file_status(spark: SparkSession, path: str) -> DataFrame:
    """``path, file, status, n_rows, reason`` of every listed parquet file: ``ok``, ``empty`` or ``damaged``. Footers are read in
    tasks; damage is what the bytes are to blame for, while an error of the storage fails the task. Spark lists no files of no
    bytes at all."""
    def status_of(batches):
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                filesystem, inner = locate(name)
                try:
                    with filesystem.open_input_file(inner) as source:
                        rows = pq.read_metadata(source).num_rows
                    found.append(("ok" if rows else "empty", rows, None))
                except pa.ArrowInvalid as error:
                    found.append(("damaged", None, str(error).splitlines()[0]))
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string())))],
                ["path", "file", "status", "n_rows", "reason"])

    listed = list_files(spark, qualified(spark, path), "*.parquet").select("path", F.col("name").alias("file"))
    return listed.mapInArrow(status_of, "path string, file string, status string, n_rows long, reason string")


def damaged(spark: SparkSession, report: str) -> DataFrame:
    """``shard, delivered, samples, reason`` of the shards that reads with this ``report`` folder did not get whole."""
    schema = "shard string, delivered long, samples long, reason string"
    return spark.read.schema(schema).json(report) if exists(spark, report) else spark.createDataFrame([], schema)


def dir_stats(spark: SparkSession, path: str) -> DataFrame:
    """Size in MB and number of files; zeros for a directory that is empty or absent."""
    if not exists(spark, path):
        return spark.createDataFrame([(0.0, 0)], "size_mb double, n_files long")
    return list_files(spark, path).agg(
        F.coalesce(F.sum("bytes") / (1024 * 1024), F.lit(0.0)).alias("size_mb"),
        F.count(F.lit(1)).alias("n_files"))


def size_capped_prefix(files: DataFrame, max_bytes: int, name: str = "name", size: str = "bytes") -> DataFrame:
    """The name-ordered files whose running total stays below the limit."""
    placed = with_positions(range_buckets(files, [name]), [name], size=size)
    return (placed.withColumn("total_bytes", F.col("cum") + F.col(size))
            .filter(F.col("total_bytes") < max_bytes).select(*files.columns, "total_bytes"))


def last_file(files: DataFrame, name: str = "name") -> DataFrame:
    return files.agg(F.max(name).alias(name), F.max_by("bytes", name).alias("bytes"))
