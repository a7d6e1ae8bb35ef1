"""The sample table and its row-level rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shardloom.functions.payload import has_field, optional_text, payload_size

SAMPLE_SCHEMA = T.StructType([
    T.StructField("sample_id", T.LongType(), False),
    T.StructField("image", T.StructType([T.StructField("content", T.BinaryType())])),
    T.StructField("text", T.StructType([T.StructField("content", T.StringType())])),
])


def read_samples(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 skip_corrupt: bool = False) -> DataFrame:
    """Parquet file or directory of image-text rows; nested pruning reads only the fields a query selects."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return (reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(path))


def flatten(samples: DataFrame) -> DataFrame:
    """``sample_id, image, text`` out of the nested payload structs."""
    image = F.col("image.content") if has_field(samples.schema, "image.content") else F.col("image")
    text_path = "text" if has_field(samples.schema, "text") and not has_field(samples.schema, "text.content") \
        else "text.content"
    return samples.select("sample_id", image.alias("image"), optional_text(samples, text_path).alias("text"))


def rejection(image: Column, text: Column, max_bytes: int | None = None, need_text: bool = True,
              need_bytes: bool = False) -> Column:
    """Why a sample cannot be written, or null if it can."""
    size = payload_size(image, text)
    reason = F.when(image.isNull(), F.lit("missing image"))
    if need_bytes:
        reason = reason.when(F.octet_length(image) == 0, F.lit("empty image"))
    if need_text:
        reason = reason.when(text.isNull(), F.lit("missing text"))
    if max_bytes is not None:
        reason = reason.when(size > max_bytes, F.lit("oversized"))
    return reason


def split_valid(flat: DataFrame, max_bytes: int | None = None, need_text: bool = True,
                need_bytes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the rest with a reason; one bad row never stops a job."""
    reason = rejection(F.col("image"), F.col("text"), max_bytes, need_text, need_bytes)
    return flat.filter(reason.isNull()), flat.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def rename_fields(df: DataFrame, field_map: dict[str, str]) -> DataFrame:
    """Rename stored columns to consumer names; the map reads ``consumer name: stored name``."""
    missing = set(field_map.values()) - set(df.columns)
    if missing:
        raise ValueError(f"field map names absent columns {sorted(missing)}")
    return df.withColumnsRenamed({stored: name for name, stored in field_map.items()})


def batch_stats(df: DataFrame, size_of: str, rows_per_batch: int = 2000) -> DataFrame:
    """Row and byte counts per bounded batch of a scan: memory stays at one batch per task."""

    def measure(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(start, rows_per_batch)
                total = pc.sum(pc.binary_length(part.column(0))).as_py() or 0
                yield pa.RecordBatch.from_pydict({"rows": [part.num_rows], "bytes": [total]},
                                                 schema=pa.schema([("rows", pa.int64()), ("bytes", pa.int64())]))

    return df.select(size_of).mapInArrow(measure, "rows long, bytes long")
