"""Queries over rows: scans, projections, filters, order and splits."""

from __future__ import annotations

import math

from pyarrow.fs import FileSelector
from pyspark.sql import functions as F

from shardloom.functions.paths import is_shard_name, normalize_uri, sample_key, shard_name
from shardloom.functions.payload import (
    MAGIC_BYTES,
    byte_count,
    decode_text,
    encode_columns,
    encode_text,
    optional_text,
    payload_size,
    sniff_kind,
)
from shardloom.operators.assignment import by_count
from shardloom.operators.loading import epochs
from shardloom.operators.ordering import (
    bucket_offsets,
    range_buckets,
    ratio_bounds,
    shuffle_through_buffer,
    split_samples,
    split_shards,
    with_file_rows,
    with_order,
    with_positions,
)
from shardloom.operators.samples import batch_stats, flatten, read_samples, rename_fields, split_valid
from shardloom.plans import fixtures as fx
from shardloom.plans.prepare import narrow
from shardloom.plans.registry import query
from shardloom.session import fresh_dir, stage
from shardloom.sources.listing import count_per_file, file_status, last_file, list_parquet, size_capped_prefix
from shardloom.sources.storage import locate

IMAGE, TEXT = "image", "text"


@query("scan_samples", f"WITH {fx.SQL_SAMPLES} SELECT sample_id, md5(image) AS image_md5, text FROM samples")
def scan_samples(spark, sf_dir):
    path = fresh_dir(spark, "samples")
    fx.nested_samples(spark, sf_dir).write.parquet(path)
    return flatten(read_samples(spark, path)).select("sample_id", F.md5("image").alias("image_md5"), "text")


TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
          "orders", "pages", "part", "region", "supplier"]


@query("list_parquet", f"SELECT unnest({[f'{t}.parquet' for t in TABLES]}) AS name, TRUE AS has_bytes")
def list_parquet_files(spark, sf_dir):
    return list_parquet(spark, sf_dir).select("name", (F.col("bytes") > 0).alias("has_bytes"))


@query("batched_scan_stats", f"""WITH {fx.SQL_SAMPLES}
SELECT count(*) AS n_rows, sum(image_bytes)::BIGINT AS n_bytes, TRUE AS bounded FROM samples""")
def batched_scan_stats(spark, sf_dir):
    return batch_stats(fx.samples(spark, sf_dir), "image").agg(
        F.sum("rows").alias("n_rows"), F.sum("bytes").alias("n_bytes"), (F.max("rows") <= 2000).alias("bounded"))


COUNTED = ["documents", "pages", "conversations", "events", "orders", "lineitem"]


@query("count_per_file", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS file, count(*) AS n_rows FROM {t}" for t in COUNTED))
def count_rows_per_file(spark, sf_dir):
    return count_per_file(spark, *[f"{sf_dir}/{t}.parquet" for t in COUNTED]).select("file", "n_rows")


@query("count_samples", "SELECT count(*) AS n_samples FROM documents")
def count_samples(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_samples"))


def _sql_uri(bare: str) -> str:
    return f"""SELECT page_id, 's3://' || bucket || '/' || key AS uri, bucket, key FROM (
  SELECT page_id, parts[1] AS bucket,
         array_to_string(list_append(list_filter(parts[2:], lambda s: s <> ''), 'tar'), '/') AS key
  FROM (SELECT page_id, string_split({bare}, '/') AS parts FROM pages))"""


@query("normalize_uri", _sql_uri("regexp_replace(url, '^https?://', '')"))
def normalize_uris(spark, sf_dir):
    # Half of the inputs keep a scheme, half are bare: both forms name the same place.
    bare = F.regexp_replace("url", "^https?://", "")
    uri = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("s3://"), bare)).otherwise(bare)
    return fx.table(spark, sf_dir, "pages").select("page_id", normalize_uri(uri, "tar").alias("u")).select(
        "page_id", "u.uri", "u.bucket", "u.key")


@query("project_payload", f"WITH {fx.SQL_SAMPLES} SELECT sample_id, image_bytes, md5(image) AS image_md5 FROM samples")
def project_payload(spark, sf_dir):
    content = F.col("image.content")
    return fx.nested_samples(spark, sf_dir).select(
        "sample_id", F.octet_length(content).cast("long").alias("image_bytes"), F.md5(content).alias("image_md5"))


@query("optional_text", f"""WITH {fx.SQL_SAMPLES}
SELECT sample_id, NULL::VARCHAR AS no_text, text FROM samples""")
def optional_text_column(spark, sf_dir):
    nested = fx.nested_samples(spark, sf_dir)
    without = nested.drop("text")
    return nested.select("sample_id", optional_text(without).alias("no_text"), optional_text(nested).alias("text"))


@query("sample_key", "SELECT doc_id AS sample_id, 'train_' || lpad(doc_id::VARCHAR, 7, '0') AS key FROM documents")
def sample_keys(spark, sf_dir):
    return fx.samples(spark, sf_dir).select("sample_id", sample_key(F.col("sample_id")).alias("key"))


@query("shard_name", """SELECT doc_id AS sample_id,
'dataset-train-' || lpad((doc_id // 100)::VARCHAR, 6, '0') || '.tar' AS file FROM documents""")
def shard_names(spark, sf_dir):
    return fx.samples(spark, sf_dir).select(
        "sample_id", shard_name(by_count(F.col("sample_id"), 100)).alias("file"))


@query("encode_text", f"WITH {fx.SQL_SAMPLES} SELECT sample_id, hex(encode(text)) AS encoded FROM samples")
def encode_texts(spark, sf_dir):
    return fx.samples(spark, sf_dir).select("sample_id", F.hex(encode_text(TEXT)).alias("encoded"))


@query("decode_text", "SELECT doc_id AS sample_id, text, text AS passed_through FROM documents")
def decode_texts(spark, sf_dir):
    rows = fx.samples(spark, sf_dir)
    decoded = rows.withColumn("as_text", decode_text(rows, "image"))
    return decoded.select("sample_id", F.col("as_text").alias("text"),
                          decode_text(decoded, "as_text").alias("passed_through"))


@query("mds_columns", f"""WITH {fx.SQL_SAMPLES}
SELECT md5(image) AS image_md5, text, sample_id AS idx FROM samples""")
def mds_columns(spark, sf_dir):
    rows = fx.samples(spark, sf_dir).withColumnRenamed("sample_id", "idx")
    stored = encode_columns(rows, {"image": "jpeg", "text": "str", "idx": "int"})
    return stored.select(F.md5("image").alias("image_md5"), "text", "idx")


@query("field_map", f"WITH {fx.SQL_SAMPLES} SELECT sample_id, md5(image) AS image, text AS caption FROM samples")
def field_map(spark, sf_dir):
    stored = fx.samples(spark, sf_dir).select("sample_id", F.md5("image").alias("jpg"), F.col(TEXT).alias("txt"))
    return rename_fields(stored, {"image": "jpg", "caption": "txt"})


@query("payload_size", f"WITH {fx.SQL_SAMPLES} SELECT sample_id, image_bytes + text_bytes AS size FROM samples")
def payload_sizes(spark, sf_dir):
    return fx.samples(spark, sf_dir).select("sample_id", payload_size(IMAGE, TEXT).alias("size"))


@query("parse_bytes", """SELECT doc_id,
n_chars * [1, 1000, 1000000, 1000000000, 1024, 1048576][doc_id % 6 + 1]::BIGINT AS n_bytes FROM documents""")
def parse_bytes(spark, sf_dir):
    units = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", " GB", "KiB", "mib")]),
                         (F.col("doc_id") % 6 + 1).cast("int"))
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", byte_count(F.concat(F.col("n_chars").cast("string"), units)).alias("n_bytes"))


@query("sniff_kind", """SELECT doc_id AS sample_id,
['jpeg', 'png', 'gif', 'bmp', 'tiff', 'unknown'][doc_id % 6 + 1] AS kind FROM documents""")
def sniff_kinds(spark, sf_dir):
    marks = F.element_at(F.array(*[F.lit(m) for m in MAGIC_BYTES.values()], F.lit("")),
                         (F.col("sample_id") % 6 + 1).cast("int"))
    return fx.samples(spark, sf_dir).select(
        "sample_id", sniff_kind(F.concat(F.unhex(marks), IMAGE)).alias("kind"))


MOST_BYTES = 10_000
SQL_LABELLED = fx.SQL_SAMPLES + f""",
labelled AS (
  SELECT s.sample_id, image_bytes, CASE WHEN l.doc_id IS NOT NULL THEN text END AS text,
         CASE WHEN image_bytes = 0 THEN 'empty image' WHEN l.doc_id IS NULL THEN 'missing text'
              WHEN image_bytes + text_bytes > {MOST_BYTES} THEN 'oversized' END AS reason
  FROM samples s LEFT JOIN labels l ON l.doc_id = s.sample_id)"""


@query("valid_samples", f"WITH {SQL_LABELLED} SELECT sample_id, image_bytes, text FROM labelled WHERE reason IS NULL")
def valid_samples(spark, sf_dir):
    good, _ = split_valid(fx.labelled(spark, sf_dir), MOST_BYTES, need_bytes=True)
    return good.select("sample_id", F.octet_length("image").cast("long").alias("image_bytes"), "text")


@query("rejected_samples", f"WITH {SQL_LABELLED} SELECT sample_id, reason FROM labelled WHERE reason IS NOT NULL")
def rejected_samples(spark, sf_dir):
    _, rejects = split_valid(fx.labelled(spark, sf_dir), MOST_BYTES, need_bytes=True)
    return rejects.select("sample_id", "reason")


@query("filter_names", """SELECT name FROM (
  SELECT lang || '-' || CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END || '-' || lpad(doc_id::VARCHAR, 6, '0')
         || CASE WHEN doc_id % 5 = 0 THEN '.tar.idx' ELSE '.tar' END AS name FROM documents)
WHERE name LIKE '%.tar' AND contains(name, 'en-train-')""")
def filter_names(spark, sf_dir):
    name = F.concat("lang", F.lit("-"), F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train"),
                    F.format_string("-%06d", "doc_id"),
                    F.when(F.col("doc_id") % 5 == 0, ".tar.idx").otherwise(".tar"))
    names = fx.table(spark, sf_dir, "documents").select(name.alias("name"))
    return names.filter(is_shard_name(F.col("name"), "train", "en"))


def source_files(spark, sf_dir):
    """Each source as one file: its name and bytes."""
    return fx.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(
        F.sum(F.octet_length("text")).cast("long").alias("bytes"))


SQL_FILES = """files AS (
  SELECT source AS name, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source)"""
KEPT_BYTES = 1_000_000


@query("size_capped_prefix", f"""WITH {SQL_FILES}
SELECT * FROM (SELECT name, bytes, sum(bytes) OVER (ORDER BY name)::BIGINT AS total_bytes FROM files)
WHERE total_bytes < {KEPT_BYTES}""")
def capped_prefix(spark, sf_dir):
    return size_capped_prefix(source_files(spark, sf_dir), KEPT_BYTES)


@query("last_file", f"WITH {SQL_FILES} SELECT name, bytes FROM files ORDER BY name DESC LIMIT 1")
def last_file_of(spark, sf_dir):
    return last_file(source_files(spark, sf_dir))


def ordered(spark, sf_dir, seed=fx.SEED, epoch=0):
    """Sample ids with order key and bucket."""
    return with_order(fx.samples(spark, sf_dir).select("sample_id"), seed, epoch)


ORDER = ["order_key", "sample_id"]


@query("seeded_shuffle", f"WITH {fx.SQL_ORDERED} SELECT sample_id, order_key, pos FROM ordered")
def seeded_shuffle(spark, sf_dir):
    return with_positions(ordered(spark, sf_dir), ORDER).select("sample_id", "order_key", "pos")


@query("global_position", f"WITH {fx.SQL_ORDERED} SELECT sample_id, size, pos, cum FROM ordered")
def global_position(spark, sf_dir):
    rows = narrow(fx.samples(spark, sf_dir), payload_size(IMAGE, TEXT), fx.SEED)
    return with_positions(rows, ORDER, size="size").select("sample_id", "size", "pos", "cum")


@query("file_order", """SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn, role) - 1 AS pos
FROM conversations""")
def file_order(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    order = ["conv_id", "turn", "role"]
    return with_positions(range_buckets(rows, order), order).select(*order, "pos")


FILE_BYTES = 64 << 20


@query("parquet_order", """SELECT doc_id, doc_id % 2 AS file_no, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id DESC) - 1 AS "row",
  row_number() OVER (ORDER BY doc_id % 2, doc_id DESC) - 1 AS pos
FROM documents""")
def parquet_order(spark, sf_dir):
    """The order of two files of several row groups each, odd ids in the second, from the greatest id down. A file of more than
    ``FILE_BYTES`` of text goes on in further parts, and its rows are counted on through them."""
    path = fresh_dir(spark, "two-files")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    halves = docs.groupBy((F.col("doc_id") % 2).alias("half")).agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    for half in halves or [{"half": 0, "bytes": 0}]:
        parts = math.ceil((half["bytes"] or 1) / FILE_BYTES)
        rows = docs.filter((F.col("doc_id") % 2).eqNullSafe(half["half"])).repartitionByRange(parts, F.desc("doc_id"))
        rows.sortWithinPartitions(F.desc("doc_id")).write.option("parquet.block.size", 64 << 10).option(
            "parquet.page.size", 8 << 10).parquet(f"{path}/half={half['half']}")
    rows = with_file_rows(spark.read.option("recursiveFileLookup", "true").parquet(path).select("doc_id"))
    placed = with_positions(range_buckets(rows, ["file", "row"]), ["file", "row"])
    placed = placed.withColumn("file_no", F.regexp_extract("file", "half=(-?[0-9]+)/", 1).cast("long"))
    before = bucket_offsets(placed, "file", ("file_no",)).select("file", "first_pos")
    return placed.join(before, "file").select("doc_id", "file_no", (F.col("row") + F.col("first_pos")).alias("row"), "pos")


@query("file_status", """SELECT lang, 'ok' AS status, count(*) AS n_rows FROM documents WHERE lang <> 'de' GROUP BY lang
UNION ALL SELECT 'de', 'damaged', NULL UNION ALL SELECT 'none', 'empty', 0""")
def status_of_files(spark, sf_dir):
    """A file per language, one of them cut, and one without rows: each has a line."""
    path = fresh_dir(spark, "by-language")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs.repartition("lang").write.partitionBy("lang").parquet(path)
    docs.limit(0).select("doc_id").coalesce(1).write.parquet(f"{path}/lang=none")
    filesystem, base = locate(path)
    cut = next(i.path for i in filesystem.get_file_info(FileSelector(f"{base}/lang=de")) if i.path.endswith(".parquet"))
    with filesystem.open_input_stream(cut, compression=None) as stream:
        data = stream.read()
    with filesystem.open_output_stream(cut, compression=None) as stream:
        stream.write(data[:len(data) // 2])
    return file_status(spark, path).select(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), "status", "n_rows")


BUFFER, RUN_ROWS = 40, 130

SQL_RUNS = fx.SQL_ORDERED + f""",
runs AS (SELECT sample_id, pos // {RUN_ROWS} AS run, pos % {RUN_ROWS} AS arrived FROM ordered)"""


# Row by row: a full buffer's drawn slot is sent and takes the new row; the rest is sent in the order of the draws.
@query("buffer_shuffle", f"""WITH RECURSIVE {SQL_RUNS},
buffers AS (
  SELECT run, count(*) AS n, 0::BIGINT AS i, []::BIGINT[] AS slots, []::BIGINT[] AS sent FROM runs GROUP BY run
  UNION ALL
  SELECT run, n, i + 1,
    CASE WHEN len(slots) < {BUFFER} THEN list_append(slots, i) ELSE list_concat(list_append(slots[:k], i), slots[k + 2:]) END,
    CASE WHEN len(slots) < {BUFFER} THEN sent ELSE list_append(sent, slots[k + 1]) END
  FROM (SELECT *, ('0x' || substr(md5('{fx.SEED}:0:' || run || ':' || i), 1, 8))::BIGINT % {BUFFER} AS k
        FROM buffers WHERE i < n)),
emissions AS (
  SELECT run, list_concat(sent, list_transform(
    list_sort(list_transform(slots, lambda x: md5('{fx.SEED}:0:' || run || ':' || x) || lpad(x::VARCHAR, 9, '0'))),
    lambda d: substr(d, 33)::BIGINT)) AS numbers
  FROM buffers WHERE i = n)
SELECT sample_id, run, arrived, emitted
FROM (SELECT run, unnest(numbers) AS arrived, unnest(range(len(numbers))) AS emitted FROM emissions) JOIN runs USING (run, arrived)""")
def buffer_shuffle(spark, sf_dir):
    """Runs of rows through a buffer each; where the runs lie does not matter."""
    placed = with_positions(ordered(spark, sf_dir), ORDER)
    run = by_count(F.col("pos"), RUN_ROWS)
    rows = placed.select("sample_id", "pos", run.alias("run"))
    rows = rows.repartition("run").sortWithinPartitions("run", "pos")
    return shuffle_through_buffer(rows, BUFFER, fx.SEED, within="run").select("sample_id", "run", "arrived", "emitted")


@query("epoch_shuffle", f"""SELECT epoch, doc_id AS sample_id,
row_number() OVER (PARTITION BY epoch ORDER BY md5('{fx.SEED}:' || epoch || ':' || doc_id), doc_id) - 1 AS pos
FROM documents, (SELECT unnest([1, 2]) AS epoch)""")
def epoch_shuffle(spark, sf_dir):
    rows = epochs(fx.samples(spark, sf_dir).select("sample_id"), 2, fx.SEED)
    return with_positions(rows, ORDER, group=("epoch",)).select("epoch", "sample_id", "pos")


RATIOS, SPLITS = [8, 1, 1], ["train", "val", "test"]


def _sql_split(value: str, total: str | None = None) -> str:
    cases = " ".join(
        f"WHEN {value} < " + (f"round({total} * {end!r})" if total else repr(end)) + f" THEN '{name}'"
        for name, _, end in ratio_bounds(RATIOS, SPLITS))
    return f"CASE {cases} ELSE '{SPLITS[-1]}' END"


DRAW = f"('0x' || substr(md5('split:{fx.SEED}:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("ratio_split", f"SELECT doc_id AS sample_id, {_sql_split(DRAW)} AS split FROM documents")
def ratio_split(spark, sf_dir):
    return split_samples(fx.samples(spark, sf_dir).select("sample_id"), RATIOS, SPLITS, fx.SEED)


@query("shard_split", f"""WITH {fx.SQL_ORDERED}, shards AS (
  SELECT pos // {fx.TAR_ROWS} AS shard, count(*) AS n_rows FROM ordered GROUP BY 1),
n AS (SELECT count(*) AS n FROM shards)
SELECT shard, n_rows, {_sql_split('shard', 'n')} AS split FROM shards, n""")
def shard_split(spark, sf_dir):
    placed = with_positions(ordered(spark, sf_dir), ORDER)
    # The manifest is read twice: it is staged, the rows are not.
    shards = stage(placed.groupBy(by_count(F.col("pos"), fx.TAR_ROWS).alias("shard")).agg(
        F.count(F.lit(1)).alias("n_rows")))
    return split_shards(shards, shards.agg(F.count(F.lit(1))).scalar(), RATIOS, SPLITS)


@query("select_split", f"""SELECT * FROM (SELECT doc_id AS sample_id, {_sql_split(DRAW)} AS split FROM documents)
WHERE split = 'val'""")
def select_split(spark, sf_dir):
    return ratio_split(spark, sf_dir).filter(F.col("split") == "val")


@query("fixed_batches", f"""WITH {fx.SQL_ORDERED}
SELECT pos // 100 AS batch, count(*) AS n_rows, min(pos) AS first_pos FROM ordered GROUP BY 1""")
def fixed_batches(spark, sf_dir):
    placed = with_positions(ordered(spark, sf_dir), ORDER)
    return placed.groupBy(by_count(F.col("pos"), 100).alias("batch")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"))
