"""Queries that assign, write and read back shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions.hashing import payload_digest
from shardloom.functions.paths import sample_key
from shardloom.functions.payload import payload_size
from shardloom.operators.assignment import Rollover, by_bytes, by_count, roll_shards, shard_manifest
from shardloom.operators.attach import by_boundaries, by_sample_id
from shardloom.operators.checks import reconcile, shard_digest
from shardloom.operators.ordering import bucket_digits, with_positions
from shardloom.plans import fixtures as fx
from shardloom.plans.catalog_rows import IMAGE, ORDER, TEXT
from shardloom.plans.prepare import (
    MDS_COLUMNS,
    TASK_BYTES,
    assign,
    assign_writers,
    cluster_by_shard,
    narrow,
    read_shards,
    write_chunks,
    write_mds,
    write_tar,
)
from shardloom.plans.registry import query
from shardloom.session import fresh_dir
from shardloom.sources import register
from shardloom.sources.chunks import item_size
from shardloom.sources.indexed_tar import prepare_index, tar_sample_index
from shardloom.sources.listing import damaged, list_shards
from shardloom.sources.mds import header_of, shard_overhead
from shardloom.sources.storage import locate, read_json

OVERSHOOT = Rollover(fx.TAR_BYTES, "overshoot", fx.TAR_ROWS)

ROLLED_OVERSHOOT = fx.sql_rolled(fx.SQL_ORDERED, fx.TAR_BYTES, "overshoot", fx.TAR_ROWS)
ROLLED_FIT = fx.sql_rolled(fx.SQL_ORDERED, fx.MDS_BYTES, "fit")
ROLLED_TINY = fx.sql_rolled(fx.SQL_ORDERED, fx.TINY_BYTES, "fit")
ASSIGNED_SQL = "SELECT sample_id, n - 1 AS pos, shard, slot FROM rolled"


def rolled(spark, sf_dir, rule):
    rows = fx.samples(spark, sf_dir)
    n = rows.count()
    return roll_shards(narrow(rows, payload_size(IMAGE, TEXT), fx.SEED, bucket_digits(n)), rule, ORDER, n_rows=n)


def assigned_columns(df):
    return df.select("sample_id", "pos", "shard", "slot")


@query("shard_overshoot", f"WITH RECURSIVE {ROLLED_OVERSHOOT} {ASSIGNED_SQL}")
def shard_overshoot(spark, sf_dir):
    return assigned_columns(rolled(spark, sf_dir, OVERSHOOT))


@query("shard_fit", f"WITH RECURSIVE {ROLLED_FIT} {ASSIGNED_SQL}")
def shard_fit(spark, sf_dir):
    return assigned_columns(rolled(spark, sf_dir, Rollover(fx.MDS_BYTES, "fit")))


@query("shard_fit_oversized", f"WITH RECURSIVE {ROLLED_TINY} {ASSIGNED_SQL}")
def shard_fit_oversized(spark, sf_dir):
    return assigned_columns(rolled(spark, sf_dir, Rollover(fx.TINY_BYTES, "fit")))


# Rows far smaller than a shard: a bucket's step function has as many steps as rows, as chains never meet.
SMALL_BYTES, SMALL_SHARD = 40, 20_000


@query("shard_small_rows", f"""WITH items AS (SELECT l_orderkey * 10 + l_linenumber AS sample_id FROM lineitem),
ordered AS (SELECT sample_id, row_number() OVER (ORDER BY md5('{fx.SEED}:0:' || sample_id), sample_id) - 1 AS pos FROM items)
SELECT sample_id, pos, pos // {SMALL_SHARD // SMALL_BYTES} AS shard, pos % {SMALL_SHARD // SMALL_BYTES} AS slot FROM ordered""")
def shard_small_rows(spark, sf_dir):
    """256 buckets of rows of 40 bytes, whose steps no task may have more than 12,000 of."""
    items = fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("sample_id"))
    rows = narrow(items, F.lit(SMALL_BYTES), fx.SEED, digits=2)
    return assigned_columns(roll_shards(rows, Rollover(SMALL_SHARD, "fit"), ORDER, max_steps=8_000))


# Files are dealt to writers by their number; a source is a file and doc_id the row in it.
def writer_of_file():
    return F.pmod(F.regexp_extract("file", "([0-9]+)", 1).cast("long"), F.lit(fx.WRITERS))


WRITER_ROWS = fx.SQL_SAMPLES + f""",
sized AS (SELECT *, regexp_extract(file, '([0-9]+)', 1)::BIGINT % {fx.WRITERS} AS writer,
          image_bytes + text_bytes + 8 AS size FROM samples)"""
ROLLED_WRITERS = fx.sql_rolled(WRITER_ROWS, fx.CHUNK_BYTES, "fit", group="writer", order="file, sample_id")


def filed_samples(spark, sf_dir):
    files = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.encode("text", "UTF-8").alias("image"),
        F.concat("lang", F.lit("/"), "source").alias("text"), F.col("source").alias("file"))
    return files


@query("shard_per_writer", f"WITH RECURSIVE {ROLLED_WRITERS} SELECT sample_id, grp AS writer, shard, slot FROM rolled")
def shard_per_writer(spark, sf_dir):
    assigned = assign_writers(filed_samples(spark, sf_dir), writer_of_file(), F.col("file"), F.col("sample_id"),
                              item_size(IMAGE, TEXT), Rollover(fx.CHUNK_BYTES, "fit"))
    return assigned.select("sample_id", "writer", "shard", "slot")


def placed(spark, sf_dir):
    return with_positions(narrow(fx.samples(spark, sf_dir), payload_size(IMAGE, TEXT), fx.SEED), ORDER, size="size")


@query("shard_by_count", f"WITH {fx.SQL_ORDERED} SELECT sample_id, pos // {fx.TAR_ROWS} AS shard FROM ordered")
def shard_by_count(spark, sf_dir):
    return placed(spark, sf_dir).select("sample_id", by_count(F.col("pos"), fx.TAR_ROWS).alias("shard"))


@query("shard_by_cumbytes", f"WITH {fx.SQL_ORDERED} SELECT sample_id, cum // {fx.MDS_BYTES} AS shard FROM ordered")
def shard_by_cumbytes(spark, sf_dir):
    return placed(spark, sf_dir).select("sample_id", by_bytes(F.col("cum"), fx.MDS_BYTES).alias("shard"))


@query("shard_manifest", f"""WITH RECURSIVE {ROLLED_FIT}
SELECT shard, count(*) AS n_rows, sum(sz)::BIGINT AS n_bytes, min(n - 1) AS first_pos, max(n - 1) AS last_pos
FROM rolled GROUP BY shard""")
def manifest(spark, sf_dir):
    return shard_manifest(rolled(spark, sf_dir, Rollover(fx.MDS_BYTES, "fit")))


@query("assign_join", f"""WITH RECURSIVE {ROLLED_OVERSHOOT}
SELECT r.sample_id, r.shard, md5(s.image) AS image_md5, s.text FROM rolled r JOIN samples s USING (sample_id)""")
def assign_join(spark, sf_dir):
    rows = fx.samples(spark, sf_dir)
    assigned = assign(rows, OVERSHOOT, payload_size(IMAGE, TEXT), fx.SEED)
    return by_boundaries(rows, assigned, fx.SEED).select("sample_id", "shard", F.md5("image").alias("image_md5"), "text")


@query("shard_digest", f"""WITH RECURSIVE {ROLLED_OVERSHOOT}
SELECT shard, count(*) AS n_rows, sha256(string_agg(sha256(s.image), '' ORDER BY slot)) AS digest
FROM rolled r JOIN samples s USING (sample_id) GROUP BY shard""")
def digest_of_shards(spark, sf_dir):
    # Row digests are taken before the join, so payloads are not shuffled.
    rows = fx.samples(spark, sf_dir).select("sample_id", payload_digest(IMAGE).alias("digest"))
    return shard_digest(by_sample_id(rows, rolled(spark, sf_dir, OVERSHOOT)))


def tar_set(spark, sf_dir, **options):
    return write_tar(fx.samples(spark, sf_dir), fresh_dir(spark, "tar"), fx.TAR_BYTES, fx.TAR_ROWS, fx.SEED,
                     least_bytes=0, **options)


def mds_set(spark, sf_dir, **options):
    return write_mds(fx.samples(spark, sf_dir), fresh_dir(spark, "mds"), fx.MDS_BYTES, fx.SEED,
                     **options)


def chunk_set(spark, sf_dir, **options):
    return write_chunks(filed_samples(spark, sf_dir), fresh_dir(spark, "chunks"), writer_of_file(), F.col("file"),
                        F.col("sample_id"), fx.CHUNK_BYTES, rows_per_part=250, **options)


def index_of(spark, path, key, schema):
    """The entries a writer's commit put in the index."""
    filesystem, base = locate(path)
    return spark.createDataFrame(read_json(filesystem, f"{base}/index.json")[key], schema)


TAR_NAME = "'dataset-train-' || lpad(shard::VARCHAR, 6, '0') || '.tar'"


@query("write_tar", f"""WITH RECURSIVE {ROLLED_OVERSHOOT},
tars AS (SELECT shard, count(*) AS samples, sum(sz)::BIGINT AS payload_bytes,
  sum(1024 + (image_bytes + 511) // 512 * 512 + (text_bytes + 511) // 512 * 512)::BIGINT + 1024 AS raw
  FROM rolled JOIN samples USING (sample_id) GROUP BY shard)
SELECT {TAR_NAME} AS file, samples, payload_bytes, (raw + 10239) // 10240 * 10240 AS bytes FROM tars""")
def tar_written(spark, sf_dir):
    return index_of(spark, tar_set(spark, sf_dir), "shards",
                    "file string, samples long, payload_bytes long, bytes long")


@query("list_shards", f"WITH RECURSIVE {ROLLED_OVERSHOOT} SELECT DISTINCT {TAR_NAME} AS name FROM rolled")
def shards_listed(spark, sf_dir):
    return list_shards(spark, tar_set(spark, sf_dir)).select("name")


MDS_HEADER = header_of(MDS_COLUMNS, fx.MDS_BYTES, None, [])
ROLLED_MDS = fx.sql_rolled(fx.SQL_SAMPLES + f""",
sized AS (SELECT *, image_bytes + text_bytes + 20 AS size, md5('{fx.SEED}:0:' || sample_id) AS order_key
          FROM samples)""", fx.MDS_BYTES - shard_overhead(MDS_HEADER), "fit")


@query("write_mds", f"""WITH RECURSIVE {ROLLED_MDS}
SELECT 'shard.' || lpad(shard::VARCHAR, 5, '0') || '.mds' AS file, count(*) AS samples,
       sum(sz)::BIGINT + {shard_overhead(MDS_HEADER)} AS bytes
FROM rolled GROUP BY shard""")
def mds_written(spark, sf_dir):
    shards = index_of(spark, mds_set(spark, sf_dir), "shards", "samples long, raw_data struct<basename:string,bytes:long>")
    return shards.select(F.col("raw_data.basename").alias("file"), "samples", F.col("raw_data.bytes").alias("bytes"))


@query("write_chunks", f"""WITH RECURSIVE {ROLLED_WRITERS}
SELECT 'chunk-' || grp || '-' || shard || '.zstd.bin' AS filename, count(*) AS chunk_size,
       (sum(sz) + 4 * count(*) + 8)::BIGINT AS chunk_bytes
FROM rolled GROUP BY grp, shard""")
def chunks_written(spark, sf_dir):
    return index_of(spark, chunk_set(spark, sf_dir), "chunks", "filename string, chunk_size long, chunk_bytes long")


ROUND_TRIP = f"WITH {fx.SQL_SAMPLES} SELECT sample_id, md5(image) AS image_md5, text FROM samples"


@query("tar_roundtrip", f"""WITH {fx.SQL_SAMPLES}
SELECT 'train_' || lpad(sample_id::VARCHAR, 7, '0') AS key, md5(image) AS image_md5, text FROM samples""")
def tar_roundtrip(spark, sf_dir):
    rows = read_shards(spark, "tarshards", tar_set(spark, sf_dir))
    return rows.select(F.col("__key__").alias("key"), F.md5("jpg").alias("image_md5"),
                       F.decode("txt", "UTF-8").alias("text"))


@query("mds_roundtrip", ROUND_TRIP)
def mds_roundtrip(spark, sf_dir):
    rows = read_shards(spark, "mds", mds_set(spark, sf_dir, compression="zstd", hashes="sha1"))
    return rows.select(F.col("idx").alias("sample_id"), F.md5("image").alias("image_md5"), "text")


@query("chunk_roundtrip", f"""WITH {fx.SQL_SAMPLES} SELECT md5(image) AS image_md5, text FROM samples""")
def chunk_roundtrip(spark, sf_dir):
    rows = read_shards(spark, "chunks", chunk_set(spark, sf_dir))
    return rows.select(F.md5("image_bytes").alias("image_md5"), "text")


LOADERS = 3


@query("load_epoch_order", f"""WITH RECURSIVE {ROLLED_OVERSHOOT},
shards AS (SELECT epoch, shard, row_number() OVER (PARTITION BY epoch ORDER BY md5('{fx.SEED}:' || epoch || ':' || {TAR_NAME})) - 1 AS nth
  FROM (SELECT DISTINCT shard FROM rolled), (SELECT unnest([1, 2]) AS epoch))
SELECT epoch, nth % {LOADERS} AS worker, row_number() OVER (PARTITION BY epoch, nth % {LOADERS} ORDER BY nth, slot) - 1 AS place,
  'train_' || lpad(sample_id::VARCHAR, 7, '0') AS key
FROM rolled JOIN shards USING (shard)""")
def load_epoch_order(spark, sf_dir):
    """Two epochs of a tar set: shards in another order each, dealt to workers."""
    path = tar_set(spark, sf_dir)

    def read(epoch):
        rows = read_shards(spark, "tarshards", path, epoch=str(epoch), seed=str(fx.SEED), workers=str(LOADERS))
        return rows.select(F.lit(epoch).alias("epoch"), F.col("worker").cast("long").alias("worker"), "place",
                           F.col("__key__").alias("key"))

    return read(1).union(read(2))


FIELD_MAP = {"image": "jpg", "caption": "txt"}


@query("indexed_tar_roundtrip", f"""WITH {fx.SQL_ORDERED}
SELECT pos * 4 // count(*) OVER () AS worker, pos, 'train_' || lpad(sample_id::VARCHAR, 7, '0') AS key,
       md5(image) AS image_md5, text AS caption
FROM ordered""")
def indexed_tar_roundtrip(spark, sf_dir):
    path = tar_set(spark, sf_dir)
    prepare_index(spark, path, FIELD_MAP)
    rows = read_shards(spark, "tarslices", path, workers="4", max_len="10")
    return rows.select("worker", "pos", F.col("__key__").alias("key"), F.md5("image").alias("image_md5"), "caption")


SAMPLE_INDEX = f"""WITH RECURSIVE {ROLLED_OVERSHOOT},
sized_rows AS (SELECT shard, slot, sample_id, sz,
  1024 + (image_bytes + 511) // 512 * 512 + (text_bytes + 511) // 512 * 512 AS stored
  FROM rolled JOIN samples USING (sample_id))
SELECT {TAR_NAME} AS shard, slot AS "row", 'train_' || lpad(sample_id::VARCHAR, 7, '0') AS key,
  (sum(stored) OVER w - stored)::BIGINT AS "begin", (sum(stored) OVER w)::BIGINT AS "end", sz AS payload_bytes
FROM sized_rows WINDOW w AS (PARTITION BY shard ORDER BY slot ROWS UNBOUNDED PRECEDING)"""


@query("tar_sample_index", SAMPLE_INDEX)
def sample_index(spark, sf_dir):
    return tar_sample_index(spark, tar_set(spark, sf_dir))


@query("written_sample_index", SAMPLE_INDEX)
def sample_index_of_the_writer(spark, sf_dir):
    """The same as its writer listed it, without a look into the shards."""
    return tar_sample_index(spark, tar_set(spark, sf_dir, offsets=True))


# Sets that are written in several jobs, some of which fail. Shards are cut by row count.
def numbered(spark, sf_dir, rows_per_shard=fx.TAR_ROWS):
    payload = fx.samples(spark, sf_dir).select("sample_id", F.col("image").alias("jpg"), F.encode("text", "UTF-8").alias("txt"))
    cut = placed(spark, sf_dir).select("sample_id", "pos", by_count(F.col("pos"), rows_per_shard).alias("shard"))
    return payload.join(cut, "sample_id").withColumn("__key__", sample_key(F.col("sample_id"), "train"))


SHARDS_PER_TASK = 200


def put(rows, path, mode, **options):
    register(rows.sparkSession)
    numbers = rows.agg(F.min("shard").alias("first"), F.max("shard").alias("last")).first()
    # Shards are cut by rows, so tasks go by the number of shards; even or odd numbers alone spread by their hash.
    tasks = 8 if numbers["last"] is None else max(8, (numbers["last"] - numbers["first"]) // SHARDS_PER_TASK + 1)
    clustered = cluster_by_shard(rows.withColumn("shard_task", F.hash("shard")), tasks * TASK_BYTES, tasks, ["pos"])
    clustered.select("shard", "__key__", "jpg", "txt").write.format("tarshards").mode(mode).options(**options).save(path)


def put_and_fail(rows, path, mode):
    """A write whose task is lost in its last shard, when others are complete."""
    last = rows.agg(F.max("shard")).first()[0]
    lost = F.when(F.col("shard") == last, F.raise_error(F.lit("task lost"))).otherwise(F.col("jpg"))
    try:
        put(rows.withColumn("jpg", lost), path, mode)
    except Exception as error:
        if "task lost" not in str(error):
            raise
    else:
        raise AssertionError("the write did not fail")


def listed_with_rows(spark, path):
    """What a listing and the index say of a set: every file with the rows that are read from it."""
    rows = read_shards(spark, "tarshards", path).groupBy(F.col("shard").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("__key__").alias("first_key"), F.max("__key__").alias("last_key"))
    return list_shards(spark, path).select(F.col("name").alias("file")).join(rows, "file", "full")


def sql_listed(rows_per_shard):
    return f"""WITH {fx.SQL_ORDERED}, cut AS (SELECT *, pos // {rows_per_shard} AS shard,
  'train_' || lpad(sample_id::VARCHAR, 7, '0') AS key FROM ordered)
SELECT {TAR_NAME} AS file, count(*) AS n_rows, min(key) AS first_key, max(key) AS last_key FROM cut GROUP BY shard"""


@query("append_shards", sql_listed(fx.TAR_ROWS))
def append_shards(spark, sf_dir):
    """Even shards, then odd ones appended, then an append that fails."""
    rows, path = numbered(spark, sf_dir), fresh_dir(spark, "appended")
    put(rows.filter("shard % 2 = 0"), path, "overwrite")
    put(rows.filter("shard % 2 = 1"), path, "append")
    put_and_fail(rows.withColumn("shard", F.col("shard") + 500_000), path, "append")
    return listed_with_rows(spark, path)


@query("overwrite_failed", sql_listed(fx.TAR_ROWS))
def overwrite_failed(spark, sf_dir):
    """A set after an overwrite, of other shards under the same names, that fails."""
    path = fresh_dir(spark, "kept")
    put(numbered(spark, sf_dir), path, "overwrite")
    put_and_fail(numbered(spark, sf_dir, 2 * fx.TAR_ROWS), path, "overwrite")
    return listed_with_rows(spark, path)


@query("overwrite_shards", sql_listed(2 * fx.TAR_ROWS))
def overwrite_shards(spark, sf_dir):
    """A set after an overwrite by half as many shards."""
    path = fresh_dir(spark, "replaced")
    put(numbered(spark, sf_dir), path, "overwrite")
    put(numbered(spark, sf_dir, 2 * fx.TAR_ROWS), path, "overwrite")
    return listed_with_rows(spark, path)


@query("shard_lists", sql_listed(fx.TAR_ROWS))
def shard_lists(spark, sf_dir):
    """Even shards, indexed in lists of four numbers, then odd ones appended: a whole read, planned from the lists."""
    rows, path = numbered(spark, sf_dir), fresh_dir(spark, "lists")
    put(rows.filter("shard % 2 = 0"), path, "overwrite", shards_per_list="4")
    put(rows.filter("shard % 2 = 1"), path, "append")
    return listed_with_rows(spark, path)


@query("shard_lists_overwritten", sql_listed(2 * fx.TAR_ROWS))
def shard_lists_overwritten(spark, sf_dir):
    """A set in lists, overwritten by half as many shards, then an append that fails."""
    path = fresh_dir(spark, "lists-replaced")
    put(numbered(spark, sf_dir), path, "overwrite", shards_per_list="4")
    put(numbered(spark, sf_dir, 2 * fx.TAR_ROWS), path, "overwrite", shards_per_list="3")
    put_and_fail(numbered(spark, sf_dir).withColumn("shard", F.col("shard") + 500_000), path, "append")
    return listed_with_rows(spark, path)


# The bytes the damage leaves of the last shard.
KEPT = "(raw + 1024 + 10239) // 10240 * 10240 // 2 // 512 * 512 - 100"


def damaged_set(spark, sf_dir):
    """A tar set whose last shard has lost its second half."""
    path = tar_set(spark, sf_dir)
    filesystem, base = locate(path)
    last = read_json(filesystem, f"{base}/index.json")["shards"][-1]["file"]
    with filesystem.open_input_stream(f"{base}/{last}", compression=None) as stream:
        data = stream.read()
    with filesystem.open_output_stream(f"{base}/{last}", compression=None) as stream:
        stream.write(data[:len(data) // 2 // 512 * 512 - 100])
    return path


DAMAGED_SQL = f"""WITH RECURSIVE {ROLLED_OVERSHOOT},
ends AS (SELECT shard, sum(1024 + (image_bytes + 511) // 512 * 512 + (text_bytes + 511) // 512 * 512)
    OVER (PARTITION BY shard ORDER BY slot ROWS UNBOUNDED PRECEDING) AS "end" FROM rolled JOIN samples USING (sample_id)),
totals AS (SELECT shard, max("end") AS raw FROM ends GROUP BY shard)
SELECT {TAR_NAME} AS shard, count(*) FILTER ("end" <= {KEPT}) AS delivered, count(*) AS samples, TRUE AS has_reason
FROM ends JOIN totals USING (shard) WHERE shard = (SELECT max(shard) FROM ends) GROUP BY shard"""


@query("dropped_shards", DAMAGED_SQL)
def dropped_shards(spark, sf_dir):
    """What a read that drops damage says about what it dropped, beside its rows."""
    report = fresh_dir(spark, "report")
    rows = read_shards(spark, "tarshards", damaged_set(spark, sf_dir), mode="DROPMALFORMED", report=report)
    rows.write.format("noop").mode("overwrite").save()
    return damaged(spark, report).select("shard", "delivered", "samples", (F.length("reason") > 0).alias("has_reason"))


@query("skip_corrupt_shards", f"""WITH RECURSIVE {ROLLED_OVERSHOOT},
ends AS (SELECT shard, sum(1024 + (image_bytes + 511) // 512 * 512 + (text_bytes + 511) // 512 * 512)
    OVER (PARTITION BY shard ORDER BY slot ROWS UNBOUNDED PRECEDING) AS "end" FROM rolled JOIN samples USING (sample_id)),
totals AS (SELECT shard, max("end") AS raw, shard = (SELECT max(shard) FROM ends) AS damaged FROM ends GROUP BY shard)
SELECT {TAR_NAME} AS shard, count(*) FILTER (NOT damaged OR "end" <= {KEPT}) AS n_rows, max(damaged::BIGINT) AS n_corrupt
FROM ends JOIN totals USING (shard) GROUP BY shard""")
def skip_corrupt_shards(spark, sf_dir):
    """The last shard loses its second half; what the three read modes deliver of the set."""
    path = damaged_set(spark, sf_dir)
    schema = "shard string, __key__ string, jpg binary, txt binary, _corrupt string"
    rows = read_shards(spark, "tarshards", path, schema, mode="PERMISSIVE")
    return rows.groupBy("shard").agg(F.count("__key__").alias("n_rows"), F.count("_corrupt").alias("n_corrupt"))


@query("reconcile", """SELECT doc_id AS sample_id, 1::BIGINT AS in_source, 0::BIGINT AS in_shards, 'missing' AS problem
FROM documents WHERE octet_length(encode(text)) = 0
UNION ALL
SELECT l.doc_id, 1, 2, 'duplicated' FROM labels l WHERE l.toxic = 1""")
def reconcile_shards(spark, sf_dir):
    """Toxic documents are written a second time; everything else must be there once."""
    rows = fx.samples(spark, sf_dir)
    written = read_shards(spark, "mds", mds_set(spark, sf_dir)).select(F.col("idx").alias("sample_id"))
    again = fx.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("sample_id"))
    return reconcile(rows.select("sample_id"), written.unionByName(again))
