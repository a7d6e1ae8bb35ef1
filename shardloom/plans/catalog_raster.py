"""Queries over rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions.paths import sample_key
from shardloom.operators.assignment import by_count
from shardloom.operators.loading import stack_tensors
from shardloom.operators.ordering import with_order, with_positions
from shardloom.operators.raster import (
    channel_rule,
    crop_box,
    flip_flag,
    map_samples,
    normalize,
    preprocess,
    rejected,
    resized,
)
from shardloom.plans import fixtures as fx
from shardloom.plans.prepare import cluster_by_shard, read_shards
from shardloom.plans.registry import query
from shardloom.session import fresh_dir, stage
from shardloom.sources import register

# Four readings of the same 64 bytes, by the channel rule each one meets.
SHAPES = {1: (8, 8), 2: (8, 4), 3: (11, 2), 4: (4, 4)}


def mixed(spark, sf_dir):
    """The 64 bytes of each raster read with 1 to 4 channels; three channels take the first two bytes again."""
    rows = fx.rasters(spark, sf_dir)
    channels = (F.pmod(F.col("sample_id"), F.lit(4)) + 1).cast("int")

    def side(n):
        return F.element_at(F.array(*[F.lit(shape[n]) for shape in SHAPES.values()]), channels)

    shaped = rows.select("sample_id", side(0).alias("height"), side(1).alias("width"), channels.alias("channels"), "data")
    return shaped.withColumn("data", F.substring(
        F.concat("data", "data"), F.lit(1), F.col("height") * F.col("width") * F.col("channels")))


# A level as a half-precision fraction of 255: eleven significant bits, ties to even.
HALF = """list_transform({levels}, lambda v: CASE WHEN v = 0 THEN 0.0::FLOAT ELSE
  (round_even((v::FLOAT / 255::FLOAT)::DOUBLE / pow(2.0, floor(log2((v::FLOAT / 255::FLOAT)::DOUBLE)) - 10), 0)
   * pow(2.0, floor(log2((v::FLOAT / 255::FLOAT)::DOUBLE)) - 10))::FLOAT END)"""


# Half-precision levels are whole multiples of 2**-18: exact as integers, so all values compare in one digest.
SQL_VALUES = """len({values}) AS n_values,
  md5(array_to_string(list_transform({values}, lambda v: (v * 262144)::BIGINT), ',')) AS values_md5"""


def with_digest(tensors):
    exact = F.transform("values", lambda v: (v * 262144).cast("long"))
    return tensors.select("sample_id", "channels", "height", "width", F.size("values").cast("long").alias("n_values"),
                          F.md5(F.array_join(exact, ",")).alias("values_md5"))


@query("raster_normalize", f"""WITH {fx.sql_rasters()},
planes AS (SELECT sample_id, {HALF.format(levels='levels')} AS plane FROM rasters)
SELECT sample_id, 3 AS channels, 8 AS height, 8 AS width,
       {SQL_VALUES.format(values='list_concat(list_concat(plane, plane), plane)')}
FROM planes""")
def raster_normalize(spark, sf_dir):
    return with_digest(normalize(fx.rasters(spark, sf_dir)))


# One reading per channel count: replicate a plane, or pick three of the interleaved ones.
@query("raster_rgb", f"""WITH {fx.sql_rasters()},
channelled AS (SELECT sample_id, sample_id % 4 + 1 AS c, levels, list_concat(levels, levels[1:2]) AS more FROM rasters),
flat AS (
  SELECT sample_id, CASE c WHEN 1 THEN list_concat(list_concat(levels, levels), levels)
    WHEN 3 THEN list_concat(list_concat([more[i * 3 + 1] for i in range(22)], [more[i * 3 + 2] for i in range(22)]),
                            [more[i * 3 + 3] for i in range(22)])
    ELSE list_concat(list_concat([levels[i * 4 + 1] for i in range(16)], [levels[i * 4 + 2] for i in range(16)]),
                     [levels[i * 4 + 3] for i in range(16)]) END AS planes, c
  FROM channelled WHERE c <> 2)
SELECT sample_id, 3 AS channels, CASE c WHEN 1 THEN 8 WHEN 3 THEN 11 ELSE 4 END AS height,
       CASE c WHEN 1 THEN 8 WHEN 3 THEN 2 ELSE 4 END AS width, {SQL_VALUES.format(values=HALF.format(levels='planes'))}
FROM flat""")
def raster_rgb(spark, sf_dir):
    return with_digest(normalize(mixed(spark, sf_dir)))


@query("raster_channels", """SELECT vec_id % 4 + 1 AS channels,
  ['replicate', 'reject', 'keep', 'first three'][vec_id % 4 + 1] AS rule, count(*) AS n_rasters
FROM embeddings GROUP BY ALL""")
def raster_channels(spark, sf_dir):
    rows = mixed(spark, sf_dir).withColumn("rule", channel_rule(F.col("channels")))
    return rows.groupBy(F.col("channels").cast("long").alias("channels"), "rule").agg(
        F.count(F.lit(1)).alias("n_rasters"))


# Every third raster loses its last byte, so both reasons occur.
@query("rejected_rasters", """SELECT vec_id AS sample_id, (vec_id % 4 + 1)::INTEGER AS channels,
  CASE WHEN embedding IS NULL THEN 'no data' WHEN vec_id % 3 = 0 THEN 'bytes differ from shape' ELSE 'channels' END AS reason
FROM embeddings WHERE embedding IS NULL OR vec_id % 3 = 0 OR vec_id % 4 = 1""")
def rejected_rasters(spark, sf_dir):
    cut = F.when(F.col("sample_id") % 3 == 0, F.substring("data", F.lit(1), F.octet_length("data") - 1))
    return rejected(mixed(spark, sf_dir).withColumn("data", cut.otherwise(F.col("data")))).select(
        "sample_id", "channels", "reason")


def _draw(what: str, extra: str = "") -> str:
    return f"(('0x' || substr(md5('{what}:{fx.SEED}:0:' || doc_id{extra}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("flip_flags", f"SELECT doc_id AS sample_id, {_draw('flip')} < 0.5 AS flip FROM documents")
def flip_flags(spark, sf_dir):
    return fx.samples(spark, sf_dir).select("sample_id", flip_flag(F.col("sample_id"), fx.SEED).alias("flip"))


TRY = " || ':' || attempt"


# Heights and widths as documents give them: long texts make wide images.
@query("crop_boxes", f"""WITH sizes AS (
  SELECT doc_id, 32 + doc_id % 200 AS h, 32 + n_chars % 900 AS w FROM documents),
tries AS (SELECT *, unnest(range(1, 11)) AS attempt FROM sizes),
drawn AS (SELECT *, h * w * (0.08::DOUBLE + {_draw('area', TRY)} * (1.0::DOUBLE - 0.08::DOUBLE)) AS area,
  exp(ln(0.75::DOUBLE) + {_draw('aspect', TRY)} * (ln(4::DOUBLE / 3) - ln(0.75::DOUBLE))) AS aspect FROM tries),
boxes AS (SELECT *, round_even(sqrt(area * aspect), 0) AS bw, round_even(sqrt(area / aspect), 0) AS bh FROM drawn),
fitting AS (
  SELECT doc_id, h, w, attempt, floor({_draw('top', TRY)} * (h - bh + 1))::INTEGER AS top,
         floor({_draw('left', TRY)} * (w - bw + 1))::INTEGER AS lft, bh::INTEGER AS bh, bw::INTEGER AS bw
  FROM boxes WHERE bh BETWEEN 1 AND h AND bw BETWEEN 1 AND w),
chosen AS (SELECT doc_id, min_by([top, lft, bh, bw], attempt) AS box FROM fitting GROUP BY doc_id),
centre AS (SELECT doc_id, h, w, (CASE WHEN w / h > 4::DOUBLE / 3 THEN round_even(h * (4::DOUBLE / 3), 0) ELSE w END)::INTEGER AS bw,
  (CASE WHEN w / h < 0.75 THEN round_even(w / 0.75::DOUBLE, 0) ELSE h END)::INTEGER AS bh FROM sizes)
SELECT c.doc_id AS sample_id, coalesce(box[1], floor((h - bh) / 2))::INTEGER AS top,
       coalesce(box[2], floor((w - bw) / 2))::INTEGER AS "left",
       coalesce(box[3], bh) AS height, coalesce(box[4], bw) AS width
FROM centre c LEFT JOIN chosen USING (doc_id)""")
def crop_boxes(spark, sf_dir):
    sizes = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), (32 + F.col("doc_id") % 200).alias("h"), (32 + F.col("n_chars") % 900).alias("w"))
    box = crop_box(F.col("h"), F.col("w"), F.col("sample_id"), fx.SEED)
    return sizes.select("sample_id", box.alias("box")).select("sample_id", "box.*")


# Upsampling 8 to 16 weighs the two nearest of 8 by distance; edges keep one. All weights are exact in binary.
SQL_WEIGHTS = """weights AS (
  SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM (
    SELECT i, j, greatest(0.0::DOUBLE, 1 - abs(j + 0.5 - (i + 0.5) / 2)) AS w
    FROM (SELECT unnest(range(16)) AS i), (SELECT unnest(range(8)) AS j)) WHERE w > 0)"""


@query("raster_resize", f"""WITH {fx.sql_rasters()}, {SQL_WEIGHTS},
pixels AS (SELECT sample_id, unnest(levels) AS v, unnest(range(64)) AS place FROM rasters),
scaled AS (SELECT sample_id, r.i AS y, c.i AS x, floor(sum(r.w * c.w * v) + 0.5)::INTEGER AS v
  FROM pixels JOIN weights r ON r.j = place // 8 JOIN weights c ON c.j = place % 8 GROUP BY ALL)
SELECT sample_id, 16 AS height, 16 AS width, 3 AS channels,
  md5(unhex(string_agg(repeat(lpad(hex(v), 2, '0'), 3), '' ORDER BY y, x))) AS data_md5
FROM scaled GROUP BY sample_id""")
def raster_resize(spark, sf_dir):
    return resized(fx.rasters(spark, sf_dir), 16, 16).select(
        "sample_id", "height", "width", "channels", F.md5("data").alias("data_md5"))


@query("preprocess_samples", """SELECT vec_id AS sample_id, 3 AS channels, 16 AS height, 16 AS width,
  768::BIGINT AS n_values, TRUE AS in_range
FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 4 <> 1""")
def preprocess_samples(spark, sf_dir):
    """The training transform, then a user function over its batches. SQL checks rows, shapes and the value
    range; the pixels are compared with a plain loop in the tests."""
    tensors = preprocess(mixed(spark, sf_dir), side=16, seed=fx.SEED)

    def summarise(pdf):
        values = pdf["values"]
        return pdf.assign(n_values=values.map(len), in_range=values.map(lambda v: bool(0 <= v.min() and v.max() <= 1)))[
            ["sample_id", "channels", "height", "width", "n_values", "in_range"]]

    return map_samples(tensors, summarise,
                       "sample_id long, channels int, height int, width int, n_values long, in_range boolean")


# Job 2 as a whole: rasters out of tar shards, in an epoch's order, transformed and stacked to batches with key and text.
EPOCH, LOADERS, BATCH, SHARD_ROWS, SIDE = 1, 3, 32, 50, 16
SQL_FLIP = f"('0x' || substr(md5('flip:{fx.SEED}:{EPOCH}:' || sample_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5"


def raster_set(spark, sf_dir, rows_per_shard=SHARD_ROWS):
    """The rasters as tar shards: bytes, shape and a text each; null ones are rejected."""
    register(spark)
    rows = fx.rasters(spark, sf_dir).filter("data is not null")
    placed = with_positions(stage(with_order(rows.select("sample_id"), fx.SEED)), ["order_key", "sample_id"])
    stored = rows.join(placed.select("sample_id", "pos", by_count(F.col("pos"), rows_per_shard).alias("shard")), "sample_id")
    clustered = cluster_by_shard(stored.withColumn("shard_task", F.col("shard")), 0, 8, ["pos"])
    path = fresh_dir(spark, "rasters")
    clustered.select("shard", sample_key(F.col("sample_id"), "train").alias("__key__"), F.col("data").alias("raw"),
                     F.encode(F.concat_ws(",", "height", "width", "channels"), "UTF-8").alias("shape"),
                     F.encode(F.concat(F.lit("vector "), "sample_id"), "UTF-8").alias("txt")).write.format(
        "tarshards").mode("overwrite").save(path)
    return path


def load_tensors(spark, path, epoch, workers, batch_size, side, packed=True, random_crop=True):
    """Batches of a raster set in an epoch's order: nothing is shuffled, each task reads a worker's shards."""
    rows = read_shards(spark, "tarshards", path, "shard string, worker int, place long, __key__ string, raw binary, shape string, txt string",
                       epoch=str(epoch), seed=str(fx.SEED), workers=str(workers))
    sides = F.split("shape", ",")
    decoded = rows.select("worker", "place", F.col("__key__").alias("key"), F.col("txt").alias("text"), F.col("raw").alias("data"),
                          F.regexp_extract("__key__", "([0-9]+)", 1).cast("long").alias("sample_id"),
                          *[sides[i].cast("int").alias(c) for i, c in enumerate(("height", "width", "channels"))])
    tensors = preprocess(decoded, side, fx.SEED, epoch, packed, ("worker", "key", "text"), random_crop)
    return stack_tensors(tensors, batch_size, "worker", ("key", "text"))


@query("preprocess_pipeline", f"""WITH {fx.sql_rasters()}, {SQL_WEIGHTS},
placed AS (SELECT sample_id, row_number() OVER (ORDER BY md5('{fx.SEED}:0:' || sample_id), sample_id) - 1 AS pos FROM rasters),
shards AS (SELECT shard, row_number() OVER (ORDER BY md5('{fx.SEED}:{EPOCH}:dataset-train-' || lpad(shard::VARCHAR, 6, '0') || '.tar')) - 1 AS nth
  FROM (SELECT DISTINCT pos // {SHARD_ROWS} AS shard FROM placed)),
dealt AS (SELECT sample_id, nth % {LOADERS} AS worker,
  row_number() OVER (PARTITION BY nth % {LOADERS} ORDER BY nth, pos) - 1 AS place FROM placed JOIN shards ON shard = pos // {SHARD_ROWS}),
pixels AS (SELECT sample_id, unnest(levels) AS v, unnest(range(64)) AS spot FROM rasters),
scaled AS (SELECT sample_id, r.i AS y, c.i AS x, floor(sum(r.w * c.w * v) + 0.5)::INTEGER AS v
  FROM pixels JOIN weights r ON r.j = spot // 8 JOIN weights c ON c.j = spot % 8 GROUP BY ALL),
planes AS (SELECT sample_id, {HALF.format(levels=f"list(v ORDER BY y, CASE WHEN {SQL_FLIP} THEN -x ELSE x END)")} AS plane
  FROM scaled GROUP BY sample_id),
texts AS (SELECT sample_id, array_to_string(list_transform(plane, lambda v: (v * 262144)::BIGINT), ',') AS plane FROM planes)
SELECT worker::INTEGER AS worker, place // {BATCH} AS batch, count(*)::INTEGER AS n_rows,
  count(*) || ',3,{SIDE},{SIDE}' AS shape, string_agg('train_' || lpad(sample_id::VARCHAR, 7, '0'), ',' ORDER BY place) AS keys,
  string_agg('vector ' || sample_id, ',' ORDER BY place) AS texts,
  md5(string_agg(plane || ',' || plane || ',' || plane, ',' ORDER BY place)) AS values_md5
FROM dealt JOIN texts USING (sample_id) GROUP BY 1, 2""")
def preprocess_pipeline(spark, sf_dir):
    batches = load_tensors(spark, raster_set(spark, sf_dir), EPOCH, LOADERS, BATCH, SIDE, packed=False, random_crop=False)
    exact = F.transform("tensor", lambda v: (v * 262144).cast("long"))
    return batches.select("worker", "batch", "n_rows", F.array_join("shape", ",").alias("shape"),
                          F.array_join("key", ",").alias("keys"), F.array_join("text", ",").alias("texts"),
                          F.md5(F.array_join(exact, ",")).alias("values_md5"))
