"""Bring the narrow shard assignment to the wide payload."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from shardloom.functions.hashing import order_bucket, order_key

# Boundary rows of about 200 bytes each that are broadcast at most: some 400 MB, a million shards.
BROADCAST_BOUNDARIES = 2_000_000


def by_sample_id(payload: DataFrame, assigned: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """Equi join on the id: both sides shuffle on it, payload included."""
    return payload.join(assigned.select(sample_id, "shard", "slot"), sample_id)


def by_boundaries(payload: DataFrame, assigned: DataFrame, seed: int = 42, epoch: int = 0,
                  sample_id: str = "sample_id", n_shards: int | None = None,
                  broadcast_limit: int = BROADCAST_BOUNDARIES) -> DataFrame:
    """Shards are ranges of the seeded order, so a payload row finds its shard by its own order key.

    The range lookup is an equi join on a leading slice of the key: a boundary is listed under every slice its
    shard reaches, so there are at most twice as many as shards. With at most ``broadcast_limit`` such rows the payload is not
    shuffled at all; beyond that Spark shuffles both sides on the slice, which hashes evenly.
    """
    key = order_key(F.col(sample_id), seed, epoch)
    first = assigned.filter("slot = 0").select("shard", F.struct(key.alias("order_key"), sample_id).alias("start"))
    if n_shards is None:
        n_shards = first.count()
    digits = max(1, math.floor(math.log(max(n_shards, 1), 16)))
    ends = first.select((F.col("shard") - 1).alias("shard"), F.col("start").alias("end"))

    def slice_no(key):
        return F.conv(order_bucket(key, digits), 16, 10).cast("long")

    last_slice = F.lit(16**digits - 1).cast("long")
    boundaries = (
        first.join(ends, "shard", "left")
        .withColumn("slice", F.explode(F.sequence(
            slice_no(F.col("start.order_key")), F.coalesce(slice_no(F.col("end.order_key")), last_slice))))
    )
    keyed = payload.withColumn("order_key", key)
    keyed = keyed.withColumn("slice", slice_no(F.col("order_key")))
    if n_shards + 16**digits <= broadcast_limit:
        boundaries = F.broadcast(boundaries)
    here = F.struct(F.col("order_key"), F.col(sample_id))
    inside = (keyed["slice"] == boundaries["slice"]) & (here >= F.col("start")) & (
        F.col("end").isNull() | (here < F.col("end")))
    return keyed.join(boundaries, inside).select(*[keyed[c] for c in payload.columns], keyed["order_key"], "shard")


def by_file_rows(payload: DataFrame, assigned: DataFrame, file: str, row: str, part: str, shard: Column,
                 broadcast_limit: int = BROADCAST_BOUNDARIES) -> DataFrame:
    """Shards that are runs of rows of files: a payload row finds its shard by file and row number.

    ``part`` cuts a file's rows into ranges on both sides, so the join key of a huge file is not one value.
    There is one run per shard and part; the payload is not shuffled while those fit ``broadcast_limit``.
    """
    runs = assigned.groupBy(file, part, shard.alias("shard")).agg(
        F.min(row).alias("_first"), F.max(row).alias("_last"))
    if runs.count() <= broadcast_limit:
        runs = F.broadcast(runs)
    inside = ((payload[file] == runs[file]) & (payload[part] == runs[part])
              & payload[row].between(F.col("_first"), F.col("_last")))
    return payload.join(runs, inside).select(*[payload[c] for c in payload.columns], "shard")
