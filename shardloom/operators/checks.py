"""Reconciliation of shards with their source, and shard digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shardloom.functions.hashing import payload_digest


def reconcile(source: DataFrame, written: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """Samples that are not exactly once on both sides, by problem. Ids are counted before they are joined."""
    there = source.groupBy(sample_id).agg(F.count(F.lit(1)).alias("in_source"))
    here = written.groupBy(sample_id).agg(F.count(F.lit(1)).alias("in_shards"))
    both = there.join(here, sample_id, "full_outer").na.fill(0, ["in_source", "in_shards"])
    problem = (F.when(F.col("in_shards") == 0, "missing").when(F.col("in_source") == 0, "unexpected")
               .when(F.col("in_shards") > F.col("in_source"), "duplicated")
               .when(F.col("in_shards") < F.col("in_source"), "lost copy"))
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def row_digest(*parts: Column) -> Column:
    """Digest of a sample; lengths keep neighbouring parts apart."""
    return payload_digest(F.concat_ws(":", *[
        F.concat(F.octet_length(p).cast("string"), F.lit(":"), payload_digest(p)) for p in parts]))


def shard_digest(assigned_rows: DataFrame, digest: str = "digest", group: tuple[str, ...] = ()) -> DataFrame:
    """One digest per shard over its ordered row digests; a shard is bounded by its limits."""
    ordered = F.array_sort(F.collect_list(F.struct("slot", digest)))
    return assigned_rows.groupBy(*group, "shard").agg(
        F.count(F.lit(1)).alias("n_rows"),
        payload_digest(F.array_join(F.transform(ordered, lambda r: r[digest]), "")).alias("digest"))
