"""Names and object-store paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_key(sample_id: Column, split: str = "train") -> Column:
    return F.format_string(f"{split}_%07d", sample_id)


def shard_name(shard: Column, prefix: str = "dataset", split: str = "train", extension: str = "tar") -> Column:
    return F.format_string(f"{prefix}-{split}-%06d.{extension}", shard)


def normalize_uri(uri: Column, subdir: str, scheme: str = "s3") -> Column:
    """``[scheme://]bucket/a//b/`` to a struct of uri, bucket and key, with ``subdir`` appended to the key."""
    bare = F.regexp_replace(uri, f"^{scheme}://", "")
    segments = F.split(bare, "/")
    bucket = F.element_at(segments, 1)
    kept = F.filter(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: s != "")
    key = F.array_join(F.concat(kept, F.array(F.lit(subdir))), "/")
    return F.when(
        F.length(uri) > 0,
        F.struct(F.concat(F.lit(f"{scheme}://"), bucket, F.lit("/"), key).alias("uri"),
                 bucket.alias("bucket"), key.alias("key")),
    )


def is_shard_name(name: Column, split: str = "train", prefix: str = "dataset", extension: str = "tar") -> Column:
    """Whether an object name is a shard of the split: fixed ending, prefix anywhere in the name."""
    return name.endswith(f".{extension}") & name.contains(f"{prefix}-{split}-")
