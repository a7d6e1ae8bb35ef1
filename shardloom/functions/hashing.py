"""Hash-derived order, randomness and digests: functions of the data alone, so any retry or repartitioning
gives the same value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _joined(*parts: Column | str | int) -> Column:
    return F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def order_key(sample_id: Column, seed: int = 42, epoch: Column | int = 0) -> Column:
    """Sort key of the seeded permutation of one epoch."""
    return F.md5(_joined(seed, epoch, sample_id))


def order_bucket(key: Column, digits: int) -> Column:
    """Leading hex digits of an order key: 16**digits equally likely, order-preserving ranges."""
    return F.substring(key, 1, digits)


def unit_fraction(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1) from the joined parts (32 bits)."""
    return F.conv(F.substring(F.md5(_joined(*parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def payload_digest(content: Column, algorithm: str = "sha256") -> Column:
    if algorithm == "sha256":
        return F.sha2(content, 256)
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm == "crc32":
        return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")
    raise ValueError(f"unknown digest {algorithm!r}")
