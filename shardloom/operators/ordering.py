"""Order, global positions and splits without a global sort through one task."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shardloom.functions.hashing import order_bucket, order_key, unit_fraction
from shardloom.session import stage


ROWS_PER_BUCKET = 1_000_000


def bucket_digits(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex digits of the order key that make buckets of at most about ``rows_per_bucket`` rows, for any count."""
    return max(1, math.ceil(math.log(max(n_rows / rows_per_bucket, 1), 16)))


def with_order(df: DataFrame, seed: int = 42, epoch: Column | int = 0, digits: int | None = None,
               sample_id: str = "sample_id") -> DataFrame:
    """Add the seeded order key and the bucket it falls in.

    Buckets follow the row count unless ``digits`` is given; give it where ``df`` is costly to count.
    """
    digits = digits or bucket_digits(df.count())
    keyed = df.withColumn("order_key", order_key(F.col(sample_id), seed, epoch))
    return keyed.withColumn("bucket", order_bucket(F.col("order_key"), digits))


def in_seeded_order(df: DataFrame, seed: int = 42, epoch: int = 0, sample_id: str = "sample_id") -> DataFrame:
    """All rows in the seeded permutation: a range exchange and a sort per partition."""
    key = order_key(F.col(sample_id), seed, epoch)
    return df.withColumn("order_key", key).orderBy("order_key", sample_id)


def bucket_offsets(rows: DataFrame, bucket: str = "bucket", group: tuple[str, ...] = (),
                   size: str | None = None) -> DataFrame:
    """First position (and byte) of every bucket: a running sum over bucket totals, never over rows."""
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    if size:
        aggregates.append(F.sum(size).alias("_bytes"))
    totals = rows.groupBy(*group, bucket).agg(*aggregates)
    before = Window.partitionBy(*[F.col(g) for g in group]).orderBy(bucket)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    columns = [*group, bucket, (F.row_number().over(before) - 1).cast("long").alias("bucket_no"),
               F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).cast("long").alias("first_pos")]
    if size:
        columns.append(F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).cast("long").alias("first_byte"))
    return totals.select(*columns)


def with_positions(rows: DataFrame, order_by: list[str], bucket: str = "bucket", group: tuple[str, ...] = (),
                   size: str | None = None) -> DataFrame:
    """Add the 0-based global ``pos`` (and exclusive byte prefix ``cum``) of the order (bucket, order_by).

    Rows are ranked inside their bucket and shifted by the bucket's offset. ``rows`` is read twice: stage it
    first if computing it reads payloads.
    """
    keys = [*group, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order_by)
    local = rows.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    if size:
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = local.withColumn("_prefix", F.sum(size).over(upto) - F.col(size))
    placed = local.join(bucket_offsets(rows, bucket, group, size), keys)
    placed = placed.withColumn("pos", F.col("_rank") + F.col("first_pos"))
    if size:
        placed = placed.withColumn("cum", F.col("_prefix") + F.col("first_byte"))
    return placed.drop("_rank", "_prefix", "first_pos", "first_byte")


def range_buckets(rows: DataFrame, order_by: list[str], buckets: int | None = None) -> DataFrame:
    """Staged rows with ``bucket``, near-equal ranges of any order: of (file, row), say, where one file may hold
    most rows and most files few.

    The bucket is the range partition a row landed in. Staging fixes it; positions and shards do not depend
    on where the cuts fell. ``rows`` is read once to sample the ranges, and once to count where ``buckets`` isn't given.
    """
    n = buckets or max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS_PER_BUCKET))
    ranged = rows.repartitionByRange(n, *order_by)
    return stage(ranged.withColumn("bucket", F.spark_partition_id().cast("long")))


def in_file_order(df: DataFrame, file: str, row: str) -> DataFrame:
    """The unshuffled path: sorted files, rows in file order."""
    return df.orderBy(file, row)


def with_file_rows(rows: DataFrame) -> DataFrame:
    """Add the ``file`` a row is read from and its ``row`` number there, by Spark's hidden metadata columns: the order of a file
    needs no column of its own, and holds for files of several row groups and for tasks that read a part of one."""
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def ratio_bounds(ratios: list[float], names: list[str]) -> list[tuple[str, float, float]]:
    total = float(sum(ratios))
    if total <= 0 or min(ratios) < 0 or len(ratios) != len(names):
        raise ValueError(f"bad split ratios {ratios} for {names}")
    bounds, start = [], 0.0
    for name, ratio in zip(names, ratios):
        bounds.append((name, start / total, (start + ratio) / total))
        start += ratio
    return bounds


def split_shards(shards: DataFrame, n_shards: Column | int, ratios: list[float],
                 names: list[str] = ["train", "val", "test"], shard: str = "shard") -> DataFrame:
    """Contiguous cut of the ordered shard list by ratio."""
    n = n_shards if isinstance(n_shards, Column) else F.lit(n_shards)
    label = F.lit(names[-1])
    for name, _, end in reversed(ratio_bounds(ratios, names)):
        label = F.when(F.col(shard) < F.round(n * F.lit(end)), F.lit(name)).otherwise(label)
    return shards.withColumn("split", label)


def split_samples(samples: DataFrame, ratios: list[float], names: list[str] = ["train", "val", "test"],
                  seed: int = 42, sample_id: str = "sample_id") -> DataFrame:
    """Split by sample: a hash of the id picks the part, so the split survives any reordering."""
    draw = unit_fraction("split", seed, F.col(sample_id))
    label = F.lit(names[-1])
    for name, _, end in reversed(ratio_bounds(ratios, names)):
        label = F.when(draw < F.lit(end), F.lit(name)).otherwise(label)
    return samples.withColumn("split", label)


class HeldRows:
    """Rows by the number of their arrival, in the batches they came in; taken rows go when most of a batch is gone."""

    def __init__(self):
        import numpy as np

        self.parts, self.rows = [], 0
        self.number = self.part = self.row = np.zeros(0, np.int64)

    def add(self, batch, first: int) -> None:
        import numpy as np

        n = batch.num_rows
        self.number = np.append(self.number, np.arange(first, first + n))
        self.part = np.append(self.part, np.full(n, len(self.parts)))
        self.row = np.append(self.row, np.arange(n))
        self.parts.append(batch)
        self.rows += n

    def take(self, numbers):
        """The rows of these numbers, in this order; they are held no longer."""
        import numpy as np
        import pyarrow as pa

        at = np.searchsorted(self.number, numbers)
        part, row = self.part[at], self.row[at]
        order = np.argsort(part, kind="stable")
        picked = [self.parts[p].take(pa.array(row[order][part[order] == p])) for p in np.unique(part)]
        out = pa.Table.from_batches(picked).combine_chunks().take(pa.array(np.argsort(order))).combine_chunks()
        left = np.ones(len(self.number), bool)
        left[at] = False
        self.number, self.part, self.row = self.number[left], self.part[left], self.row[left]
        return out

    def compact(self) -> None:
        """Copies at most as many rows as were taken since it last did."""
        if self.rows <= 2 * len(self.number) + 1024:
            return
        numbers = self.number
        kept = self.take(numbers).to_batches() if len(numbers) else []
        self.__init__()
        first = 0
        for batch in kept:
            self.add(batch, first)
            first += batch.num_rows
        self.number = numbers


def buffer_draw(seed: int, epoch: int, run: str, row: int) -> str:
    """What decides about a row: hex digits of a hash, for any partitioning and any retry the same."""
    return hashlib.md5(f"{seed}:{epoch}:{run}:{row}".encode()).hexdigest()


def shuffle_through_buffer(df: DataFrame, buffer_rows: int, seed: int = 42, epoch: int = 0,
                           within: str | None = None) -> DataFrame:
    """The order in which a reader with a bounded shuffle buffer emits rows.

    A run of rows is what has one value of ``within`` (a shard, say) and arrives together; without it, a partition. Adds the
    places in the run that a row ``arrived`` at and is ``emitted`` at. A new row of a full buffer takes the slot that the first
    eight hex digits of its draw give, modulo the buffer, and what was there is emitted; at the end of the run the rest is
    emitted in the order of the rows' draws. Draws depend on seed, epoch, run and row alone. A task holds one buffer and one batch.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("arrived", T.LongType(), False),
                                              T.StructField("emitted", T.LongType(), False)])
    names = df.columns

    def emit(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        run, held, slots, arrived, emitted = None, HeldRows(), [], 0, 0

        def out(numbers):
            nonlocal emitted
            if not numbers:
                return []
            table = held.take(np.array(numbers))
            table = table.append_column("arrived", pa.array(numbers, pa.int64()))
            table = table.append_column("emitted", pa.array(np.arange(emitted, emitted + len(numbers)), pa.int64()))
            emitted += len(numbers)
            return table.combine_chunks().to_batches()

        def rest():
            return out(sorted(slots, key=lambda n: (buffer_draw(seed, epoch, run, n), n)))

        for batch in batches:
            if not batch.num_rows:
                continue
            if within is None:
                cuts, values = [0, batch.num_rows], [str(TaskContext.get().partitionId())]
            else:
                column = batch.column(names.index(within)).to_pylist()
                cuts = [0, *(i for i in range(1, len(column)) if column[i] != column[i - 1]), len(column)]
                values = [str(column[i]) for i in cuts[:-1]]
            for value, a, b in zip(values, cuts, cuts[1:]):
                if value != run:
                    yield from rest()
                    run, held, slots, arrived, emitted = value, HeldRows(), [], 0, 0
                held.add(batch.slice(a, b - a), arrived)
                sent = []
                for number in range(arrived, arrived + b - a):
                    if len(slots) < buffer_rows:
                        slots.append(number)
                    else:
                        slot = int(buffer_draw(seed, epoch, run, number)[:8], 16) % buffer_rows
                        sent.append(slots[slot])
                        slots[slot] = number
                arrived += b - a
                yield from out(sent)
                held.compact()
        yield from rest()

    return df.mapInArrow(emit, schema)
