"""Distribution over workers, batching and epochs: integer arithmetic on global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shardloom.operators.ordering import bucket_digits, with_order, with_positions


def round_robin(shard: Column, workers: int) -> Column:
    return F.pmod(shard, F.lit(workers)).cast("long")


def effective_workers(requested: Column | int, n_shards: Column, cpus: int) -> Column:
    asked = requested if isinstance(requested, Column) else F.lit(requested)
    return F.least(asked.cast("long"), n_shards.cast("long"), F.lit(cpus).cast("long"))


def range_worker(pos: Column, workers: int, total: Column) -> Column:
    """Worker of a position when rows are cut into contiguous, near-equal ranges."""
    return whole_division(pos * F.lit(workers), total)


def range_start(worker: Column, workers: int, total: Column) -> Column:
    return whole_division(worker * total + F.lit(workers - 1), F.lit(workers))


def whole_division(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative longs; ``/`` would go through doubles, which lose 2**53 and up."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def worker_slices(shards: DataFrame, workers: int, max_len: int = 100) -> DataFrame:
    """Cut every worker's portion of every shard into near-equal slices of about ``max_len`` rows.

    ``shards``: shard, first_pos, n_rows, total. Positions in the result are rows within the shard.
    """
    end = F.col("first_pos") + F.col("n_rows")
    low_worker = range_worker(F.col("first_pos"), workers, F.col("total"))
    high_worker = range_worker(end - 1, workers, F.col("total"))
    portions = (
        shards.filter(F.col("n_rows") > 0)
        .withColumn("worker", F.explode(F.sequence(low_worker, high_worker)))
        .withColumn("low", F.greatest(F.col("first_pos"), range_start(F.col("worker"), workers, F.col("total"))))
        .withColumn("high", F.least(end, range_start(F.col("worker") + 1, workers, F.col("total"))))
        .filter(F.col("low") < F.col("high"))
    )
    length = F.col("high") - F.col("low")
    pieces = F.greatest(F.lit(1).cast("long"), F.bround(length / F.lit(max_len)).cast("long"))
    base = F.col("low") - F.col("first_pos")
    return (
        portions.withColumn("pieces", pieces)
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .select("worker", "shard", "slice",
                (base + whole_division(F.col("slice") * length, F.col("pieces"))).alias("begin"),
                (base + whole_division((F.col("slice") + 1) * length, F.col("pieces"))).alias("end"))
    )


def fixed_batch(pos: Column, size: int) -> Column:
    return whole_division(pos, F.lit(size))


def batches(rows: DataFrame, size: int, order_by: list[str], group: tuple[str, ...], bucket: str,
            drop_last: bool = False) -> DataFrame:
    """Add ``batch`` and its ``slot`` within each group (a worker, say), in order; the last batch may be short.

    Ranks come from bucket offsets, so one heavy group spreads over its buckets. ``rows`` is read twice.
    """
    placed = with_positions(rows, order_by, bucket, group).drop("bucket_no")
    placed = (placed.withColumn("batch", fixed_batch(F.col("pos"), size))
              .withColumn("slot", F.pmod(F.col("pos"), F.lit(size)).cast("long")))
    if drop_last:
        totals = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        placed = placed.join(totals, list(group)).filter((F.col("batch") + 1) * size <= F.col("_n")).drop("_n")
    return placed


def batch_sizes(batched: DataFrame, group: tuple[str, ...], nominal: int) -> DataFrame:
    """Rows of each batch as delivered; the nominal size where a batch carries no payload to count."""
    return batched.groupBy(*group, "batch").agg(
        F.coalesce(F.nullif(F.count("sample_id"), F.lit(0)), F.lit(nominal)).cast("long").alias("batch_rows"))


def collate(batched: DataFrame, group: tuple[str, ...], fields: list[str]) -> DataFrame:
    """One row per batch with its columns stacked in slot order. Batches are bounded by their size."""
    packed = F.sort_array(F.collect_list(F.struct("slot", *fields)))
    return batched.groupBy(*group, "batch").agg(packed.alias("_rows")).select(
        *group, "batch", *[F.col(f"_rows.{name}").alias(name) for name in fields])


def stack_tensors(rows: DataFrame, batch_size: int, group: str | None = None, keep: tuple[str, ...] = ("sample_id",),
                  drop_last: bool = False) -> DataFrame:
    """Rows of (channels, height, width, values), as they arrive, to batches: one row with the batch's ``shape``, its tensors
    as one ``tensor`` and each column of ``keep`` as an array.

    Arrow batches have their own size; what a batch lacks at the end of one is carried into the next, so a task holds less
    than a batch and an Arrow batch. Batches count from 0 for each run of one ``group`` value (a worker's rows arrive in
    one task, in order) and end with it. Tensors of one batch have one shape.
    """
    values = rows.schema["values"]
    fields = [T.StructField("batch", T.LongType()), T.StructField("n_rows", T.IntegerType()),
              T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("tensor", values.dataType)]
    fields += [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in keep]
    schema = T.StructType(([rows.schema[group]] if group else []) + fields)
    read = list(dict.fromkeys([*([group] if group else []), *keep, "channels", "height", "width", "values"]))

    def stacked(batches):
        import pyarrow as pa

        held, n, run, number = [], 0, None, 0

        def whole():
            nonlocal held, n, number
            table = pa.Table.from_batches(held).combine_chunks()
            shape = [table.num_rows]
            for side in ("channels", "height", "width"):
                sides = table.column(side).unique().to_pylist()
                if len(sides) != 1:
                    raise ValueError(f"tensors of one batch differ in {side}: {sorted(sides)}")
                shape.append(sides[0])
            tensors = table.column("values").combine_chunks()
            tensors = tensors.chunk(0) if isinstance(tensors, pa.ChunkedArray) else tensors
            if pa.types.is_binary(tensors.type):
                tensor = pa.array([b"".join(t.as_buffer() for t in tensors)], pa.binary())
            else:
                flat = tensors.flatten()
                tensor = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), one(table.column(c).combine_chunks()))
                     for c in keep]
            columns = [table.column(group)[:1].combine_chunks()] if group else []
            columns = [one(c) for c in columns] + [pa.array([number], pa.int64()), pa.array([shape[0]], pa.int32()),
                                                   pa.array([shape], pa.list_(pa.int32())), tensor, *lists]
            held, n, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(batch.schema.get_field_index(group)).to_pylist() if group else [None] * batch.num_rows
            cuts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
            for a, b in zip(cuts, cuts[1:]):
                if runs[a] != run:
                    if n and not drop_last:
                        yield whole()
                    held, n, run, number = [], 0, runs[a], 0
                while a < b:
                    taken = min(b - a, batch_size - n)
                    held.append(batch.slice(a, taken))
                    a, n = a + taken, n + taken
                    if n == batch_size:
                        yield whole()
        if n and not drop_last:
            yield whole()

    return rows.select(*read).mapInArrow(stacked, schema)


def epochs(df: DataFrame, n_epochs: int, seed: int = 42, digits: int | None = None) -> DataFrame:
    """The table once per epoch, each in its own seeded order; buckets follow the rows of one epoch."""
    digits = digits or bucket_digits(df.count())
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(n_epochs))))
    return with_order(repeated, seed, F.col("epoch"), digits)


def virtual_epoch(placed: DataFrame, batch_size: int, total: Column) -> DataFrame:
    """Exactly ``total // batch_size + 1`` full batches: rows at the start of the order repeat to fill the end.

    ``placed`` has ``pos``; the extra rows are its first ones, so no row is shuffled to repeat it.
    """
    steps = whole_division(total, F.lit(batch_size)) + 1
    length = steps * batch_size
    # A position p is delivered at p, p + total, p + 2 total, ... below the length.
    copies = whole_division(length - 1 - F.col("pos"), total)
    return (placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
            .withColumn("epoch_pos", F.col("pos") + F.col("_copy") * total)
            .withColumn("batch", fixed_batch(F.col("epoch_pos"), batch_size))
            .withColumn("slot", F.pmod(F.col("epoch_pos"), F.lit(batch_size)).cast("long"))
            .drop("_copy"))


def with_total(df: DataFrame, source: DataFrame) -> DataFrame:
    """Add the row count of the table the rows come from as ``total``; a count reads no column."""
    return df.withColumn("total", source.agg(F.count(F.lit(1))).scalar())
