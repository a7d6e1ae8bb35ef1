"""What the operators of this package share: inputs, staged tables, worker state and text helpers."""

from __future__ import annotations

import gc
import math
import os
import sys
import types
import weakref
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shardloom.session import fresh_dir, remove

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# White space of the contracts, as the body of a character class.
ASCII_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator takes, under fixed names; a null text is empty. Other columns go, so none
    can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back: later passes neither repeat the work nor depend on
    the executors that did it."""
    path = fresh_dir(df.sparkSession, label)
    write_out(df, path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    for made in _made[-1:]:
        made.append(table)
    _folders[id(table)] = (weakref.ref(table, lambda _, key=id(table): _folders.pop(key, None)), path)
    return table


_folders: dict[int, tuple] = {}  # of staged tables that are still referred to
_made: list[list[DataFrame]] = []


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        _, path = _folders.pop(id(table), (None, None))
        if path is not None:
            remove(table.sparkSession, path)


def staged_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The staged table that ``make`` returns. Other tables that it stages are deleted, as all of them were for this one."""
    _made.append([])
    try:
        table = make()
    finally:
        made = _made.pop()
    discard(*(t for t in made if t is not table))
    for outer in _made[-1:]:
        outer.append(table)
    return table


def write_out(df: DataFrame, path: str) -> None:
    """Write rows as Parquet. The write's own shuffle files go when it ends, not when the driver next collects garbage;
    its tasks pass rows to Python in batches of a few megabytes, which both sides hold."""
    conf = df.sparkSession.conf
    held = {FREE_SHUFFLES: "true", BATCH_BYTES: "3m"}
    before = {key: conf.get(key) for key in held}
    try:
        for key, value in held.items():
            conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            conf.set(key, value)


def crc_of_id(column="doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0


def range_bounds(rows: DataFrame, column: str, parts: int) -> list[int]:
    """Values at which ranges begin, but for the first: quantiles over all rows, a number per range."""
    if parts < 2:
        return []
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = rows.agg(F.percentile_approx(column, shares, F.lit(max(10_000, 20 * parts))).alias("q")).first().q
    return sorted(set(found or []))


def range_of(column: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the value, by a coarse and a fine step."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    upto = lambda values: F.size(F.filter(values, lambda b: b <= column))
    block = upto(F.lit(bounds[::step])) - F.lit(1)
    fine = block * F.lit(step) + upto(F.slice(F.lit(bounds), block * F.lit(step) + F.lit(1), F.lit(step)))
    return F.when(column < F.lit(bounds[0]), F.lit(0)).otherwise(fine)


def worker_state(name: str, make):
    """A value that lives as long as the Python worker: loaded vocabularies and memos that tasks share."""
    holder = sys.modules.get("_worker_state")
    if holder is None:
        holder = sys.modules["_worker_state"] = types.ModuleType("_worker_state")
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def drop_worker_state() -> None:
    """For operators that keep nothing in the worker: what others keep there goes, so it is not held beside their own rows."""
    if sys.modules.pop("_worker_state", None) is not None:
        give_back()


def give_back() -> None:
    """What Arrow has freed goes back to the system, not into a store of this process."""
    pa.default_memory_pool().release_unused()


@contextmanager
def without_cycles():
    """No search for reference cycles meanwhile: code that makes many lists and no cycles spends a third of its time on it."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def single_threaded() -> None:
    """One thread per task: Spark runs the tasks in parallel."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def arrow_schema(ddl: str) -> pa.Schema:
    """An Arrow schema for a DDL string of simple types and arrays of them."""
    simple = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
              "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
              "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()),
              "array<double>": pa.list_(pa.float64())}
    fields = [part.strip().split(" ", 1) for part in ddl.split(",")]
    return pa.schema([(name, simple[kind.strip()]) for name, kind in fields])


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, field.type) for c, field in zip(columns, schema)], schema=schema)


def text_steps(rows: pa.RecordBatch, limit: int):
    """Slices of a batch of some ``limit`` bytes of text."""
    if not rows.num_rows:
        return
    sizes = np.cumsum(pc.binary_length(rows.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    cuts = np.unique(np.searchsorted(sizes, np.arange(limit, sizes[-1] + limit, limit), side="left") + 1)
    at = 0
    for cut in np.minimum(cuts, rows.num_rows).tolist():
        if cut > at:
            yield rows.slice(at, cut - at)
            at = cut


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of values."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


class Grown:
    """An array that is appended to."""

    def __init__(self, kind=np.int64):
        self.held, self.n = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(need, 2 * len(self.held)) - len(self.held), self.held.dtype)])
        self.held[self.n:need] = values
        self.n = need

    @property
    def view(self) -> np.ndarray:
        return self.held[:self.n]
