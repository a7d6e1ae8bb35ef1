"""Concatenate and cut: token streams of all documents in fixed windows.

Pass one encodes and stages each document with its place within the task's own stream. A prefix sum over the totals of
the tasks gives every task its global offset. Pass two cuts the global stream at multiples of the window: a document
becomes a boundary record per window that it touches. No token moves between tasks, and only the last window of the
whole stream is short, so all the padding there is is less than one window.

The order of the stream is that of the staged table, which is written once; nothing depends on how rows arrive later.
Null texts are empty and are the end id alone (without an end id they have no pieces). Null document ids are kept.
Repeated rows are documents of their own. An empty table has no pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from shardloom.llm.chunk_encoder import STEP_BYTES, ChunkEncoder
from shardloom.llm.common import arrow_schema, batch, give_back, id_and_text, staged, text_steps

WINDOW = 4096
STREAM = "part int, doc_id long, local_start long, doc_tokens long, ids binary"
BASES_BROADCAST = 1_000_000  # parts whose bases (16 bytes each) are broadcast; beyond, a join by part


def _encoder(tokenizer: str, end_id: int | None):
    schema = arrow_schema(STREAM)

    def run(batches):
        encoder, part, at = ChunkEncoder.of_worker(tokenizer), TaskContext.get().partitionId(), 0
        for rows in batches:
            for step in text_steps(rows, STEP_BYTES):
                ids, sizes = encoder.encode_array(step.column("text"), end_id)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield batch(schema, [np.full(len(ids), part, np.int32), step.column("doc_id"), starts, sizes, ids])
            give_back()
    return run


def token_stream(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """A row per document with its ids and its ``start`` in the global stream."""
    stream = staged(id_and_text(docs, id_col, text_col).mapInArrow(_encoder(tokenizer, end_id), STREAM), "stream")
    totals = staged(stream.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")), "totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    if totals.count() <= BASES_BROADCAST:
        bases = F.broadcast(bases)
    return stream.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "doc_tokens", "ids")


def pack(stream: DataFrame, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """A boundary record per piece: doc_id, start (in its document), length, ids_crc32, doc_tokens, sequence_id,
    offset; with ``keep_ids`` also the ids, little-endian unsigned 32-bit integers."""
    size = F.lit(window).cast("long")
    first, end = F.col("start"), F.col("start") + F.col("doc_tokens")

    def piece(sequence):
        a = F.greatest(sequence * size, first)
        b = F.least((sequence + F.lit(1)) * size, end)
        ids = F.substring(F.col("ids"), ((a - first) * 4 + 1).cast("int"), ((b - a) * 4).cast("int"))
        fields = [(a - first).alias("start"), (b - a).alias("length"), F.crc32(ids).alias("ids_crc32"),
                  sequence.alias("sequence_id"), (a - sequence * size).alias("offset")]
        return F.struct(*fields, *([ids.alias("ids")] if keep_ids else []))

    windows = F.sequence(F.expr(f"start div {window}"), F.expr(f"(start + doc_tokens - 1) div {window}"))
    pieces = stream.filter("doc_tokens > 0").select(
        "doc_id", "doc_tokens", F.explode(F.transform(windows, piece)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset",
                         *(["p.ids"] if keep_ids else []))
