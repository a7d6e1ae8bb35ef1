"""Token ids as flat binary files: unsigned integers, 64-bit document offsets, memory-mapped reads.

A part is two files. ``part-N.bin`` holds the ids of its documents one after another, as unsigned 16-bit integers when
the vocabulary allows it and 32-bit ones otherwise. ``part-N.idx`` holds the magic ``TOKIDX1\\0``, the bytes per id and
the number of documents (64-bit), then the offsets (documents + 1), the ids of the documents and a byte each that tells
whether the id is null. Parts are ranges of the document id; a part's base, the ids in all the parts before it, is a
prefix sum over the part totals in the manifest and is not stored in the part, so parts are written independently.

Parts appear whole, by rename, and a retried task writes the same bytes, so a lost executor costs only its own parts.
Null texts are empty and get the end id alone. Null document ids come first. Rows that share an id are ordered by their
ids of tokens; equal rows are all kept. An empty table gives a manifest of no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shardloom.llm.chunk_encoder import STEP_BYTES, ChunkEncoder
from shardloom.llm.common import arrow_schema, batch, give_back, id_and_text, range_bounds, text_bytes, text_steps, write_out
from shardloom.sources.storage import locate, replacing

MAGIC = b"TOKIDX1\0"
FILE_BYTES = 24 << 20  # text behind one part
READ_TASKS = 100_000  # tasks that read parts; beyond, a task reads several, one after another
ENCODED = "part int, doc_id long, ids binary"
MANIFEST = "part int, docs long, tokens long, width int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _encoder(tokenizer: str, end_id: int | None, bounds: np.ndarray, width: int):
    schema = arrow_schema(ENCODED)

    def run(batches):
        encoder = ChunkEncoder.of_worker(tokenizer)
        for rows in batches:
            for step in text_steps(rows, STEP_BYTES):
                ids = step.column("doc_id")
                keys = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                part = np.searchsorted(bounds, keys, side="right").astype(np.int32)
                yield batch(schema, [part, ids, encoder.encode_array(step.column("text"), end_id, width)[0]])
            give_back()
    return run


def _writer(path: str, width: int):
    schema = arrow_schema(MANIFEST)

    def save(part, counts, ids, chunks):
        filesystem, root = locate(path)
        filesystem.create_dir(root, recursive=True)
        with replacing(filesystem, f"{root}/part-{part:06d}.bin") as stream:
            for chunk in chunks:
                stream.write(chunk)
        sizes = np.concatenate(counts) // width
        keys = pa.chunked_array(ids).combine_chunks()
        nulls = keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        with replacing(filesystem, f"{root}/part-{part:06d}.idx") as stream:
            stream.write(MAGIC + np.array([width, len(sizes)], dtype="<i8").tobytes())
            stream.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes())
            stream.write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + nulls.tobytes())
        return part, len(sizes), int(sizes.sum()), width

    def run(batches):
        part, counts, ids, chunks, out = None, [], [], [], []
        for rows in batches:
            parts = rows.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if part is not None and parts[a] != part:
                    out.append(save(part, counts, ids, chunks))
                    counts, ids, chunks = [], [], []
                part = int(parts[a])
                coded = rows.column("ids")[a:b]
                counts.append(np.array([len(c.as_buffer()) for c in coded], dtype=np.int64))
                ids.append(rows.column("doc_id")[a:b])
                chunks.append(b"".join(c.as_buffer() for c in coded))
        if part is not None:
            out.append(save(part, counts, ids, chunks))
        yield batch(schema, [list(c) for c in zip(*out)] if out else [[]] * len(schema))
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id",
                      text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text, append ``end_id`` and write the parts under ``path`` in ascending order of the id.

    A part is one task's: its ids, a quarter of the text behind it, are held until they are written.
    """
    docs = id_and_text(docs, id_col, text_col)
    bounds = np.array(range_bounds(docs, "doc_id", -(-text_bytes(docs) // file_bytes)), dtype=np.int64)
    width = 4 if ChunkEncoder(tokenizer).wide else 2
    coded = docs.mapInArrow(_encoder(tokenizer, end_id, bounds, width), ENCODED)
    dealt = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    write_out(dealt.mapInArrow(_writer(path, width), MANIFEST), f"{path}/manifest")


def open_part(path: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets, document ids and their null marks of a part; mapped where the files are local."""
    filesystem, root = locate(path)
    names = [f"{root}/part-{part:06d}.{kind}" for kind in ("bin", "idx")]
    if isinstance(filesystem, pafs.LocalFileSystem):
        # numpy can't map an empty file.
        raw, index = (np.memmap(n, dtype=np.uint8, mode="r") if filesystem.get_file_info(n).size
                      else np.zeros(0, np.uint8) for n in names)
    else:
        raw, index = (np.frombuffer(filesystem.open_input_file(n).read(), np.uint8) for n in names)
    if bytes(index[:8]) != MAGIC:
        raise ValueError(f"{names[1]} is no token index")
    width, docs = (int(x) for x in index[8:24].view("<i8"))
    offsets = index[24:24 + 8 * (docs + 1)].view("<i8")
    rest = index[24 + 8 * (docs + 1):]
    if len(rest) != 9 * docs or int(offsets[-1]) * width != len(raw):
        raise ValueError(f"{names[0]} and its index do not agree")
    return raw.view(f"<u{width}"), offsets, rest[:8 * docs].view("<i8"), rest[8 * docs:]


def _reader(path: str):
    schema = arrow_schema(READ)

    def run(batches):
        for rows in batches:
            for part, base in zip(rows.column("part").to_pylist(), rows.column("base").to_pylist()):
                ids, offsets, keys, nulls = open_part(path, part)
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(offsets[:-1], offsets[1:])]
                yield batch(schema, [pa.array(np.asarray(keys), pa.int64(), mask=np.asarray(nulls, dtype=bool)),
                                     np.asarray(offsets[:-1]) + base, np.diff(offsets), crc])
    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per document, read from the files: its place in the whole stream, its tokens and their checksum."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # One row a part: the running sum over them is the only ordering that no key divides.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    # By number, not by hash and not to be joined: as many tasks as parts, however small their rows here.
    tasks = max(1, min(manifest.count(), READ_TASKS))
    dealt = based.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int"))
    return dealt.mapInArrow(_reader(path), READ)
