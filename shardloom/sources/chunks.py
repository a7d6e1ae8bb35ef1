"""Chunk shards: length-prefixed items behind an offset table, compressed as a whole, one ``index.json``."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, functions as F

from shardloom.functions.payload import payload_size
from shardloom.sources import commits
from shardloom.sources.mds import CODECS, compressed, decompressed
from shardloom.sources.shardfiles import INDEX, ShardReader, ShardSource, ShardWriter, digests, in_batches
from shardloom.sources.storage import locate, replacing

# Item leaf formats by Spark type.
FORMATS = {"binary": "bytes", "string": "str", "bigint": "int", "double": "float"}
NULL = 0xFFFFFFFF


def item_size(*leaves: Column | str) -> Column:
    """Bytes an item takes in its chunk: a length per leaf, then the leaves."""
    return payload_size(*leaves) + F.lit(4 * len(leaves))


def pack(value, form: str) -> bytes:
    if form == "int":
        return struct.pack("<q", value)
    if form == "float":
        return struct.pack("<d", value)
    return value.encode("utf-8") if form == "str" else bytes(value)


def unpack(data: bytes, form: str):
    if form == "int":
        return struct.unpack("<q", data)[0]
    if form == "float":
        return struct.unpack("<d", data)[0]
    return data.decode("utf-8") if form == "str" else data


class Chunk:
    def __init__(self, filesystem, path: str, names: list[str], forms: list[str], codec: str | None, hashes):
        self.filesystem, self.path, self.names, self.forms = filesystem, path, names, forms
        self.codec, self.hashes = codec, hashes
        self.items: list[bytes] = []

    def add(self, batch) -> None:
        columns = batch.to_pydict()
        for i in range(batch.num_rows):
            lengths, leaves = [], []
            for name, form in zip(self.names, self.forms):
                value = columns[name][i]
                leaf = b"" if value is None else pack(value, form)
                lengths.append(struct.pack("<I", NULL if value is None else len(leaf)))
                leaves.append(leaf)
            self.items.append(b"".join(lengths + leaves))

    def finish(self) -> dict:
        n = len(self.items)
        ends = np.cumsum([0] + [len(i) for i in self.items]) + 4 + 4 * (n + 1)
        if ends[-1] > 0xFFFFFFFF:
            raise ValueError(f"{self.path}: offsets pass 32 bits; lower the chunk size")
        raw = b"".join([struct.pack("<I", n), ends.astype("<u4").tobytes(), *self.items])
        stored = compressed(raw, self.codec) if self.codec else raw
        with replacing(self.filesystem, self.path) as stream:
            stream.write(stored)
        return {"samples": n, "raw_bytes": len(raw), "bytes": len(stored),
                "hashes": {k: d.hexdigest() for k, d in digests(stored, self.hashes).items()}}

    def discard(self) -> None:
        self.items = []


class ChunkWriter(ShardWriter):
    """The shard number packs (writer, chunk of that writer); see ``chunk_number``."""

    def __init__(self, options, schema, overwrite):
        super().__init__(options, schema, overwrite)
        self.forms = [FORMATS[schema[c].dataType.simpleString()] for c in self.columns]
        self.codec = options.get("compression", "zstd") or None
        if self.codec is not None and self.codec not in CODECS:
            raise ValueError(f"unknown compression {self.codec!r}")

    def file_name(self, shard):
        ending = f".{self.codec}.bin" if self.codec else ".bin"
        return f"chunk-{shard >> 32}-{shard & 0xFFFFFFFF}{ending}"

    def open_shard(self, filesystem, path):
        return Chunk(filesystem, path, self.columns, self.forms, self.codec, self.hashes)

    def index(self, entries):
        chunks = [{"chunk_bytes": e["raw_bytes"], "chunk_size": e["samples"], "dim": None, "filename": e["file"],
                   "stored_bytes": e["bytes"], "hashes": e["hashes"]} for e in entries]
        config = {"compression": self.codec, "data_format": self.forms, "names": self.columns,
                  "chunk_bytes": self.options.get("chunk_bytes"), "chunk_size": self.options.get("chunk_size")}
        return {"chunks": chunks, "config": config}

    def indexed(self, index):
        return [{"file": c["filename"], "raw_bytes": c["chunk_bytes"], "samples": c["chunk_size"], "shard": n,
                 "bytes": c["stored_bytes"], "hashes": c["hashes"]} for n, c in enumerate(index["chunks"])]


def chunk_number(writer: Column, chunk: Column) -> Column:
    return F.shiftleft(writer.cast("long"), 32) + chunk.cast("long")


def read_items(data: bytes, forms: list[str]):
    n = struct.unpack_from("<I", data)[0]
    offsets = np.frombuffer(data, "<u4", n + 1, 4)
    if offsets[-1] != len(data):
        raise ValueError(f"chunk holds {len(data)} of {offsets[-1]} bytes")
    for i in range(n):
        lengths = struct.unpack_from(f"<{len(forms)}I", data, int(offsets[i]))
        at, leaves = int(offsets[i]) + 4 * len(forms), []
        for form, length in zip(forms, lengths):
            if length == NULL:
                leaves.append(None)
                continue
            leaves.append(unpack(data[at:at + length], form))
            at += length
        yield leaves


class ChunkReader(ShardReader):
    def list_shards(self, filesystem, base):
        index, job = commits.current(filesystem, base)
        if index is None:
            raise FileNotFoundError(f"{base}/{INDEX}")
        return [{"file": c["filename"], "bytes": c["chunk_bytes"], "samples": c["chunk_size"],
                 "config": index["config"], "job": job} for c in index["chunks"]]

    def read_shard(self, filesystem, path, entry):
        config = entry["config"]
        with filesystem.open_input_stream(path, compression=None) as stream:
            data = stream.read()
        if config["compression"]:
            data = decompressed(data, config["compression"])
        wanted = [f.name for f in self.schema.fields if f.name in config["names"]]
        places = [config["names"].index(n) for n in wanted]
        rows = ((sum(len(v) for v in leaves if isinstance(v, (bytes, str))), tuple(leaves[p] for p in places))
                for leaves in read_items(data, config["data_format"]))
        yield from in_batches(rows, wanted)


class Chunks(ShardSource):
    """``chunks``: options path, compression (zstd unless empty), chunk_bytes, chunk_size, hashes."""

    writer_class, reader_class = ChunkWriter, ChunkReader

    @classmethod
    def name(cls):
        return "chunks"

    def schema(self):
        filesystem, base = locate(self.options["path"])
        index, _ = commits.current(filesystem, base)
        if index is None:
            return self.placed("shard string, image_bytes binary, text string")
        types = {form: t for t, form in FORMATS.items()}
        columns = ", ".join(f"`{n}` {types[f]}" for n, f in zip(index["config"]["names"], index["config"]["data_format"]))
        return self.placed(f"shard string, {columns}")
