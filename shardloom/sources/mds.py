"""MDS shards: a table of sample offsets, a JSON header and the samples, described by one ``index.json``."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import Column, functions as F

from shardloom.functions.payload import ENCODINGS, payload_size
from shardloom.sources import commits
from shardloom.sources.shardfiles import INDEX, ShardReader, ShardSource, ShardWriter, digests, in_batches
from shardloom.sources.storage import locate, replacing

# Bytes of the encodings that are stored without a length.
FIXED_SIZES = {"int": 8, "float64": 8}
# Bytes per offset entry, and the codecs with the ending their files take.
OFFSET_BYTES = 4
CODECS = {"zstd": "zstd", "gz": "gzip", "lz4": "lz4"}


def header_of(encodings: dict[str, str], size_limit: int, compression: str | None, hashes: list[str]) -> dict:
    names = sorted(encodings)
    return {"version": 2, "format": "mds", "compression": compression, "hashes": hashes,
            "size_limit": size_limit, "column_names": names,
            "column_encodings": [encodings[n] for n in names],
            "column_sizes": [FIXED_SIZES.get(encodings[n]) for n in names]}


def stored_size(columns: dict[str, Column], encodings: dict[str, str]) -> Column:
    """Bytes a sample takes in its shard, offset entry included."""
    total = F.lit(OFFSET_BYTES).cast("long")
    for name, encoding in encodings.items():
        if encoding in FIXED_SIZES:
            total = total + FIXED_SIZES[encoding]
        else:
            total = total + 4 + payload_size(columns[name])
    return total


def shard_overhead(header: dict) -> int:
    """Bytes of a shard without samples."""
    return 4 + OFFSET_BYTES + len(json.dumps(header, sort_keys=True).encode())


def encode_value(value, encoding: str) -> bytes:
    if encoding == "int":
        return struct.pack("<q", value)
    if encoding == "float64":
        return struct.pack("<d", value)
    return value.encode("utf-8") if encoding == "str" else bytes(value)


def decode_value(data: bytes, encoding: str):
    if encoding == "int":
        return struct.unpack("<q", data)[0]
    if encoding == "float64":
        return struct.unpack("<d", data)[0]
    return data.decode("utf-8") if encoding == "str" else data


def compressed(data: bytes, codec: str) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, CODECS[codec]) as stream:
        stream.write(data)
    return sink.getvalue().to_pybytes()


def decompressed(data: bytes, codec: str) -> bytes:
    import pyarrow as pa

    try:
        with pa.CompressedInputStream(pa.BufferReader(data), CODECS[codec]) as stream:
            return stream.read()
    except OSError as error:
        # The bytes are here, so this is no fault of the storage.
        raise ValueError(f"damaged {codec} stream: {error}") from None


class MdsShard:
    """Holds one shard, whose bytes the assignment bounds, because offsets precede the samples."""

    def __init__(self, filesystem, path: str, header: dict):
        self.filesystem, self.path, self.header = filesystem, path, header
        self.samples: list[bytes] = []

    def add(self, batch) -> None:
        columns = batch.to_pydict()
        layout = list(zip(self.header["column_names"], self.header["column_encodings"], self.header["column_sizes"]))
        for i in range(batch.num_rows):
            sizes, values = [], []
            for name, encoding, fixed in layout:
                value = columns[name][i]
                if value is None:
                    raise ValueError(f"column {name!r} is null; reject such rows before writing")
                data = encode_value(value, encoding)
                if fixed is None:
                    sizes.append(struct.pack("<I", len(data)))
                values.append(data)
            self.samples.append(b"".join(sizes + values))

    def finish(self) -> dict:
        config = json.dumps(self.header, sort_keys=True).encode()
        n = len(self.samples)
        ends = np.cumsum([0] + [len(s) for s in self.samples]) + 4 + OFFSET_BYTES * (n + 1) + len(config)
        if ends[-1] > 0xFFFFFFFF:
            raise ValueError(f"{self.path}: offsets pass 32 bits; lower the size limit")
        raw = b"".join([struct.pack("<I", n), ends.astype("<u4").tobytes(), config, *self.samples])
        hashes, codec = self.header["hashes"], self.header["compression"]
        name = self.path.rsplit("/", 1)[-1]
        raw_name = name.removesuffix(f".{codec}") if codec else name

        def described(basename, data):
            return {"basename": basename, "bytes": len(data),
                    "hashes": {k: d.hexdigest() for k, d in digests(data, hashes).items()}}

        stored, zip_data = raw, None
        if codec:
            stored = compressed(raw, codec)
            zip_data = described(name, stored)
        with replacing(self.filesystem, self.path) as stream:
            stream.write(stored)
        return {"samples": n, "bytes": len(stored), "raw_data": described(raw_name, raw), "zip_data": zip_data}

    def discard(self) -> None:
        self.samples = []


class MdsWriter(ShardWriter):
    def __init__(self, options, schema, overwrite):
        super().__init__(options, schema, overwrite)
        encodings = json.loads(options["columns"]) if "columns" in options else {
            f.name: {"binary": "bytes", "string": "str", "bigint": "int", "double": "float64"}[f.dataType.simpleString()]
            for f in schema.fields if f.name != "shard"}
        for name, encoding in encodings.items():
            if name not in schema.names or schema[name].dataType.simpleString() != ENCODINGS.get(encoding):
                raise ValueError(f"column {name!r} cannot be stored as {encoding!r}")
        codec = options.get("compression") or None
        if codec is not None and codec not in CODECS:
            raise ValueError(f"unknown compression {codec!r}")
        self.header = header_of(encodings, int(options.get("size_limit", 1 << 26)), codec, self.hashes)

    def file_name(self, shard):
        codec = self.header["compression"]
        return f"shard.{shard:05d}.mds" + (f".{codec}" if codec else "")

    def open_shard(self, filesystem, path):
        return MdsShard(filesystem, path, self.header)

    def index(self, entries):
        shards = [{**self.header, "samples": e["samples"], "raw_data": e["raw_data"], "zip_data": e["zip_data"]}
                  for e in entries]
        return {"version": 2, "shards": shards}

    def indexed(self, index):
        return [{"file": (s["zip_data"] or s["raw_data"])["basename"], "shard": n, "samples": s["samples"],
                 "raw_data": s["raw_data"], "zip_data": s["zip_data"]} for n, s in enumerate(index["shards"])]


def read_samples(data: bytes, header: dict):
    """Tuples of column values out of a raw shard, in header order."""
    n = struct.unpack_from("<I", data)[0]
    offsets = np.frombuffer(data, "<u4", n + 1, 4)
    if offsets[-1] != len(data):
        raise ValueError(f"shard holds {len(data)} of {offsets[-1]} bytes")
    encodings, fixed = header["column_encodings"], header["column_sizes"]
    for i in range(n):
        at = int(offsets[i])
        sizes = []
        for size in fixed:
            if size is None:
                size = struct.unpack_from("<I", data, at)[0]
                at += 4
            sizes.append(size)
        row = []
        for encoding, size in zip(encodings, sizes):
            row.append(decode_value(data[at:at + size], encoding))
            at += size
        yield row


class MdsReader(ShardReader):
    def list_shards(self, filesystem, base):
        index, job = commits.current(filesystem, base)
        if index is None:
            raise FileNotFoundError(f"{base}/{INDEX}")
        return [{"file": (s["zip_data"] or s["raw_data"])["basename"], "bytes": s["raw_data"]["bytes"],
                 "samples": s["samples"], "header": s, "job": job}
                for s in index["shards"]]

    def read_shard(self, filesystem, path, entry):
        header = entry["header"]
        with filesystem.open_input_stream(path, compression=None) as stream:
            data = stream.read()
        if header["compression"]:
            data = decompressed(data, header["compression"])
        wanted = [f.name for f in self.schema.fields if f.name in header["column_names"]]
        places = [header["column_names"].index(n) for n in wanted]
        rows = ((sum(len(v) for v in row if isinstance(v, (bytes, str))), tuple(row[p] for p in places))
                for row in read_samples(data, header))
        yield from in_batches(rows, wanted)


class Mds(ShardSource):
    """``mds``: options path, columns (JSON of encodings), size_limit, compression, hashes."""

    writer_class, reader_class = MdsWriter, MdsReader

    @classmethod
    def name(cls):
        return "mds"

    def schema(self):
        filesystem, base = locate(self.options["path"])
        index, _ = commits.current(filesystem, base)
        if index is None or not index["shards"]:
            return self.placed("shard string, image binary, text string, idx bigint")
        header = index["shards"][0]
        columns = ", ".join(f"`{n}` {ENCODINGS[e]}" for n, e in zip(header["column_names"], header["column_encodings"]))
        return self.placed(f"shard string, {columns}")
