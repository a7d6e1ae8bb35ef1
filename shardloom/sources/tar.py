"""Tar shards: one member per column of a sample, named ``<key>.<column>``, plain USTAR, reproducible bytes."""

from __future__ import annotations

import tarfile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.types import StringType

from shardloom.sources import commits, shardlists
from shardloom.sources.shardfiles import INDEX, ShardReader, ShardSource, ShardWriter, digests, in_batches
from shardloom.sources.storage import replacing

BLOCK = 512
RECORD = 20 * BLOCK


def member_header(name: str, size: int) -> bytes:
    member = tarfile.TarInfo(name)
    member.size = size
    return member.tobuf(tarfile.USTAR_FORMAT)


SAMPLES = ".samples"  # the file beside a shard that lists its samples: key, begin, end, payload_bytes


class TarShard:
    def __init__(self, filesystem, path: str, parts: list[str], hashes: list[str], listed: bool = False):
        self.filesystem, self.path = filesystem, path
        self.listing: list[tuple] | None = [] if listed else None
        self.context = replacing(filesystem, path)
        self.stream = self.context.__enter__()
        self.parts = parts
        self.digests = digests(None, hashes)
        self.samples = self.payload = self.size = 0

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)
        for digest in self.digests.values():
            digest.update(data)

    def add(self, batch) -> None:
        columns = batch.to_pydict()
        for i, key in enumerate(columns["__key__"]):
            begin, before = self.size, self.payload
            for part in self.parts:
                value = columns[part][i]
                if value is None:
                    continue
                data = value.encode("utf-8") if isinstance(value, str) else value
                padding = -len(data) % BLOCK
                self.put(b"".join((member_header(f"{key}.{part}", len(data)), data, bytes(padding))))
                self.payload += len(data)
            if self.listing is not None and self.size > begin:
                self.listing.append((key, begin, self.size, self.payload - before))
        self.samples += batch.num_rows

    def finish(self) -> dict:
        # Two zero blocks end an archive; archives are padded to whole records.
        self.put(bytes(2 * BLOCK))
        self.put(bytes(-self.size % RECORD))
        self.context.__exit__(None, None, None)
        entry = {"samples": self.samples, "payload_bytes": self.payload, "bytes": self.size,
                 "hashes": {name: d.hexdigest() for name, d in self.digests.items()}}
        if self.listing is not None:
            write_listing(self.filesystem, self.path + SAMPLES, self.listing)
            entry["beside"] = [self.path.rsplit("/", 1)[-1] + SAMPLES]
        return entry

    def discard(self) -> None:
        error = RuntimeError("shard not finished")
        try:
            self.context.__exit__(RuntimeError, error, None)
        except (RuntimeError, ValueError):
            pass


def write_listing(filesystem, path: str, samples: list[tuple]) -> None:
    keys, *numbers = zip(*samples) if samples else ((), (), (), ())
    table = pa.table({"key": pa.array(keys, pa.string()), **{
        name: pa.array(values, pa.int64()) for name, values in zip(("begin", "end", "payload_bytes"), numbers)}})
    with replacing(filesystem, path) as stream:
        held = pa.BufferOutputStream()
        with pa.ipc.new_stream(held, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        stream.write(held.getvalue())


def read_listing(filesystem, path: str) -> pa.Table:
    """A shard's samples as its writer listed them: one request, whatever the shard's size."""
    with filesystem.open_input_stream(path, compression=None) as stream:
        return pa.ipc.open_stream(stream.read()).read_all()


class TarWriter(ShardWriter):
    def __init__(self, options, schema, overwrite):
        super().__init__(options, schema, overwrite)
        if "__key__" not in self.columns:
            raise ValueError("tar shards are written from a `__key__` column")
        self.parts = [c for c in self.columns if c != "__key__"]
        self.per_list = int(options["shards_per_list"]) if "shards_per_list" in options else None

    def file_name(self, shard: int) -> str:
        prefix, split = self.options.get("prefix", "dataset"), self.options.get("split", "train")
        return f"{prefix}-{split}-{shard:06d}.tar"

    def open_shard(self, filesystem, path):
        return TarShard(filesystem, path, self.parts, self.hashes, self.options.get("offsets", "") == "true")

    def index(self, entries):
        return {"format": "tar", "version": 1, "parts": self.parts, "shards": entries}

    def indexed(self, index):
        return index["shards"]


class WholeArchive(tarfile.TarInfo):
    """Members of an archive that must end with a zero block: a damaged header or a cut is an error, not the end."""

    @classmethod
    def fromtarfile(cls, archive):
        try:
            return super().fromtarfile(archive)
        except tarfile.EOFHeaderError:
            raise
        except tarfile.HeaderError as error:
            raise tarfile.ReadError(f"damaged or cut at byte {archive.offset}: {error}") from None


def samples_of(stream, whole: bool = True):
    """(key, {part: bytes}) of consecutive members that share a key; a key ends at the name's first dot. Part of an archive
    (not ``whole``) has no end to look for."""
    with tarfile.open(fileobj=stream, mode="r|", tarinfo=WholeArchive if whole else tarfile.TarInfo) as archive:
        key, parts = None, {}
        for member in archive:
            if not member.isfile():
                continue
            folder, _, name = member.name.rpartition("/")
            stem, _, part = name.partition(".")
            stem = f"{folder}/{stem}" if folder else stem
            if stem != key and key is not None:
                yield key, parts
                parts = {}
            key = stem
            content = archive.extractfile(member).read()
            if len(content) != member.size:
                raise tarfile.ReadError(f"{member.name}: {len(content)} of {member.size} bytes")
            parts[part] = content
        if key is not None:
            yield key, parts


class TarReader(ShardReader):
    def shard_lists(self, filesystem, base):
        index, job = commits.current(filesystem, base)
        return (index["lists"], job) if index is not None and "lists" in index else None

    def belongs(self, entry):
        split, prefix = self.options.get("split"), self.options.get("prefix", "")
        return not split or f"{prefix}-{split}-" in entry["file"]

    def list_shards(self, filesystem, base):
        def indexed(folder: str):
            index, job = commits.current(filesystem, folder)
            if index is None or index.get("format") != "tar":
                return None
            inner = folder[len(base):].lstrip("/")
            shards = shardlists.read_all(filesystem, folder, index["lists"], job) if "lists" in index else index["shards"]
            return [{"file": f"{inner}/{s['file']}" if inner else s["file"], "bytes": s["bytes"],
                     "samples": s["samples"], "job": job, "beside": s.get("beside", [])} for s in shards]

        found = indexed(base)
        if found is None:
            # A folder of tar sets, each with its index; or a foreign set without any, which is listed.
            infos = [i for i in filesystem.get_file_info(pafs.FileSelector(base, recursive=True))
                     if i.type == pafs.FileType.File and "/_" not in i.path[len(base):]
                     or i.base_name == commits.JOURNAL]
            folders = {i.path.rpartition("/")[0] for i in infos if i.base_name in (INDEX, commits.JOURNAL)}
            sets = [indexed(folder) for folder in sorted(folders)]
            found = [entry for entries in sets if entries for entry in entries] or [
                {"file": i.path[len(base):].lstrip("/"), "bytes": i.size} for i in infos if i.path.endswith(".tar")]
        return sorted(filter(self.belongs, found), key=lambda s: s["file"])

    def read_shard(self, filesystem, path, entry):
        fields = [f for f in self.schema.fields if f.name not in ("shard", "_corrupt")]

        def value(field, key, parts):
            if field.name == "__key__":
                return key
            content = parts.get(field.name)
            if content is not None and isinstance(field.dataType, StringType):
                return content.decode("utf-8")
            return content

        with filesystem.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
            rows = ((sum(map(len, parts.values())), tuple(value(f, key, parts) for f in fields))
                    for key, parts in samples_of(stream))
            yield from in_batches(rows, [f.name for f in fields])


class TarShards(ShardSource):
    """``tarshards``: options path, prefix, split, hashes, offsets (``true``: list each shard's samples beside it),
    shards_per_list (keep the index in lists of so many shard numbers); columns ``__key__`` and one per member ending."""

    writer_class, reader_class = TarWriter, TarReader

    @classmethod
    def name(cls):
        return "tarshards"

    def schema(self):
        return self.placed("shard string, __key__ string, jpg binary, txt binary")
