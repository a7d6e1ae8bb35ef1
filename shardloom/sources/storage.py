"""Files on whatever storage the path names (local mount, hdfs, s3, gs), through pyarrow.fs."""

from __future__ import annotations

import io
import json
import re
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    # Hadoop's names for the same store.
    path = re.sub("^s3[an]://", "s3://", path)
    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem, inner.rstrip("/")


def is_object_store(filesystem: pafs.FileSystem) -> bool:
    return filesystem.type_name not in ("local", "hdfs")


@contextmanager
def replacing(filesystem: pafs.FileSystem, path: str):
    """Write a file that appears whole or not at all.

    An object store publishes what it got when a stream closes, even after an error, so there the content (a
    shard, of bounded size) is held until it is complete. Elsewhere it goes to a name of its own and is moved.
    """
    if is_object_store(filesystem):
        held = io.BytesIO()
        yield held
        with filesystem.open_output_stream(path, compression=None) as stream:
            stream.write(held.getbuffer())
        return
    partial = f"{path}.{uuid.uuid4().hex}.part"
    stream = filesystem.open_output_stream(partial, compression=None)
    try:
        yield stream
        stream.close()
    except BaseException:
        stream.close()
        filesystem.delete_file(partial)
        raise
    if filesystem.type_name == "hdfs" and filesystem.get_file_info(path).type == pafs.FileType.File:
        # Its rename does not replace; what is there is an earlier attempt's identical file.
        filesystem.delete_file(path)
    filesystem.move(partial, path)


def write_json(filesystem: pafs.FileSystem, path: str, content: dict, indent: int | None = 1) -> None:
    with replacing(filesystem, path) as stream:
        stream.write(json.dumps(content, sort_keys=True, indent=indent).encode())


class ForwardReader(io.RawIOBase):
    """A file that is read forwards with gaps, in blocks: what lies between two reads of one block costs no request, and a
    gap beyond the block is skipped without being read."""

    def __init__(self, source: pa.NativeFile, block: int = 1 << 18):
        super().__init__()
        self.source, self.block, self.length = source, block, source.size()
        self.at = self.first = self.requests = 0
        self.held = b""

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + (0, self.at, self.length)[whence]
        return self.at

    def read(self, size: int = -1) -> bytes:
        end = self.length if size is None or size < 0 else min(self.at + size, self.length)
        if self.at >= end:
            return b""
        if not self.first <= self.at <= end <= self.first + len(self.held):
            self.requests += 1
            self.first, self.held = self.at, self.source.read_at(max(self.block, end - self.at), self.at)
        data = bytes(self.held[self.at - self.first:end - self.first])
        self.at += len(data)
        return data


def read_json(filesystem: pafs.FileSystem, path: str) -> dict | None:
    if filesystem.get_file_info(path).type != pafs.FileType.File:
        return None
    with filesystem.open_input_stream(path, compression=None) as stream:
        return json.loads(stream.read())
