"""Log files line by line, in batch and while they grow.

A line belongs where its line feed lies, so files may be cut into tasks and micro-batches at any byte: a task looks back
for the start of its first line. A stream tells each line once, when its line feed is there. A batch read also tells a last
line that has none. The stream's offset holds the length of every file, an entry per log. A file that is shorter than what
was read of it is an error, as its lines can't be told apart from the old ones; a file that is gone is forgotten.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from shardloom.session import qualified
from shardloom.sources.shardfiles import in_batches, packed
from shardloom.sources.storage import locate

LINES = "file string, start long, line string"
BLOCK = 1 << 20
TASK_BYTES = 64 << 20
MANY_TASKS = 1000


def lengths(path: str) -> dict[str, int]:
    """Bytes of every file under a path, by its name below it; hidden files and folders are left out."""
    filesystem, base = locate(path)
    if filesystem.get_file_info(base).type == FileType.File:
        raise ValueError(f"{path} is not a folder")
    found = filesystem.get_file_info(FileSelector(base, recursive=True, allow_not_found=True))
    names = {f.path[len(base) + 1:]: f.size for f in found if f.type == FileType.File}
    return {name: names[name] for name in sorted(names) if not any(p.startswith((".", "_")) for p in name.split("/"))}


def line_start(source: pa.NativeFile, at: int, block: int = BLOCK) -> int:
    """The byte after the last line feed before ``at``."""
    while at > 0:
        low = max(0, at - block)
        found = source.read_at(at - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines_between(source: pa.NativeFile, low: int, high: int, tail: bool = False, block: int = BLOCK):
    """(first byte, line) of every line whose line feed lies in [low, high); with ``tail`` also of what follows the last."""
    at, start, held = low, None, []
    while at < high:
        data = source.read_at(min(block, high - at), at)
        if not data:
            raise EOFError(f"a log ends at byte {at} instead of {high}")
        if start is None and b"\n" in data:
            start = line_start(source, low, block)
            held = [source.read_at(at - start, start)]
        at += len(data)
        if start is None:
            continue
        held.append(data)
        if b"\n" in data:
            *whole, rest = b"".join(held).split(b"\n")
            for line in whole:
                yield start, line
                start += len(line) + 1
            held = [rest]
    if tail:
        start = line_start(source, high, block) if start is None else start
        if start < high:
            yield start, source.read_at(high - start, start)


@dataclass
class Portions(InputPartition):
    portions: list[dict]

    def __init__(self, portions):
        self.portions = portions


class _Lines:
    """Files are cut at every ``bytes_per_task`` bytes. A task has one such cut's bytes at most, or, where that would make more than
    ``MANY_TASKS``, several cuts up to ``TASK_BYTES``; each cut is read by itself all the same."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes_per_task = int(options.get("bytes_per_task", TASK_BYTES))

    def cut(self, begin: dict[str, int], end: dict[str, int], tail: bool) -> list[Portions]:
        """Tasks for what files have gained."""
        gained = {name: (begin.get(name, 0), size) for name, size in end.items()}
        for name, (first, size) in gained.items():
            if size < first:
                raise ValueError(f"{name} has {size} bytes, but {first} were read")
        even = sum(size - first for first, size in gained.values()) // MANY_TASKS
        target = max(self.bytes_per_task, min(even, TASK_BYTES) // self.bytes_per_task * self.bytes_per_task)
        found = []
        for name, (first, size) in gained.items():
            for low in range(first, size, target):
                high = min(size, low + target)
                found.append({"file": name, "low": low, "high": high, "bytes": high - low, "tail": tail and high == size})
        return [Portions(run) for run in packed(found, target)] or [Portions([])]

    def read(self, partition):
        filesystem, base = locate(self.path)

        def rows():
            for p in partition.portions:
                with filesystem.open_input_file(f"{base}/{p['file']}") as source:
                    for low in range(p["low"], p["high"], self.bytes_per_task):
                        high = min(p["high"], low + self.bytes_per_task)
                        for start, line in lines_between(source, low, high, p["tail"] and high == p["high"]):
                            yield len(line) + 64, (p["file"], start, line.decode("utf-8", "replace"))

        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("line", pa.string())])
        for columns in in_batches(rows(), schema.names, 10_000):
            yield pa.RecordBatch.from_pydict(columns, schema=schema)


class LogReader(_Lines, DataSourceReader):
    def partitions(self):
        return self.cut({}, lengths(self.path), tail=True)


class LogStream(_Lines, DataSourceStreamReader):
    def initialOffset(self):
        return {}

    def latestOffset(self):
        return lengths(self.path)

    def partitions(self, start, end):
        return self.cut(start, end, tail=False)

    def commit(self, end):
        pass


class LogLines(DataSource):
    """Format ``loglines``: file, first byte and text of every line under a folder."""

    @classmethod
    def name(cls):
        return "loglines"

    def schema(self):
        return LINES

    def reader(self, schema):
        return LogReader(self.options)

    def streamReader(self, schema):
        return LogStream(self.options)


def log_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(LogLines)
    return spark.read.format("loglines").options(**options).load(qualified(spark, path))


def growing_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The lines as a stream: what is there, then what is appended or added."""
    spark.dataSource.register(LogLines)
    return spark.readStream.format("loglines").options(**options).load(qualified(spark, path))
