"""What the shard formats share: a writer that turns shard-ordered rows into files, and a reader that turns
files into Arrow batches.

Rows must arrive clustered and sorted by ``shard`` (see ``plans.prepare.cluster_by_shard``). A shard's bytes
depend on its rows alone, and a file appears whole, so a retried or speculative task replaces a file with an
identical one. Files are written in a folder of the job and join the set on commit, with the entries that the
successful tasks report (``sources.commits``); files without an index are not a dataset.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from shardloom.sources import commits, shardlists
from shardloom.sources.commits import INDEX  # noqa: F401 - formats take it from here
from shardloom.sources.storage import locate, write_json

# What bytes that are not of their format raise. Storage raises OSError, which fails the task in every mode, so that Spark
# tries it again: a lost connection, a refused credential or a missing file is no damage.
DAMAGE = (ValueError, LookupError, EOFError, struct.error, zlib.error, tarfile.TarError)


def digests(content_or_none: bytes | None, algorithms: list[str]):
    """Running digests by name."""
    running = {}
    for name in algorithms:
        running[name] = Crc32() if name == "crc32" else hashlib.new(name)
    if content_or_none is not None:
        for digest in running.values():
            digest.update(content_or_none)
    return running


class Crc32:
    def __init__(self):
        self.value = 0

    def update(self, data):
        self.value = zlib.crc32(data, self.value)

    def hexdigest(self) -> str:
        return f"{self.value:08x}"


def listed(option: str | None) -> list[str]:
    return [part.strip() for part in (option or "").split(",") if part.strip()]


@dataclass
class Written(WriterCommitMessage):
    entries: list[dict] = field(default_factory=list)


class ShardWriter(DataSourceArrowWriter):
    """Subclasses name the file of a shard and write its rows.

    Where ``per_list`` is set, the index is kept in lists of so many shard numbers (``sources.shardlists``). An append keeps the
    way in which its set is indexed.
    """

    per_list: int | None = None

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path = options["path"]
        self.options = dict(options)
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex  # one for all tasks and for the commit: the writer is made once, then pickled
        self.hashes = listed(options.get("hashes"))
        self.columns = [f.name for f in schema.fields if f.name != "shard"]
        if "shard" not in schema.names:
            raise ValueError("shard files are written from a `shard` column")

    def file_name(self, shard: int) -> str:
        raise NotImplementedError

    def open_shard(self, filesystem, path: str):
        """A handle with ``add(record_batch)``, ``finish() -> dict`` and ``discard()``."""
        raise NotImplementedError

    def index(self, entries: list[dict]) -> dict:
        raise NotImplementedError

    def indexed(self, index: dict) -> list[dict]:
        """Entries out of an index, the inverse of ``index``."""
        raise NotImplementedError

    def write(self, iterator) -> Written:
        import numpy as np

        filesystem, base = locate(self.path)
        folder = commits.folder_of(base, self.job)
        filesystem.create_dir(folder, recursive=True)
        done, open_no, handle = Written(), None, None
        previous = None if self.overwrite else commits.current(filesystem, base)[0]
        in_lists = previous is not None and "lists" in previous
        taken = {e["file"] for e in self.indexed(previous)} if previous and not in_lists else set()
        looked_at = set()
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                numbers = batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
                rows = batch.select(self.columns)
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
                for start, end in zip(cuts, cuts[1:]):
                    number = int(numbers[start])
                    if number != open_no:
                        if handle is not None:
                            done.entries.append(self.entry(open_no, handle))
                            handle = None
                            if number < open_no:
                                raise ValueError("rows are not sorted by shard")
                        if in_lists and number // previous["per_list"] not in looked_at:
                            looked_at.add(number // previous["per_list"])
                            taken = {e["file"] for e in self.listed(filesystem, base, previous, {number})}
                        if self.file_name(number) in taken:
                            raise ValueError(f"{self.file_name(number)} is in the set; append shards under other numbers")
                        open_no, handle = number, self.open_shard(filesystem, f"{folder}/{self.file_name(number)}")
                    handle.add(rows.slice(start, end - start))
            if handle is not None:
                done.entries.append(self.entry(open_no, handle))
                handle = None
        finally:
            if handle is not None:
                handle.discard()
        return done

    def entry(self, shard: int, handle) -> dict:
        return {"shard": shard, "file": self.file_name(shard), **handle.finish()}

    def listed(self, filesystem, base: str, index: dict, numbers=None):
        """Entries of a set whose index is in lists: all, or those of the lists that the numbers are in."""
        touched = None if numbers is None else {n // index["per_list"] for n in numbers}
        lines = [line for line in index["lists"] if touched is None or line["number"] in touched]
        return shardlists.read_all(filesystem, base, lines)

    def commit(self, messages) -> None:
        filesystem, base = locate(self.path)
        filesystem.create_dir(base, recursive=True)
        entries = sorted((e for m in messages if m is not None for e in m.entries), key=lambda e: e["shard"])
        files = {e["file"] for e in entries}
        if len(files) != len(entries):
            raise ValueError("rows of one shard reached two tasks; cluster them by shard before writing")
        commits.finish(filesystem, base)
        previous = commits.current(filesystem, base)[0]
        beside = lambda found: [name for e in found for name in (e["file"], *e.get("beside", []))]
        new, gone = beside(entries), []
        before = [] if previous is None else self.indexed(previous) if "lists" not in previous else self.listed(
            filesystem, base, previous, None if self.overwrite else {e["shard"] for e in entries})
        lists = [] if previous is None else previous.get("lists", [])
        if self.overwrite:
            keep = set(new)
            gone = [name for e in before for name in beside([e]) if name not in keep] + [line["file"] for line in lists]
            kept, per_list, lists = [], self.per_list, []
        else:
            kept = list(before)
            if any(e["file"] in files for e in kept):
                raise ValueError("shards of these numbers joined the set meanwhile; append under other numbers")
            per_list = self.per_list if previous is None else previous.get("per_list")
        entries = sorted(kept + entries, key=lambda e: e["file"])
        if per_list is None:
            index = self.index(entries)
        else:
            folder = commits.folder_of(base, self.job)
            filesystem.create_dir(folder, recursive=True)
            made = shardlists.write(filesystem, folder, self.job, entries, per_list)
            touched = {line["number"] for line in made}
            gone += [line["file"] for line in lists if line["number"] in touched]
            lists = sorted([*made, *(line for line in lists if line["number"] not in touched)], key=lambda x: x["number"])
            index = {**self.index([]), "lists": lists, "per_list": per_list}
            new += [line["file"] for line in made]
        commits.publish(filesystem, base, self.job, index, new, sorted(gone))

    def abort(self, messages) -> None:
        """The job's folder goes, with what any of its tasks wrote; the set is as it was."""
        commits.discard(*locate(self.path), self.job)


def epoch_order(shards: list[dict], seed: int, epoch: int) -> list[dict]:
    """The shards in the order of an epoch: by a hash of seed, epoch and file, for any number of readers."""
    return sorted(shards, key=lambda s: (hashlib.md5(f"{seed}:{epoch}:{s['file']}".encode()).hexdigest(), s["file"]))


def deal(shards: list[dict], workers: int) -> list[list[dict]]:
    """Each worker's shards, in turn. An entry has its ``worker`` and, where samples are counted, the ``first`` of its places."""
    dealt = []
    for worker in range(min(workers, len(shards))):
        mine, first = [], 0
        for entry in shards[worker::workers]:
            mine.append({**entry, "worker": worker, "first": first})
            first = None if first is None or entry.get("samples") is None else first + entry["samples"]
        dealt.append(mine)
    return dealt


def packed(shards: list[dict], target: int, size=lambda entry: entry["bytes"]) -> list[list[dict]]:
    """Runs of consecutive entries of at most ``target`` bytes, or of one entry."""
    runs, held, total = [], [], 0
    for entry in shards:
        if held and total + size(entry) > target:
            runs.append(held)
            held, total = [], 0
        held.append(entry)
        total += size(entry)
    return [*runs, held] if held else runs


def wanted(pushed, column: str) -> set | None:
    """The values that a pushed filter leaves of a column; None if it isn't about that column."""
    if isinstance(pushed, (EqualTo, In)) and pushed.attribute == (column,):
        return {pushed.value} if isinstance(pushed, EqualTo) else set(pushed.value)
    return None


@dataclass
class ShardFiles(InputPartition):
    files: list[dict]

    def __init__(self, files):
        self.files = files


class ShardReader(DataSourceReader):
    """One task per ``bytes_per_task`` of shards, or smaller ones to make ``min_tasks``.

    ``mode`` follows Spark's readers: ``FAILFAST`` (default), ``DROPMALFORMED`` (what precedes the damage is
    kept) or ``PERMISSIVE``, which adds a row with the message in the ``_corrupt`` column of the schema.

    With ``epoch`` (and ``seed``) shards are read in that epoch's order. With ``workers`` they are dealt to that many, a
    task each, or several of ``bytes_per_task`` where that is given; rows have their ``worker`` and their ``place`` in its
    order. Filters on ``shard`` and ``worker`` are taken before work is planned. ``report`` names a folder (on storage that all
    tasks share) for a line about each shard that was not read whole, in all modes but ``FAILFAST``; see ``listing.damaged``.
    """

    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.options = dict(options)
        self.schema = schema
        self.mode = options.get("mode", "FAILFAST").upper()
        self.bytes_per_task = int(options.get("bytes_per_task", 128 << 20))
        self.min_tasks = int(options.get("min_tasks", 1))
        self.epoch = int(options["epoch"]) if "epoch" in options else None
        self.seed = int(options.get("seed", 42))
        self.workers = int(options["workers"]) if "workers" in options else None
        self.only: dict[str, set] = {}

    def list_shards(self, filesystem, base: str) -> list[dict]:
        """``file`` and ``bytes`` of every shard, in order."""
        raise NotImplementedError

    def shard_lists(self, filesystem, base: str) -> tuple[list[dict], str | None] | None:
        """The lines of an index in lists, and its job; None for a set that is indexed otherwise."""
        return None

    def belongs(self, entry: dict) -> bool:
        """Whether options leave the shard in the set."""
        return True

    def read_shard(self, filesystem, path: str, entry: dict):
        """Yield dicts of column lists."""
        raise NotImplementedError

    def pushFilters(self, filters):
        for pushed in filters:
            for column in ["shard", *(["worker"] if self.workers else [])]:
                values = wanted(pushed, column)
                if values is not None:
                    self.only[column] = self.only.get(column, values) & values
                    break
            else:
                yield pushed

    def partitions(self):
        filesystem, base = locate(self.path)
        lists = self.shard_lists(filesystem, base) if self.epoch is None and not self.workers else None
        if lists is not None:
            # Orders and workers need all shards; all else is planned from the lists' lines.
            target = min(self.bytes_per_task, sum(line["bytes"] for line in lists[0]) // self.min_tasks)
            return shardlists.slices(*lists, target, self.only.get("shard")) or [ShardFiles([])]
        shards = self.list_shards(filesystem, base)
        if self.epoch is not None:
            shards = epoch_order(shards, self.seed, self.epoch)
        asked = lambda s: all(s["file" if c == "shard" else c] in values for c, values in self.only.items())
        if self.workers:
            runs = [[s for s in mine if asked(s)] for mine in deal(shards, self.workers)]
            if "bytes_per_task" in self.options and all("samples" in s for s in shards):
                runs = [run for mine in runs for run in packed(mine, self.bytes_per_task)]
        else:
            shards = [s for s in shards if asked(s)]
            runs = packed(shards, min(self.bytes_per_task, sum(s["bytes"] for s in shards) // self.min_tasks))
        return [ShardFiles(run) for run in runs if run] or [ShardFiles([])]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        filesystem, base = locate(self.path)
        arrow_schema = to_arrow_schema(self.schema)

        def batch(columns: dict, file: str, corrupt: str | None = None, worker: int | None = None, place: int = 0):
            rows = len(next(iter(columns.values()))) if columns else 1
            filled = []
            for column in arrow_schema:
                if column.name == "shard":
                    values = [file] * rows
                elif self.workers and column.name == "worker":
                    values = [worker] * rows
                elif self.workers and column.name == "place":
                    values = range(place, place + rows)
                elif column.name == "_corrupt":
                    values = [corrupt] * rows
                else:
                    values = columns.get(column.name, [None] * rows)
                filled.append(pa.array(values, column.type))
            return pa.RecordBatch.from_arrays(filled, schema=arrow_schema)

        def asked(entry: dict) -> bool:
            return self.belongs(entry) and entry["file"] in self.only.get("shard", {entry["file"]})

        place = 0
        for entry in (shardlists.of_slice(filesystem, base, partition, asked) if isinstance(partition, shardlists.ListSlice)
                      else partition.files):
            place = place if entry.get("first") is None else entry["first"]
            try:
                delivered = 0
                folder, _, name = entry["file"].rpartition("/")
                home = f"{base}/{folder}" if folder else base
                path = commits.place_of(filesystem, home, name, entry.get("job"))
                for columns in self.read_shard(filesystem, path, entry):
                    part = batch(columns, entry["file"], None, entry.get("worker"), place)
                    delivered += part.num_rows
                    place += part.num_rows
                    yield part
                if delivered != entry.get("samples", delivered):
                    raise ValueError(f"{delivered} of {entry['samples']} samples")
            except DAMAGE as error:
                if self.mode == "FAILFAST":
                    raise
                if "report" in self.options:
                    self.report(entry, delivered, error)
                if self.mode == "PERMISSIVE" and "_corrupt" in arrow_schema.names:
                    yield batch({}, entry["file"], f"{type(error).__name__}: {error}")


    def report(self, entry: dict, delivered: int, error: Exception) -> None:
        """A file of its own for each damaged shard: a retry writes the same again."""
        filesystem, folder = locate(self.options["report"])
        filesystem.create_dir(folder, recursive=True)
        name = hashlib.md5(entry["file"].encode()).hexdigest()
        write_json(filesystem, f"{folder}/{name}.json", {
            "shard": entry["file"], "delivered": delivered, "samples": entry.get("samples"),
            "reason": f"{type(error).__name__}: {error}"}, indent=None)


def in_batches(rows, names: list[str], max_rows: int = 2000, max_bytes: int = 32 << 20):
    """Group an iterator of (bytes, tuple) into column dicts, bounded by rows and by payload bytes."""
    held, size, source, damage = [], 0, iter(rows), None
    while damage is None:
        try:
            weight, row = next(source)
        except StopIteration:
            break
        except Exception as error:
            # Rows read before the damage are good: deliver them first.
            damage = error
            break
        held.append(row)
        size += weight
        if len(held) >= max_rows or size >= max_bytes:
            yield dict(zip(names, map(list, zip(*held))))
            held, size = [], 0
    if held:
        yield dict(zip(names, map(list, zip(*held))))
    if damage is not None:
        raise damage


class ShardSource(DataSource):
    """Base of the registered formats."""

    writer_class: type[ShardWriter]
    reader_class: type[ShardReader]

    def placed(self, ddl: str) -> str:
        """A schema with the columns that ``workers`` adds."""
        return f"{ddl}, worker int, place long" if "workers" in self.options else ddl

    def reader(self, schema):
        return self.reader_class(self.options, schema)

    def writer(self, schema, overwrite):
        return self.writer_class(self.options, schema, overwrite)
