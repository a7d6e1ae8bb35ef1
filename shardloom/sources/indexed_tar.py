"""Random access into tar shards: sample offsets beside each shard, a split manifest, and a reader whose
unit of work is a worker's portion of a shard.

Shards stay where they are. ``<shard>.idx`` holds the byte offset of every sample as little-endian uint64 and
the end of the last one; ``.meta/info.json`` the shards with their sample counts and splits;
``.meta/dataset.json`` the field map.
"""

from __future__ import annotations

import io
import tarfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shardloom.operators.ordering import ratio_bounds
from shardloom.session import qualified
from shardloom.sources.shardfiles import in_batches, packed, wanted
from shardloom.sources.storage import ForwardReader, locate, read_json, replacing, write_json
from shardloom.sources.tar import BLOCK, SAMPLES, TarReader, WholeArchive, read_listing, samples_of

META = ".meta"


def sample_offsets(stream):
    """(key, first byte, end byte, payload bytes) of every sample; payloads are skipped over, not read."""
    key, begin, end, payload = None, 0, 0, 0
    with tarfile.open(fileobj=stream, mode="r:", tarinfo=WholeArchive) as archive:
        for member in archive:
            if not member.isfile():
                continue
            folder, _, name = member.name.rpartition("/")
            stem = (folder + "/" if folder else "") + name.partition(".")[0]
            if stem != key:
                if key is not None:
                    yield key, begin, end, payload
                key, begin, payload = stem, member.offset, 0
            end = member.offset_data + member.size + (-member.size % BLOCK)
            payload += member.size
        if key is not None:
            yield key, begin, end, payload


def shard_list(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``shard, bytes, listed`` of the tar files under a path, one row per partition's worth of work."""
    path = qualified(spark, path)
    filesystem, base = locate(path)
    shards = TarReader({"path": path, **options}, None).list_shards(filesystem, base)
    rows = [(s["file"], int(s["bytes"]), s["file"].rpartition("/")[2] + SAMPLES in s.get("beside", [])) for s in shards]
    tasks = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(rows, "shard string, bytes long, listed boolean").repartition(tasks, "shard")


def samples_in(filesystem, path: str, listed: bool):
    """(key, first byte, end byte, payload bytes) of a shard's samples: as its writer listed them, or out of its headers."""
    if listed:
        table = read_listing(filesystem, path + SAMPLES)
        yield from zip(*(table.column(c).to_pylist() for c in ("key", "begin", "end", "payload_bytes")))
        return
    with filesystem.open_input_file(path) as source:
        yield from sample_offsets(ForwardReader(source))


def tar_sample_index(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One row per sample of a tar set: shard, row in shard, key, byte range and payload bytes."""
    path = qualified(spark, path)

    def scan(batches):
        filesystem, base = locate(path)
        for batch in batches:
            for shard, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = ((64, (shard, n, *sample)) for n, sample in enumerate(samples_in(filesystem, f"{base}/{shard}", listed)))
                for columns in in_batches(rows, ["shard", "row", "key", "begin", "end", "payload_bytes"], 100_000):
                    yield pa.RecordBatch.from_pydict(columns)

    return shard_list(spark, path, **options).select("shard", "listed").mapInArrow(
        scan, "shard string, row long, key string, begin long, end long, payload_bytes long")


def prepare_index(spark: SparkSession, path: str, field_map: dict[str, str], ratios=(1, 0, 0),
                  names=("train", "val", "test"), **options: str) -> list[dict]:
    """Index an existing tar set in place; returns the shard entries of the manifest."""
    path = qualified(spark, path)

    def index_shards(batches):
        filesystem, base = locate(path)
        for batch in batches:
            counts = []
            for shard, listed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                bounds = [(begin, end) for _, begin, end, _ in samples_in(filesystem, f"{base}/{shard}", listed)]
                offsets = np.array([b for b, _ in bounds] + ([bounds[-1][1]] if bounds else [0]), dtype="<u8")
                with replacing(filesystem, f"{base}/{shard}.idx") as out:
                    out.write(offsets.tobytes())
                counts.append(len(bounds))
            yield pa.RecordBatch.from_pydict({"shard": batch.column(0), "bytes": batch.column(1),
                                              "samples": pa.array(counts, pa.int64())})

    counted = (shard_list(spark, path, **options).select("shard", "bytes", "listed")
               .mapInArrow(index_shards, "shard string, bytes long, samples long").collect())
    shards = sorted(({"file": r.shard, "samples": r.samples, "bytes": r.bytes} for r in counted), key=lambda s: s["file"])
    for number, entry in enumerate(shards):
        entry["split"] = next((name for name, _, end in ratio_bounds(list(ratios), list(names))
                               if number < int(end * len(shards) + 0.5)), names[-1])
    filesystem, base = locate(path)
    filesystem.create_dir(f"{base}/{META}", recursive=True)
    write_json(filesystem, f"{base}/{META}/dataset.json", {"field_map": field_map})
    write_json(filesystem, f"{base}/{META}/info.json", {"shards": shards})
    return shards


def worker_start(worker: int, workers: int, total: int) -> int:
    return -(-worker * total // workers)


def portions(shards: list[dict], workers: int) -> list[dict]:
    """Each worker's contiguous range of rows, cut at shard ends."""
    total, first, found = sum(s["samples"] for s in shards), 0, []
    for entry in shards:
        end = first + entry["samples"]
        if entry["samples"]:
            for worker in range(first * workers // total, (end - 1) * workers // total + 1):
                low = max(first, worker_start(worker, workers, total))
                high = min(end, worker_start(worker + 1, workers, total))
                if low < high:
                    found.append({"file": entry["file"], "worker": worker, "low": low - first, "high": high - first,
                                  "first_pos": low, "bytes": entry.get("bytes", 0) * (high - low) // entry["samples"]})
        first = end
    return found


def slice_starts(length: int, most: int) -> np.ndarray:
    """Starts of the pieces a portion is cut into; Python rounds half to even, as the cut requires."""
    pieces = max(1, round(length / most))
    return np.arange(pieces) * length // pieces


@dataclass
class Portions(InputPartition):
    portions: list[dict]

    def __init__(self, portions):
        self.portions = portions


class SliceReader(DataSourceReader):
    """A task reads consecutive portions of one worker, of ``bytes_per_task`` together. Filters on ``worker`` and ``shard``
    are taken before work is planned, so a worker that reads its own share plans nothing else."""

    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        self.workers = int(options.get("workers", 1))
        self.most = int(options.get("max_len", 100))
        self.split = options.get("split", "train")
        self.bytes_per_task = int(options.get("bytes_per_task", 128 << 20))
        self.only: dict[str, set] = {}

    def pushFilters(self, filters):
        for pushed in filters:
            for column in ("worker", "shard"):
                values = wanted(pushed, column)
                if values is not None:
                    self.only[column] = self.only.get(column, values) & values
                    break
            else:
                yield pushed

    def partitions(self):
        filesystem, base = locate(self.path)
        info = read_json(filesystem, f"{base}/{META}/info.json")
        if info is None:
            raise FileNotFoundError(f"{base}/{META}/info.json: run prepare_index first")
        cut = portions([s for s in info["shards"] if s["split"] == self.split], self.workers)
        cut = [p for p in cut if all(p["file" if c == "shard" else c] in values for c, values in self.only.items())]
        runs = [run for worker in sorted({p["worker"] for p in cut})
                for run in packed([p for p in cut if p["worker"] == worker], self.bytes_per_task)]
        return [Portions(run) for run in runs] or [Portions([])]

    def read(self, partition):
        filesystem, base = locate(self.path)
        if partition.portions:
            field_map = read_json(filesystem, f"{base}/{META}/dataset.json")["field_map"]
        for portion in partition.portions:
            yield from self.read_portion(filesystem, base, portion, field_map)

    def read_portion(self, filesystem, base, portion, field_map):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_schema = to_arrow_schema(self.schema)
        low, high = portion["low"], portion["high"]
        with filesystem.open_input_file(f"{base}/{portion['file']}.idx") as stream:
            offsets = np.frombuffer(stream.read_at((high - low + 1) * 8, low * 8), "<u8")
        with filesystem.open_input_file(f"{base}/{portion['file']}") as stream:
            section = stream.read_at(int(offsets[-1] - offsets[0]), int(offsets[0]))
        starts = slice_starts(high - low, self.most)

        def rows():
            for n, (key, parts) in enumerate(samples_of(io.BytesIO(section), whole=False)):
                piece = int(np.searchsorted(starts, n, side="right")) - 1
                fixed = {"__key__": key, "shard": portion["file"], "worker": portion["worker"],
                         "pos": portion["first_pos"] + n, "slice_start": int(low + starts[piece])}
                row = []
                for column in arrow_schema:
                    value = fixed.get(column.name)
                    if column.name not in fixed:
                        value = parts.get(field_map.get(column.name, column.name))
                        if value is not None and pa.types.is_string(column.type):
                            value = value.decode("utf-8")
                    row.append(value)
                yield sum(map(len, parts.values())), row

        for columns in in_batches(rows(), arrow_schema.names):
            yield pa.RecordBatch.from_pydict(columns, schema=arrow_schema)


class TarSlices(DataSource):
    """``tarslices``: options path, workers, max_len, split; columns are the consumer names of the field map."""

    @classmethod
    def name(cls):
        return "tarslices"

    def schema(self):
        return ("worker bigint, shard string, slice_start bigint, pos bigint, __key__ string, "
                "image binary, caption string")

    def reader(self, schema):
        return SliceReader(self.options, schema)
