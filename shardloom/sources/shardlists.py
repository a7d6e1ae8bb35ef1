"""The shard list of a set as files of its own, cut by shard number.

``index.json`` then has a line per list (its file, first and last shard, numbers of shards, samples and bytes) instead of one
per shard. Whoever plans a read of the whole set reads the index alone: a task gets a slice of a list and reads that list
itself. A filter on shards leaves the lists that may hold them, and an append replaces the lists that it adds to.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import InputPartition

from shardloom.sources import commits
from shardloom.sources.storage import read_json, write_json

AT_ONCE = 32  # lists read or written at a time


@dataclass
class ListSlice(InputPartition):
    """A part of a list's shards: the ``part``-th of ``parts`` of about equal bytes."""

    listed: dict
    job: str | None
    part: int
    parts: int

    def __init__(self, listed, job, part, parts):
        self.listed, self.job, self.part, self.parts = listed, job, part, parts


def write(filesystem, folder: str, job: str, entries: list[dict], per_list: int) -> list[dict]:
    """Write entries as lists; returns the index's line of each. Names have the job: no list is ever written over."""
    cut: dict[int, list[dict]] = {}
    for entry in entries:
        cut.setdefault(entry["shard"] // per_list, []).append(entry)

    def put(number: int) -> dict:
        held = sorted(cut[number], key=lambda e: e["shard"])
        line = {"number": number, "file": f"_shards-{number:06d}-{job}.json", "shards": len(held),
                "first": min(e["file"] for e in held), "last": max(e["file"] for e in held),
                "samples": sum(e["samples"] for e in held), "bytes": sum(e["bytes"] for e in held)}
        write_json(filesystem, f"{folder}/{line['file']}", {"shards": held}, indent=None)
        return line

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(put, sorted(cut)))


def read(filesystem, base: str, line: dict, job: str | None = None) -> list[dict]:
    """The entries of a list; one that its index names and storage lacks is an error of the storage."""
    found = read_json(filesystem, commits.place_of(filesystem, base, line["file"], job))
    if found is None:
        raise FileNotFoundError(f"{base}/{line['file']}")
    return found["shards"]


def read_all(filesystem, base: str, lines: list[dict], job: str | None = None):
    """Entries of many lists, in order, some lists at a time."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for at in range(0, len(lines), AT_ONCE):
            for entries in pool.map(lambda line: read(filesystem, base, line, job), lines[at:at + AT_ONCE]):
                yield from entries


def slices(lines: list[dict], job: str | None, target: int, files: set | None) -> list[ListSlice]:
    """What tasks read: lists that may hold one of ``files`` (any, if None), in slices of about ``target`` bytes."""
    found = []
    for line in lines:
        asked = line["shards"] if files is None else sum(line["first"] <= f <= line["last"] for f in files)
        parts = min(line["shards"], asked, max(1, -(-line["bytes"] // max(1, target))))
        found += [ListSlice(line, job, part, parts) for part in range(parts)]
    return found


def of_slice(filesystem, base: str, piece: ListSlice, wanted) -> list[dict]:
    """The slice's entries: of those ``wanted``, the ones whose first byte is in its share of their bytes."""
    held = [{**e, "job": piece.job} for e in read(filesystem, base, piece.listed, piece.job) if wanted(e)]
    total, at, found = sum(e["bytes"] for e in held), 0, []
    for entry in held:
        if at * piece.parts // max(1, total) == piece.part:
            found.append(entry)
        at += entry["bytes"]
    return found
