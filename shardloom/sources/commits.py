"""Two-phase commit of shard sets.

Tasks write into a hidden folder of their job, so neither a listing nor the index sees a file of theirs. A job commits by one
small file, the journal, which appears whole: from then on the new set is the set. What the journal says is then carried out:
files move to their own names, files that left the set go, the index is replaced, journal and folder go. All of that can be
repeated, so a driver that is lost in between loses nothing: readers take the set as the journal has it, and the next writer
finishes it. A job that fails or is aborted before its journal is there leaves the set as it was.

One writer at a time commits to a set. On object stores a move is a copy on the store's side.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pyarrow.fs as pafs

from shardloom.sources.storage import read_json, write_json

INDEX = "index.json"
JOURNAL = "_commit.json"  # hidden from listings, as the folders are
MOVES = 32  # files moved at a time


def folder_of(base: str, job: str) -> str:
    return f"{base}/_job-{job}"


def is_file(filesystem: pafs.FileSystem, path: str) -> bool:
    return filesystem.get_file_info(path).type == pafs.FileType.File


def remove_dir(filesystem: pafs.FileSystem, path: str) -> None:
    if filesystem.get_file_info(path).type == pafs.FileType.Directory:
        filesystem.delete_dir(path)


def current(filesystem: pafs.FileSystem, base: str) -> tuple[dict | None, str | None]:
    """The committed index, and the job whose files may still be in its folder."""
    journal = read_json(filesystem, f"{base}/{JOURNAL}")
    if journal is not None:
        return journal["index"], journal["job"]
    return read_json(filesystem, f"{base}/{INDEX}"), None


def place_of(filesystem: pafs.FileSystem, base: str, name: str, job: str | None) -> str:
    """Where a file of the set is now: in the folder of the job that is being carried out, or in its own place."""
    if job is not None and is_file(filesystem, f"{folder_of(base, job)}/{name}"):
        return f"{folder_of(base, job)}/{name}"
    return f"{base}/{name}"


def publish(filesystem: pafs.FileSystem, base: str, job: str, index: dict, files: list[str], gone: list[str]) -> None:
    """Commit a job's files with the index that names them; ``gone`` are files that are no longer in the set."""
    write_json(filesystem, f"{base}/{JOURNAL}", {"job": job, "index": index, "files": files, "gone": gone})
    finish(filesystem, base)


def finish(filesystem: pafs.FileSystem, base: str) -> None:
    """Carry out the journal, if there is one: by its own job, or by whoever writes next."""
    journal = read_json(filesystem, f"{base}/{JOURNAL}")
    if journal is None:
        return
    folder = folder_of(base, journal["job"])

    def settle(name: str) -> None:
        if is_file(filesystem, f"{folder}/{name}"):
            if filesystem.type_name == "hdfs" and is_file(filesystem, f"{base}/{name}"):
                filesystem.delete_file(f"{base}/{name}")  # its rename does not replace
            filesystem.move(f"{folder}/{name}", f"{base}/{name}")

    def drop(name: str) -> None:
        if is_file(filesystem, f"{base}/{name}"):
            filesystem.delete_file(f"{base}/{name}")

    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(settle, journal["files"]))
    write_json(filesystem, f"{base}/{INDEX}", journal["index"])
    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(drop, journal["gone"]))
    filesystem.delete_file(f"{base}/{JOURNAL}")
    remove_dir(filesystem, folder)


def discard(filesystem: pafs.FileSystem, base: str, job: str) -> None:
    """Undo a job that has not committed; one whose journal is there is left to be finished."""
    journal = read_json(filesystem, f"{base}/{JOURNAL}")
    if journal is None or journal["job"] != job:
        remove_dir(filesystem, folder_of(base, job))
