"""Byte-level BPE by ranks: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the others.

Tier one looks pre-tokens up in a minimal perfect hash of the vocabulary (hash and displace: a bucket's displacement
sends its keys to free slots, buckets of one key name their slot); one comparison of bytes tells a hit from a stranger.
Tier two merges the bytes of a miss: nodes in a linked list, neighbouring pairs in a heap by (rank, place), so a
pre-token of n bytes takes O(n log n), however long it is. Pieces of text between spaces are remembered by a worker, as
no pre-token crosses the place before a space.

Null texts are empty and have no ids. Null document ids are kept, repeated rows are rows of their own, an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from shardloom.llm.chunk_encoder import STEP_BYTES, ChunkEncoder
from shardloom.llm.common import arrow_schema, batch, id_and_text, text_steps, worker_state

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
KEYS_PER_BUCKET = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Byte strings to 0..n-1 without a gap; strangers go anywhere, so a hit must be compared."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // KEYS_PER_BUCKET)
        hashes = self.hashes(keys)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("two keys share a 64-bit hash, or a key is repeated")
        home = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order, sizes = np.argsort(home, kind="stable"), np.bincount(home, minlength=self.buckets)
        firsts = np.cumsum(sizes) - sizes
        self.moves = np.zeros(self.buckets, dtype=np.int64)
        self.owner = np.full(self.n, -1, dtype=np.int64)  # slot to key
        for b in np.argsort(-sizes, kind="stable"):
            own = order[firsts[b]:firsts[b] + sizes[b]]
            if len(own) < 2:
                break
            at = 0
            while True:
                tries = np.arange(at, at + 256, dtype=np.uint64)
                slots = self._slot(hashes[own][:, None], tries[None, :])
                fits = (self.owner[slots] < 0).all(axis=0)
                fits &= (np.diff(np.sort(slots, axis=0), axis=0) > 0).all(axis=0)
                if fits.any():
                    k = int(np.argmax(fits))
                    self.moves[b] = at + k
                    self.owner[slots[:, k]] = own
                    break
                at += 256
        free = iter(np.flatnonzero(self.owner < 0))
        for b in np.flatnonzero(sizes == 1):
            slot = next(free)
            self.moves[b] = -1 - slot
            self.owner[slot] = order[firsts[b]]

    @staticmethod
    def hashes(keys) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))

    def _slot(self, hashes: np.ndarray, move: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (hashes ^ (move * MIX)) * MIX
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, keys) -> np.ndarray:
        """The index of the one key that each could be."""
        hashes = self.hashes(keys)
        move = self.moves[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return self.owner[np.where(move < 0, -1 - move, self._slot(hashes, np.maximum(move, 0).astype(np.uint64)))]


class ByteBpe(ChunkEncoder):
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.keys = list(self.ranks)
        self.key_ranks = list(self.ranks.values())
        self.bytes_of = {rank: key for key, rank in self.ranks.items()}
        self.hash = PerfectHash(self.keys)
        self.pattern, self.rule = regex.compile(pattern), "byte"
        self.forget()

    @classmethod
    def of_worker(cls, path: str, pattern: str) -> "ByteBpe":
        return worker_state(f"byte_bpe:{path}:{pattern}", lambda: cls(path, pattern))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no vocabulary entry."""
        n, ranks = len(piece), self.ranks
        ends, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            # A node begins where its left neighbour ends; the pair is stale if either of them has merged since.
            if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
                continue
            alive[ends[i]] = False
            ends[i] = end
            if end < n:
                left[end] = i
                if (r := ranks.get(piece[i:ends[end]])) is not None:
                    heappush(heap, (r, i, ends[end]))
            if (j := left[i]) >= 0 and (r := ranks.get(piece[j:end])) is not None:
                heappush(heap, (r, j, end))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:ends[i]]])
            i = ends[i]
        return ids

    def library(self, pieces: list[str]) -> list[list[int]]:
        split = [[t.encode() for t in self.pattern.findall(p)] for p in pieces]
        distinct = list({t for tokens in split for t in tokens})
        if not distinct:
            return [[] for _ in pieces]
        ids = {}
        for token, k in zip(distinct, self.hash.lookup(distinct).tolist()):
            ids[token] = [self.key_ranks[k]] if self.keys[k] == token else self.merge(token)
        return [[i for t in tokens for i in ids[t]] for tokens in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per row: how many ids, the digest of the ids (little-endian unsigned 32-bit) and that of the decoded bytes."""
    schema = arrow_schema(CODED)

    def run(batches):
        bpe = ByteBpe.of_worker(ranks, pattern)
        for rows in batches:
            for step in text_steps(rows, STEP_BYTES):
                coded, sizes = bpe.encode_array(step.column("text"))
                coded = coded.to_pylist()
                yield batch(schema, [step.column("doc_id"), sizes, [hashlib.sha256(ids).hexdigest() for ids in coded],
                                     [hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in coded]])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, CODED)
