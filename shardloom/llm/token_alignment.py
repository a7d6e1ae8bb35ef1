"""Cross-tokenizer alignment: which tokens of a byte-level BPE vocabulary (A) stand for which pieces (B), corpus-wide.

A encodes a space and the text, B the text, to which it adds that space. Places where tokens of both end cut a text into
groups. ``identity`` is made once from the vocabularies: for each A id the B id of the same bytes. A group of one token on
either side that it maps is regular and is counted in vectors of the vocabulary's length, at a text's first use of the A id.
All others are irregular, and only their id pairs are shuffled.

Both tokenizers cut between a character that is no white space and a following space, before any merge. Texts are cut there,
and a worker remembers the alignment of pieces by number, so a batch of texts is aligned by gathering from arrays. Documents
are held in packed groups of bounded size. A group sends each distinct irregular pair once, with the number of its
documents that hold it, to be added up by pair; it gets the sums back by the pair's number within the group. What is collected
are two vectors of A's vocabulary: the regular counts and the highest count of each A id.

Texts that are null or empty, or whose tokens don't join to the same bytes on both sides (a text with U+2581 is one), have
no tokens. Documents with one id, or none, are counted as rows of their own. Special tokens inside texts are plain text. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from shardloom.llm.chunk_encoder import SPACES, cut_rule
from shardloom.llm.common import (Grown, arrow_schema, batch, id_and_text, ragged, single_threaded, staged, sums, text_steps,
                                  worker_state)

STEP_BYTES = 4 << 20  # text aligned at a time
GROUP_PAIRS = 2_000_000  # pairs of documents held by a group, unless one step of texts has more
MEMO = 300_000  # pieces of text remembered by a worker
WIDE = 1 << 20  # pairs of a group from which its distinct ids are paired instead of its tokens
CUT = re.compile(f"(?<=[^{SPACES}])(?= )")
SPACED = re.compile(f"[{SPACES}]\\Z")
GROUPS = "gid long, docs binary, nulls binary, numbers binary, digests binary, regular binary, pairs binary, ids binary, counts binary, keys binary, holders binary"
ASKED = "gid long, slot int, pair long, docs long"
VECTOR = "a int, docs long"
ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")
NUMBERS = 4  # n_a, n_b, n_groups, n_links


def byte_of_char() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable bytes as they are, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabularies:
    """Both tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, byte_path: str, piece_path: str):
        single_threaded()
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        chars = byte_of_char()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(chars[c] for c in t) for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        usual = [i for i in range(len(pieces)) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i))]
        usual.sort(key=lambda i: (not self.b.is_byte(i), -i))  # of equal bytes the first that is no byte piece
        same = {self.b_bytes[i]: i for i in usual}
        self.identity = np.array([same.get(t, -1) if t else -1 for t in self.a_bytes], dtype=np.int64)
        self.a_size, self.b_size = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = next(i for i in usual[::-1] if self.b_bytes[i] == b" ")
        # Places to cut at are proven by the vocabularies: A splits there, no piece of B has a space behind another
        # character, and B takes texts as they are.
        probe = "A  a\nﬁＡ éé"
        self.cuts = (cut_rule(byte_path) == "byte" and not any(re.search("[^▁]▁", p) for p in pieces)
                     and self.b.normalize(probe).replace("▁", " ") == " " + probe)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        b = self.b.encode(texts, num_threads=1)
        # Of a piece without characters only the space that B adds is left.
        return [x.ids for x in a], [ids if t else [self.space] for t, ids in zip(texts, b)]


class Pieces:
    """Alignments of pieces of text by number. A piece is given without the space that it starts with."""

    def __init__(self, words: Vocabularies):
        self.words = words
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.shown: list[bytes] = []  # the groups in decimal ids
        self.numbers = [Grown() for _ in range(NUMBERS)]
        self.good, self.spaced = Grown(bool), Grown(bool)  # the bytes agree; a space at the end, or nothing
        self.regular, self.regular_size = Grown(np.int32), Grown()
        self.pair, self.times, self.pair_size = Grown(), Grown(), Grown()

    @classmethod
    def of_worker(cls, byte_path: str, piece_path: str) -> "Pieces":
        return worker_state(f"aligned:{byte_path}:{piece_path}", lambda: cls(Vocabularies(byte_path, piece_path)))

    def find(self, texts: list[str]) -> np.ndarray:
        """The numbers of pieces; unknown ones are aligned."""
        new = list(dict.fromkeys(t for t in texts if t not in self.slots))
        if new:
            first = len(self.slots)
            self.slots.update(zip(new, range(first, first + len(new))))
            self.learn(new)
        return np.fromiter(map(self.slots.__getitem__, texts), np.int64, len(texts))

    def learn(self, new: list[str]) -> None:
        words, a_ids, b_ids = self.words, *self.words.encode(new)
        good = np.fromiter((
            b"".join(map(words.a_bytes.__getitem__, a)) == (whole := b" " + t.encode())
            and b"".join(map(words.b_bytes.__getitem__, b)) == whole for t, a, b in zip(new, a_ids, b_ids)), bool, len(new))
        a_ids, b_ids = ([x if g else [] for x, g in zip(ids, good)] for ids in (a_ids, b_ids))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(new)) for ids in (a_ids, b_ids))
        a, b = (np.array([i for x in ids for i in x], dtype=np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(words.a_size[a]), np.cumsum(words.b_size[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        size_a, size_b = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        piece = np.repeat(np.arange(len(new)), n_a)[first_a] if len(ends) else np.zeros(0, np.int64)
        links = size_a * size_b
        one = links == 1
        mapped = np.zeros(len(ends), bool)
        mapped[one] = words.identity[a[first_a[one]]] == b[first_b[one]]
        groups = np.bincount(piece, minlength=len(new))
        for grown, values in zip(self.numbers, (n_a, n_b, groups, np.bincount(piece, weights=links, minlength=len(new)))):
            grown.extend(values)
        self.good.extend(good)
        self.spaced.extend([not t or SPACED.search(t) is not None for t in new])
        # One-to-one pairs of the map, wherever they occur, go by the A id alone.
        owner, pair, times = self.pairs(piece, a, b, first_a, first_b, size_a, size_b, links, np.flatnonzero(~mapped))
        known = words.identity[pair >> 32] == (pair & 0xFFFFFFFF)
        again = np.repeat(pair[known] >> 32, times[known])
        owners = np.concatenate([piece[mapped], np.repeat(owner[known], times[known])])
        order = np.argsort(owners, kind="stable")
        self.regular.extend(np.concatenate([a[first_a[mapped]], again])[order])
        self.regular_size.extend(np.bincount(owners, minlength=len(new)))
        self.pair.extend(pair[~known])
        self.times.extend(times[~known])
        self.pair_size.extend(np.bincount(owner[~known], minlength=len(new)))
        # The groups as text: cut the ids of each side at the groups.
        at_a, at_b = first_a.tolist(), first_b.tolist()
        till_a, till_b = (first_a + size_a).tolist(), (first_b + size_b).tolist()
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        shown = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip(at_a, till_a, at_b, till_b)]
        cut = np.concatenate([[0], np.cumsum(groups)]).tolist()
        self.shown.extend(";".join(shown[i:j]).encode() for i, j in zip(cut, cut[1:]))

    @staticmethod
    def pairs(piece, a, b, first_a, first_b, size_a, size_b, links, chosen):
        """Distinct pairs of the chosen groups by piece, and how often each is linked."""
        small = chosen[links[chosen] < WIDE]
        group = np.repeat(small, links[small])
        at = ragged(np.zeros(len(small), np.int64), links[small])
        left, right = a[first_a[group] + at // size_b[group]], b[first_b[group] + at % size_b[group]]
        found = [(piece[group], left << 32 | right, np.ones(len(group), np.int64))]
        for g in chosen[links[chosen] >= WIDE].tolist():
            x, n = np.unique(a[first_a[g]:first_a[g] + size_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g]:first_b[g] + size_b[g]], return_counts=True)
            pair = (x[:, None] << 32 | y[None, :]).ravel()
            found.append((np.full(len(pair), piece[g]), pair, (n[:, None] * m[None, :]).ravel()))
        return distinct(*(np.concatenate(c) for c in zip(*found)))

    def trim(self) -> None:
        """Forget all but the pieces seen first, which are the frequent ones, when there are too many."""
        if len(self.slots) <= MEMO:
            return
        keep = MEMO // 2
        self.slots = dict(zip(list(self.slots)[:keep], range(keep)))
        del self.shown[keep:]
        self.regular.n, self.pair.n = int(self.regular_size.view[:keep].sum()), int(self.pair_size.view[:keep].sum())
        self.times.n = self.pair.n
        for grown in (*self.numbers, self.good, self.spaced, self.regular_size, self.pair_size):
            grown.n = keep


def distinct(owner: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key) in order, each once, with its times added up."""
    order = np.lexsort((key, owner))
    owner, key, times = owner[order], key[order], times[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[new], key[new], np.add.reduceat(times, np.flatnonzero(new)) if len(key) else times


def aligned(pieces: Pieces, texts: pa.Array):
    """Of some texts: numbers (a column each), digests, regular ids and pairs with (text, id or pair, times)."""
    n = len(texts)
    if pieces.words.cuts:
        parts = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        slots = pieces.find(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        last = np.zeros(len(slots), bool)
        last[np.cumsum(sizes) - 1] = True
        # A space that follows a white space is no place to cut at.
        other = sums(pieces.spaced.view[slots] & ~last, sizes) > 0
    else:
        sizes, slots, other = np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    whole = sums(~pieces.good.view[slots], sizes) > 0 if pieces.words.cuts else other
    runs = np.split(slots, np.cumsum(sizes)[:-1])
    for i in np.flatnonzero(other | whole).tolist():
        text = texts[i].as_py()
        # A text whose bytes disagree somewhere is judged as a whole.
        cut = [p[1:] for p in CUT.split(" " + text)] if pieces.words.cuts and not whole[i] else [text]
        found = pieces.find(cut)
        runs[i] = found if len(cut) == 1 or pieces.good.view[found].all() else pieces.find([text])
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(empty).tolist():
        runs[i] = runs[i][:0]
    sizes = np.fromiter(map(len, runs), np.int64, n)
    slots = np.concatenate(runs) if n else np.zeros(0, np.int64)
    numbers = [sums(g.view[slots], sizes) for g in pieces.numbers]
    shown = pieces.shown
    digests = []
    for run, tokens in zip(runs, numbers[0].tolist()):
        digests.append(hashlib.sha256(b";".join(map(shown.__getitem__, run.tolist()))).digest() if tokens else bytes(32))
    doc = np.repeat(np.arange(n), sizes)

    def gathered(size: Grown):
        held = size.view
        return np.repeat(doc, held[slots]), ragged((np.cumsum(held) - held)[slots], held[slots])

    of_regular, at = gathered(pieces.regular_size)
    regular = distinct(of_regular, pieces.regular.view[at].astype(np.int64), np.ones(len(at), np.int64))
    of_pair, at = gathered(pieces.pair_size)
    return numbers, digests, regular, distinct(of_pair, pieces.pair.view[at], pieces.times.view[at])


def _packed(values: np.ndarray, kind: str) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.astype(kind).tobytes(), "zstd", asbytes=True)


def _unpacked(data, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), kind) if size else np.zeros(0, kind)


class Group:
    def __init__(self, gid: int):
        self.gid, self.ids, self.parts, self.n, self.held = gid, [], [], 0, 0

    def add(self, ids: pa.Array, part) -> None:
        numbers, digests, regular, pairs = part
        self.parts.append((numbers, digests, (regular[0] + self.n, *regular[1:]), (pairs[0] + self.n, *pairs[1:])))
        self.ids.append(ids)
        self.n += len(ids)
        self.held += len(pairs[0]) + len(regular[0])

    def row(self, schema: pa.Schema, vocabulary: int) -> pa.RecordBatch:
        numbers, digests, regular, pairs = zip(*self.parts)
        ids = pa.concat_arrays(self.ids)
        of_regular, a, a_times = (np.concatenate(c) for c in zip(*regular))
        of_pair, pair, times = (np.concatenate(c) for c in zip(*pairs))
        keys, slot, holders = np.unique(pair, return_inverse=True, return_counts=True)
        vector = np.bincount(a, minlength=vocabulary)  # a row of a document and an id is there once
        used = np.flatnonzero(vector)
        runs = lambda owner, *values: b"".join(
            len(p).to_bytes(8, "little") + p for p in (
                _packed(np.bincount(owner, minlength=self.n), "<u4"), *(_packed(v, "<u4") for v in values)))
        return batch(schema, [
            [self.gid], [_packed(ids.fill_null(0).to_numpy(zero_copy_only=False), "<i8")],
            [ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()],
            [_packed(np.concatenate([np.concatenate(c) for c in zip(*numbers)]), "<i8")],
            [b"".join(d for part in digests for d in part)], [runs(of_regular, a, a_times)],
            [runs(of_pair, slot, times)], [_packed(used, "<u4")], [_packed(vector[used], "<u4")],
            [_packed(np.diff(keys, prepend=0), "<i8")], [_packed(holders, "<u4")]])


def _read_runs(data: bytes):
    at, out = 0, []
    for kind in ("<u4", "<u4", "<u4"):
        size = int.from_bytes(data[at:at + 8], "little")
        out.append(_unpacked(data[at + 8:at + 8 + size], kind).astype(np.int64))
        at += 8 + size
    return out


def _group_rows(byte_path: str, piece_path: str, group_pairs: int):
    schema = arrow_schema(GROUPS)

    def run(batches):
        pieces, gid = Pieces.of_worker(byte_path, piece_path), TaskContext.get().partitionId() << 32
        vocabulary = len(pieces.words.a_bytes)
        group = Group(gid)
        for rows in batches:
            for part in text_steps(rows, STEP_BYTES):
                pieces.trim()
                group.add(part.column("doc_id"), aligned(pieces, part.column("text")))
                if group.held >= group_pairs:
                    yield group.row(schema, vocabulary)
                    gid += 1
                    group = Group(gid)
        if group.n:
            yield group.row(schema, vocabulary)
    return run


def _ask_rows(batches):
    schema = arrow_schema(ASKED)
    for rows in batches:
        for gid, keys, holders in zip(*(rows.column(c).to_pylist() for c in ("gid", "keys", "holders"))):
            keys, holders = np.cumsum(_unpacked(keys, "<i8")), _unpacked(holders, "<u4")
            for at in range(0, len(keys), 100_000):
                part = keys[at:at + 100_000]
                yield batch(schema, [np.full(len(part), gid), np.arange(at, at + len(part), dtype=np.int32), part,
                                     holders[at:at + 100_000].astype(np.int64)])


def _vector_rows(batches):
    schema = arrow_schema(VECTOR)
    for rows in batches:
        for ids, counts in zip(*(rows.column(c).to_pylist() for c in ("ids", "counts"))):
            yield batch(schema, [_unpacked(ids, "<u4").astype(np.int32), _unpacked(counts, "<u4").astype(np.int64)])


def _vector(counts: DataFrame, size: int) -> np.ndarray:
    """A count per A id; at most one row of each is collected."""
    out = np.zeros(size, dtype=np.int64)
    for row in counts.collect():
        out[row.a] = row.docs
    return out


def _link_rows(regular: np.ndarray, highest: np.ndarray):
    schema = arrow_schema(ALIGNED)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        row = {name: left.column(name)[0].as_py() for name in left.column_names}
        ids, nulls = _unpacked(row["docs"], "<i8"), np.frombuffer(row["nulls"], np.uint8).astype(bool)
        n_a, n_b, n_groups, n_links = _unpacked(row["numbers"], "<i8").reshape(NUMBERS, -1)
        a_size, a, a_times = _read_runs(row["regular"])
        pair_size, slot, times = _read_runs(row["pairs"])
        counts, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right.column("slot").to_numpy()
        counts[at] = right.column("docs").to_numpy()
        best[at] = highest[right.column("pair").to_numpy() >> 32]
        total = sums(a_times * regular[a], a_size) + sums(times * counts[slot], pair_size)
        tops = sums(a_times * (regular[a] == highest[a]), a_size) + sums(times * (counts == best)[slot], pair_size)
        hexes = [row["digests"][i:i + 32].hex() if n else "" for i, n in zip(range(0, 32 * len(ids), 32), n_a.tolist())]
        return pa.Table.from_batches([batch(schema, [pa.array(ids, pa.int64(), mask=nulls), n_a, n_b, n_groups, n_links, tops,
                                                     total, hexes])])
    return run


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
          group_pairs: int = GROUP_PAIRS) -> tuple[DataFrame, DataFrame]:
    """A row per document, and the pair counts: (a, b, docs), by how many documents link the two."""
    words = Vocabularies(byte_path, piece_path)
    groups = staged(id_and_text(docs, id_col, text_col).mapInArrow(_group_rows(byte_path, piece_path, group_pairs), GROUPS),
                    "aligned")
    asked = groups.select("gid", "keys", "holders").mapInArrow(_ask_rows, ASKED)
    # A pair has a row per group, however many documents hold it.
    told = staged(asked.withColumn("docs", F.sum("docs").over(Window.partitionBy("pair"))), "pair-counts")
    vector = groups.select("ids", "counts").mapInArrow(_vector_rows, VECTOR)
    size = len(words.a_bytes)
    regular = _vector(vector.groupBy("a").agg(F.sum("docs").alias("docs")), size)
    first = F.shiftright("pair", 32).cast("int").alias("a")
    highest = np.maximum(regular, _vector(told.groupBy(first).agg(F.max("docs").alias("docs")), size))
    held = groups.select("gid", "docs", "nulls", "numbers", "digests", "regular", "pairs")
    linked = held.groupBy("gid").cogroup(told.select("gid", "slot", "pair", "docs").groupBy("gid")).applyInArrow(
        _link_rows(regular, highest), ALIGNED)
    spark = docs.sparkSession
    mapped = spark.createDataFrame([(int(a), int(words.identity[a]), int(regular[a])) for a in np.flatnonzero(regular)],
                                   "a int, b int, docs long")
    others = told.select(first, F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "docs").distinct()
    return linked, mapped.union(others)
