"""Ids of whole texts by the tokenizers library, with a memo of pieces.

Both kinds of public vocabularies split a text before any merge, and no split part crosses the place between a
non-space and a following space. A text is cut there, each distinct piece is encoded once by the library, and ids are
joined. The result equals encoding the whole text; tests compare the two.

Texts are cut and their pieces made distinct in Arrow, a step of texts at a time. Pieces have numbers, their ids lie one
behind the other in an array, and the ids of a step are gathered from there at once.
"""

from __future__ import annotations

import json
import re
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from shardloom.llm.common import Grown, ragged, single_threaded, sums, without_cycles, worker_state

# The code points with the Unicode property White_Space, as the body of a character class.
SPACES = "\t-\r \x85\xa0  -     　"
RUNS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
MEMO, MEMO_CHARS = 650_000, 32 << 20  # pieces and characters remembered by a worker, some 100 MB
STEP_BYTES = 3 << 20  # text encoded at a time
AT_ONCE = 4096  # pieces that the library gets at once: what it makes of a piece takes ten times the piece's ids


def cut_rule(path: str) -> str:
    """byte: pieces keep their leading space; word: white space is dropped; whole: no rule is known, do not cut."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    split = made.get("pre_tokenizer") or {}
    if made.get("normalizer") is None and split.get("type") == "ByteLevel":
        return "byte" if split.get("use_regex") and not split.get("add_prefix_space") else "whole"
    steps = split.get("pretokenizers") or [{}]
    drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    kinds = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
    return "word" if drops and kinds == ["NFC", "Replace", "Lowercase"] else "whole"


def strings(values: pa.Array) -> list[str]:
    """As to_pylist(), in a seventh of its time."""
    return values.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    def __init__(self, path: str):
        single_threaded()
        self.tokenizer = Tokenizer.from_file(path)
        self.rule = cut_rule(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[str, dict[str, int]] = {"": {}, " ": {}}  # as they are, and behind one space
        self.n = self.chars = 0
        self.ids, self.sizes, self.spaced = Grown(np.dtype("<u4")), Grown(np.int32), Grown(bool)
        self.again = Grown(bool)  # whether a piece came again since it was new or last kept

    @classmethod
    def of_worker(cls, path: str) -> "ChunkEncoder":
        return worker_state(f"chunk_encoder:{path}", lambda: cls(path))

    def library(self, pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def find(self, pieces: list[str], prefix: str = "") -> np.ndarray:
        """Numbers of distinct pieces; unknown ones go to the library, many at once."""
        known = self.pieces[prefix]
        numbers = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(numbers < 0)
        self.again.view[numbers[numbers >= 0]] = True
        for at in range(0, len(unknown), AT_ONCE):
            some = unknown[at:at + AT_ONCE]
            new = [pieces[i] for i in some.tolist()]
            numbers[some] = np.arange(self.n, self.n + len(new))
            known.update(zip(new, range(self.n, self.n + len(new))))
            ids = self.library([prefix + p for p in new] if prefix else new)
            sizes = np.fromiter(map(len, ids), np.int64, len(new))
            self.sizes.extend(sizes)
            self.ids.extend(np.fromiter(chain.from_iterable(ids), np.dtype("<u4"), int(sizes.sum())))
            # Where a piece ends with a white space (or a separator, which does no harm), or is none, the space behind it is
            # no place to cut at.
            self.spaced.extend([not p or p[-1].isspace() for p in new] if self.rule == "byte" else
                               np.zeros(len(new), bool))
            self.again.extend(np.zeros(len(new), bool))
            self.n += len(new)
            self.chars += sum(map(len, new))
        return numbers

    def trim(self) -> None:
        """Keep pieces that came again, those seen first before others, when there are too many. Most pieces come once."""
        if self.n <= MEMO and self.chars <= MEMO_CHARS:
            return
        keep = np.flatnonzero(self.again.view)[:MEMO // 2]
        kept, pieces = np.zeros(self.n, bool), {}
        kept[keep] = True
        for prefix, known in self.pieces.items():
            own = np.fromiter(known.values(), np.int64, len(known))
            stays = kept[own]
            pieces[prefix] = dict(zip(compress(known, stays.tolist()), np.searchsorted(keep, own[stays]).tolist()))
        chars = sum(len(p) for known in pieces.values() for p in known)
        sizes, spaced = self.sizes.view[keep], self.spaced.view[keep]
        ids = self.ids.view[ragged((np.cumsum(self.sizes.view) - self.sizes.view)[keep], sizes)]
        self.forget()
        if chars > MEMO_CHARS // 2:
            return
        self.pieces, self.n, self.chars = pieces, len(keep), chars
        for grown, kept in ((self.ids, ids), (self.sizes, sizes), (self.spaced, spaced), (self.again, np.zeros(len(keep), bool))):
            grown.extend(kept)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and how many each text has."""
        if self.rule == "whole":
            distinct = texts.dictionary_encode()
            return self.find(strings(distinct.dictionary))[distinct.indices.to_numpy(zero_copy_only=False)], np.ones(len(texts), int)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " ") if self.rule == "word" else texts, " ")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        words, codes = strings(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        if self.rule == "word":
            return self.find(words)[codes], sizes
        ends = np.cumsum(sizes)
        first = np.zeros(len(codes), bool)
        first[ends - sizes] = True
        last = np.zeros(len(codes), bool)
        last[ends - 1] = True
        slots = np.empty(len(codes), np.int64)
        for here, prefix in ((first, ""), (~first, " ")):
            used = np.flatnonzero(np.bincount(codes[here], minlength=len(words)))
            number = np.zeros(len(words), np.int64)
            number[used] = self.find([words[i] for i in used.tolist()], prefix)
            slots[here] = number[codes[here]]
        other = np.flatnonzero(sums(self.spaced.view[slots] & ~last, sizes))
        if len(other):
            runs = np.split(slots, ends[:-1])
            for i in other.tolist():
                found = RUNS.findall(texts[i].as_py())
                distinct = list(dict.fromkeys(found))
                numbers = dict(zip(distinct, self.find(distinct).tolist()))
                runs[i] = np.array([numbers[p] for p in found], np.int64)
            slots, sizes = np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))
        return slots, sizes

    def encode_array(self, texts: pa.Array, end_id: int | None = None, width: int = 4) -> tuple[pa.Array, np.ndarray]:
        """Ids of each text, and ``end_id`` behind them, as little-endian unsigned integers of ``width`` bytes; and their number."""
        self.trim()
        with without_cycles():
            slots, pieces = self.cut(texts)
        lengths = self.sizes.view[slots]
        begins = (np.cumsum(self.sizes.view) - self.sizes.view)[slots]
        ids, sizes = self.ids.view[ragged(begins, lengths)], sums(lengths, pieces)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
        offsets = np.concatenate([[0], np.cumsum(sizes) * width]).astype(np.int64)
        data = pa.Array.from_buffers(pa.large_binary(), len(texts), [
            None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{width}"))])
        return data.cast(pa.binary()), sizes

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_array(pa.array([text], pa.string()))[0][0].as_py()
