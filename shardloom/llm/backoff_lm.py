"""Language-model scores by a weighted backoff automaton over corpus counts.

The model is a trigram model with Dirichlet smoothing towards bigrams, and those towards smoothed unigrams. As an
automaton: a state per counted pair of words, a state per word and one for the start of a text, and the root. With
``h`` the words of a state and ``g`` those without the first, a counted n-gram is an arc, weighted
``log10((c(h,w) + B p(w|g)) / (c(h) + B))``; any other word takes the failure arc of ``h``, weighted
``log10(B / (c(h) + B))``, to the state ``g``, and from there an arc or the next failure arc, down to the root, whose arcs
weigh ``log10 p(w)``. The weights out of a state sum to one over the vocabulary and one unknown word. A text is read once
from left to right: the state is the last two words, or the last one where the pair was never counted, and the weights of
the arcs taken add up.

Counts are corpus-wide, and neither they nor the automaton are ever in one place. Documents are read in groups of some
``GROUP`` bytes, a group being one packed row: its own vocabulary and its texts as numbers in it. Each group sends its
distinct n-grams, by 64-bit hash, with its own counts to ranges of the hash space (however frequent a word is, a group
sends it once). A range adds up and answers every group in the order in which it asked, so answers need no keys. Words
and pairs are asked for first, and answers say which pairs no other group holds: a trigram with such a pair in it is in no
other group either, so its own counts are whole and only the other trigrams are asked for, in a second round. A group
with its answers holds the part of the automaton that its own texts can reach, and scores them.

Words are split at ASCII white space after lower-casing A-Z; the end of a text is a token. Null texts are empty and have
that token alone. A null id counts as the empty text in the split into learning and held-out rows. Repeated rows count
and are scored each. Without learning rows every probability is that of the unknown word. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from shardloom.llm.common import arrow_schema, batch, id_and_text, staged

GROUP = 20 << 20
RANGE_TOKENS = 2_000_000  # tokens behind one range of the hash space
ADD = 0.1  # fixed value: what the base adds to each unigram count
PULL = 100.0, 5.0  # B: how many counts the shorter history weighs in a state of one word, of two
END, START = b"", b"\n"  # no word is empty or holds white space
GROUPS = "gid long, n_tokens long, n_train long, ids binary, nulls binary, held binary, sizes binary, stream binary, hashes binary"
ASKED = "range int, gid long, kind int, keys binary, counts binary"  # kind: words, pairs, trigrams
ANSWERS = "gid long, kind int, range int, types long, counts binary, alone binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")
MIX = np.uint64(0x9E3779B97F4A7C15)


def _packed(values: np.ndarray) -> bytes:
    return values.size.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), kind) if size else np.zeros(0, kind)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes as differences, bytes of equal weight together: the high ones are zero and compress."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _packed(steps.view(np.uint8).reshape(-1, 8).T.reshape(-1))


def _unpacked_keys(data: bytes) -> np.ndarray:
    planes = _unpacked(data, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, from those of their histories and last words."""
    with np.errstate(over="ignore"):
        mixed = (history * MIX) ^ word
        return (mixed ^ (mixed >> np.uint64(31))) * MIX


def _group_rows(batches):
    """Documents to packed groups."""
    schema = arrow_schema(GROUPS)
    part, made = TaskContext.get().partitionId(), 0

    def packed(ids, held, sizes, streams, vocabulary):
        sizes = np.array(sizes, dtype="<u4")
        held = np.array(held, dtype=np.uint8)
        nulls = np.array([i is None for i in ids], dtype=np.uint8)
        numbers = np.array([i or 0 for i in ids], dtype="<i8")
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), dtype="<u8", count=len(vocabulary))
        train = int(sizes[held == 0].sum())
        return batch(schema, [[(part << 32) + made], [int(sizes.sum())], [train], [_packed(numbers)], [nulls.tobytes()],
                              [held.tobytes()], [_packed(sizes)], [_packed(np.concatenate(streams))],
                              [hashes.tobytes()]])

    vocabulary, ids, held, sizes, streams, size = {END: 0, START: 1}, [], [], [], [], 0
    for rows in batches:
        for doc_id, out, text in zip(rows.column("doc_id"), rows.column("held"), rows.column("text")):
            found = text.as_py().encode().lower().split()
            number = [vocabulary.setdefault(w, len(vocabulary)) for w in found]
            number.append(0)
            streams.append(np.array(number, dtype="<u4"))
            ids.append(doc_id.as_py())
            held.append(out.as_py())
            sizes.append(len(number))
            size += len(text.as_buffer()) + 16
            if size >= GROUP:
                yield packed(ids, held, sizes, streams, vocabulary)
                made += 1
                vocabulary, ids, held, sizes, streams, size = {END: 0, START: 1}, [], [], [], [], 0
    if ids:
        yield packed(ids, held, sizes, streams, vocabulary)


class Group:
    """A packed group, with its n-grams in the order in which they are asked for."""

    def __init__(self, row: dict):
        self.hashes = np.frombuffer(row["hashes"], "<u8")
        self.sizes = _unpacked(row["sizes"], "<u4").astype(np.int64)
        self.stream = _unpacked(row["stream"], "<u4")
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.train = np.repeat(~self.held, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.states = np.empty_like(self.stream)
        self.states[1:] = self.stream[:-1]
        self.states[self.starts] = 1

    def unigrams(self):
        """Words by ascending hash, and the hashes."""
        order = np.argsort(self.hashes, kind="stable")
        return order, self.hashes[order]

    def bigrams(self):
        """Hashes of the distinct bigrams, ascending, and which of them each token ends."""
        pairs, which = np.unique(_mixed(self.hashes[self.states], self.hashes[self.stream]), return_inverse=True)
        return pairs, which.astype(np.int32)

    def trigrams(self, pairs: np.ndarray, which: np.ndarray):
        """Hashes of the distinct trigrams, ascending, the pairs that each begins and ends with, the tokens that end a
        trigram, and which one each of these ends. The first token of a text ends none."""
        inner = np.ones(len(self.stream), dtype=bool)
        inner[self.starts] = False
        at = np.flatnonzero(inner)
        triples, first, whose = np.unique(_mixed(pairs[which[at - 1]], self.hashes[self.stream[at]]), return_index=True,
                                          return_inverse=True)
        first = at[first]
        return triples, which[first - 1], which[first], at, whose.astype(np.int32)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _questions(schema, ranges: int, gid: int, kind: int, keys: np.ndarray, counts: np.ndarray):
    """A row per range that some of the ascending keys are in."""
    cuts = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[r], cuts[r + 1]
        yield batch(schema, [[r], [gid], [kind], [_packed_keys(keys[a:b])], [_packed(counts[a:b].astype("<u4"))]])


def _asker(ranges: int):
    """Groups to their questions about words and pairs."""
    schema = arrow_schema(ASKED)

    def run(batches):
        for rows in batches:
            for row in rows.to_pylist():
                group = Group(row)
                order, words = group.unigrams()
                counts = np.bincount(group.stream[group.train], minlength=len(order))[order]
                yield from _questions(schema, ranges, row["gid"], 0, words, counts)
                pairs, which = group.bigrams()
                yield from _questions(schema, ranges, row["gid"], 1, pairs,
                                      np.bincount(which[group.train], minlength=len(pairs)))
    return run


def _told(answers: pa.Table, column: str, kind: int, dtype: str) -> np.ndarray:
    """A group's answers of a kind, in the order in which it asked."""
    rows = sorted((r, i) for i, (k, r) in enumerate(zip(answers["kind"].to_pylist(), answers["range"].to_pylist()))
                  if k == kind)
    parts = [_unpacked(answers[column][i].as_py(), dtype) for _, i in rows]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _shared(alone: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which trigrams other groups may hold: those of two pairs that are not this group's alone."""
    return (alone[begin] == 0) & (alone[end] == 0)


def _second_asker(ranges: int):
    """Groups and which of their pairs are theirs alone, to their questions about trigrams."""
    schema = arrow_schema(ASKED)

    def run(key, groups, answers):
        if not groups.num_rows:
            return schema.empty_table()
        row = groups.to_pylist()[0]
        group = Group(row)
        pairs, which = group.bigrams()
        triples, begin, end, at, whose = group.trigrams(pairs, which)
        ask = _shared(_told(answers, "alone", 1, "u1"), begin, end)
        counts = np.bincount(whose[group.train[at]], minlength=len(triples))
        asked = list(_questions(schema, ranges, row["gid"], 2, triples[ask], counts[ask]))
        return pa.Table.from_batches(asked, schema)
    return run


def _answer(key, table):
    """Corpus counts of a range's n-grams, to every group in the order in which it asked."""
    schema = arrow_schema(ANSWERS)
    out = []
    for kind in (0, 1, 2):
        rows = table.filter(pa.compute.equal(table["kind"], kind))
        if not rows.num_rows:
            continue
        keys = [_unpacked_keys(k.as_py()) for k in rows["keys"]]
        counts = np.concatenate([_unpacked(c.as_py(), "<u4") for c in rows["counts"]])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(distinct)).astype("<u8")
        alone = (np.bincount(which) == 1).astype(np.uint8)
        at = 0
        for i, (gid, own) in enumerate(zip(rows["gid"].to_pylist(), keys)):
            # The range's types are told once.
            types = int((total > 0).sum()) if i == 0 else 0
            out.append((gid, kind, int(key[0].as_py()), types, _packed(total[which[at:at + len(own)]]),
                        _packed(alone[which[at:at + len(own)]])))
            at += len(own)
    return pa.Table.from_batches([batch(schema, [list(c) for c in zip(*out)])])


class Automaton:
    """The states and arcs that one group's texts can reach: words by number, pairs by theirs."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, tokens: int, types: int, starts: int):
        total = tokens + ADD * (types + 1)
        self.unigram = (words + ADD) / total
        self.root = np.log10(self.unigram)  # arcs of the root, by word
        self.context = words.astype(np.float64)
        self.context[1] = starts
        self.pairs = pairs  # counts of pairs: of arcs out of a word's state, and of the states of two words
        self.failure = np.log10(PULL[0] / (self.context + PULL[0]))  # by word's state
        self.pair_failure = np.log10(PULL[1] / (pairs + PULL[1]))  # by pair's state

    def run(self, group: Group, which: np.ndarray, at: np.ndarray, triples: np.ndarray) -> np.ndarray:
        """log10 of each token's probability, reading from left to right; ``triples`` counts the trigrams that the
        tokens ``at`` end. A token that its state has no arc for takes failure arcs, one after the other."""
        weight = np.zeros(len(group.stream))

        def by_pair(i):  # the arc's probability out of the state of the last word
            pull = PULL[0] * self.unigram[group.stream[i]]
            return (self.pairs[which[i]] + pull) / (self.context[group.states[i]] + PULL[0])

        # The state is the last two words. Of a pair that was not counted, the failure arc weighs nothing: no such state.
        hit = triples > 0
        i = at[hit]
        weight[i] = np.log10((triples[hit] + PULL[1] * by_pair(i)) / (self.pairs[which[i - 1]] + PULL[1]))
        failed = at[~hit]
        weight[failed] = self.pair_failure[which[failed - 1]]
        # The state is the last word: of those that failed, and at the start of a text.
        rest = np.sort(np.concatenate([failed, group.starts]))
        hit = self.pairs[which[rest]] > 0
        i = rest[hit]
        weight[i] += np.log10(by_pair(i))
        rest = rest[~hit]
        weight[rest] += self.failure[group.states[rest]] + self.root[group.stream[rest]]  # and on, from the root
        return weight


def _scorer(tokens: int, types: int, starts: int):
    schema = arrow_schema(SCORES)

    def run(key, groups, answers):
        if not groups.num_rows:
            return schema.empty_table()
        row = groups.to_pylist()[0]
        group = Group(row)
        order, _ = group.unigrams()
        pairs, which = group.bigrams()
        triples, begin, end, at, whose = group.trigrams(pairs, which)
        words = np.zeros(len(order), dtype=np.int64)
        words[order] = _told(answers, "counts", 0, "<u8")
        pair_counts = _told(answers, "counts", 1, "<u8").astype(np.float64)
        asked = _shared(_told(answers, "alone", 1, "u1"), begin, end)
        counts = np.bincount(whose[group.train[at]], minlength=len(triples)).astype(np.float64)
        counts[asked] = _told(answers, "counts", 2, "<u8")
        automaton = Automaton(words, pair_counts, tokens, types, starts)
        add = lambda values: np.add.reduceat(values, group.starts)
        seen = words[group.stream]
        ids = pa.array(_unpacked(row["ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
        return pa.Table.from_batches([batch(schema, [
            ids, group.held, group.sizes, add((seen > 0).astype(np.int64)), np.full(len(ids), tokens),
            add(automaton.root[group.stream]), add(automaton.run(group, which, at, counts[whose]))])])
    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row by counts over the rows that are not held out; ``held_out`` is over doc_id."""
    rows = id_and_text(docs, id_col, text_col)
    groups = staged(rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), "text")
                    .mapInArrow(_group_rows, GROUPS), "lm-groups")
    seen = groups.agg(F.sum("n_tokens").alias("all"), F.sum("n_train").alias("train")).first()
    ranges = max(1, -(-(seen["all"] or 0) // RANGE_TOKENS))
    asked = groups.mapInArrow(_asker(ranges), ASKED)
    answers = staged(asked.groupBy("range").applyInArrow(_answer, ANSWERS), "lm-answers")
    types = answers.filter("kind = 0").agg(F.sum("types").alias("n")).first().n or 0
    starts = rows.filter(~F.coalesce(held_out, F.lit(False))).count()
    alone = answers.filter("kind = 1").select("gid", "kind", "range", "alone")
    asked = groups.groupBy("gid").cogroup(alone.groupBy("gid")).applyInArrow(_second_asker(ranges), ASKED)
    triples = staged(asked.groupBy("range").applyInArrow(_answer, ANSWERS), "lm-trigrams")
    answers = answers.unionByName(triples.withColumn("alone", F.lit(b"")))
    return groups.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(
        _scorer(seen["train"] or 0, types, starts), SCORES)
