"""Benchmark decontamination by a distributed positional inverted index of the documents' words.

Documents are indexed in shards of some ``SHARD_WORDS`` words. A shard's documents lie one behind the other, ``GAP``
places apart, and for each word of theirs the index has a row with its places in ascending order (as differences, unsigned
32-bit integers). All words of whole texts are indexed; another row per shard holds the documents' ids, starts and sizes.

Windows of the test items are looked up by their words' frequency in the whole index. A window is sent to the shards that
hold its rarest word and nowhere else. There the list of that word, less the word's place in the window, gives the starts
that are possible; the lists of the other words, from rare to frequent, are intersected with these by binary search, each
shifted by its own place. What is left are exact phrases. A proximity match has the rarest word exactly in its place and
each other one at most ``slop`` places from its own. Windows with a word that no document holds match nothing.

A shard is the unit of work however often one word or passage occurs, and its size is bounded by ``SHARD_WORDS`` or its
longest document. Lists of words that no window needs are not read from the index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null and empty texts have no words and are not
hit. Documents with one id, or none, are rows of their own each. An item without words has no window; items that share an
id count once; a null item id is shown as the empty text. Without documents there are no rows, and without items no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shardloom.llm.common import arrow_schema, batch, id_and_text, staged

SHARD_WORDS = 4_000_000
GAP = 16  # places between documents; a proximity match that crossed them would need a slop of 8
BROADCAST_BYTES = 16 << 20  # words, or windows of items, up to which a side of a join is sent to all tasks
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper()
                   else 0x20 for b in range(256))
INDEX = "shard long, term string, tf long, places binary, doc_ids binary, nulls binary, starts binary, sizes binary"
FOUND = ("shard long, ordinal long, doc_id long, n_words long, n_hit long, n_near long, windows array<long>, "
         "spans array<long>")


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all the texts, one behind the other, and how many each text has."""
    texts = pa.concat_arrays([texts.cast(pa.string())])
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(WORD_BYTES))
    parts = pc.split_pattern(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, plain], offset=texts.offset), " ")
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py()
    kept = codes != empty
    upto = np.concatenate([[0], np.cumsum(kept)])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
    return pa.DictionaryArray.from_arrays(pa.array(codes[kept], pa.int32()), coded.dictionary), np.diff(upto[ends])


class Shard:
    def __init__(self, number: int):
        self.number, self.words, self.sizes, self.ids, self.total = number, [], [], [], 0

    def add(self, ids: pa.Array, words: pa.DictionaryArray, sizes: np.ndarray) -> None:
        self.ids.append(ids)
        self.words.append(words)
        self.sizes.append(sizes)
        self.total += len(words)

    def rows(self, schema: pa.Schema, step: int = 50_000):
        sizes, ids = np.concatenate(self.sizes), pa.concat_arrays(self.ids)
        starts = np.cumsum(sizes + GAP) - sizes - GAP
        unified = pa.chunked_array(self.words).unify_dictionaries()
        codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in unified.chunks])
        terms = unified.chunk(0).dictionary
        places = (np.arange(len(codes)) + np.repeat(np.arange(len(sizes)) * GAP, sizes)).astype("<u4")
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes, minlength=len(terms))
        ends = np.cumsum(counts)
        lists = places[order]
        steps = np.diff(lists, prepend=np.uint32(0))
        firsts = (ends - counts)[counts > 0]
        steps[firsts] = lists[firsts]
        packed = pa.Array.from_buffers(pa.large_binary(), len(terms), [
            None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype("<i8")), pa.py_buffer(steps)])
        used = pa.array(counts > 0)
        terms, packed, counts = terms.filter(used), packed.filter(used), counts[counts > 0]
        none = lambda n: pa.nulls(n, pa.binary())
        for at in range(0, len(terms), step):
            n = min(step, len(terms) - at)
            yield batch(schema, [np.full(n, self.number), terms[at:at + n], counts[at:at + n],
                                 packed[at:at + n].cast(pa.binary()), none(n), none(n), none(n), none(n)])
        nulls = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        yield batch(schema, [[self.number], [None], [None], [None], [keys.tobytes()], [nulls.tobytes()],
                             [starts.astype("<i8").tobytes()], [sizes.astype("<i8").tobytes()]])


def _indexer(shard_words: int):
    schema = arrow_schema(INDEX)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        shard = Shard(number)
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                shard.add(part.column("doc_id"), *words_of(part.column("text")))
                if shard.total >= shard_words:
                    yield from shard.rows(schema)
                    number += 1
                    shard = Shard(number)
        if shard.sizes:
            yield from shard.rows(schema)
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shard_words: int = SHARD_WORDS) -> DataFrame:
    """The positional index of all words of all texts, written to the shared folder."""
    return staged(id_and_text(docs, id_col, text_col).mapInArrow(_indexer(shard_words), INDEX), "word-index")


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words) of every window of every item; a shorter item is one window."""
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), NO_WORD), lambda w: w != "")
    listed = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("words"))
    last = F.greatest(F.size("words") - window, F.lit(0))
    return listed.filter(F.size("words") > 0).select("item", F.explode(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, window))).alias("words"))


def _small(df: DataFrame, size) -> DataFrame:
    """Marked for broadcast when its bytes, counted, are within the bound."""
    bytes_held = df.agg(F.sum(size + F.lit(16)).alias("b")).first().b or 0
    return F.broadcast(df) if bytes_held <= BROADCAST_BYTES else df


def plan_windows(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, places, terms): the distinct windows whose words all occur, each from its rarest word on."""
    spread = windows.select("window_id", F.posexplode("words").alias("place", "term"))
    terms = staged(spread.select("term").distinct(), "terms")
    counts = index.filter("term is not null").select("term", "tf").join(_small(terms, F.octet_length("term")), "term")
    totals = counts.groupBy("term").agg(F.sum("tf").alias("tf"))
    ranked = spread.join(totals, "term").groupBy("window_id").agg(
        F.array_sort(F.collect_list(F.struct("tf", "place", "term"))).alias("ranked"))
    whole = ranked.join(windows.select("window_id", F.size("words").alias("n")), "window_id")
    return staged(whole.filter(F.size("ranked") == F.col("n")).select(
        "window_id", F.col("ranked.place").alias("places"), F.col("ranked.term").alias("terms")), "windows")


class Postings:
    """The lists of one shard, decoded when they are first asked for."""

    def __init__(self, left: pa.Table):
        self.packed = dict(zip(left.column("term").to_pylist(), left.column("places")))
        self.lists: dict[str, np.ndarray] = {}

    def __getitem__(self, term: str) -> np.ndarray:
        if term not in self.lists:
            held = self.packed.get(term)
            steps = np.zeros(0, "<u4") if held is None else np.frombuffer(held.as_buffer(), "<u4")
            self.lists[term] = np.cumsum(steps, dtype=np.int64)
        return self.lists[term]


def within(places: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of the wanted places have one of the list at most ``slop`` away."""
    at = np.searchsorted(places, wanted - slop)
    inside = at < len(places)
    return inside & (places[np.minimum(at, len(places) - 1)] <= wanted + slop) if len(places) else inside


def window_starts(postings: Postings, places: list[int], terms: list[str], slop: int) -> np.ndarray:
    """Starts of a window in a shard, its words given from the rarest on."""
    starts = postings[terms[0]] - places[0]
    for place, term in zip(places[1:], terms[1:]):
        if not len(starts):
            break
        starts = starts[within(postings[term], starts + place, slop)]
    return starts


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans, in order of their starts, with those that overlap or touch as one."""
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    lasts = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return a[new], reach[lasts]


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values, ordered by owner, as one list for each of n owners."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _searcher(slop: int):
    schema = arrow_schema(FOUND)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = left.filter(pc.is_null(left.column("term")))
        if not held.num_rows:
            return schema.empty_table()
        read = lambda name, kind: np.frombuffer(held.column(name)[0].as_buffer(), kind)
        ids, nulls, starts, sizes = (read(*c) for c in (("doc_ids", "<i8"), ("nulls", "u1"), ("starts", "<i8"), ("sizes", "<i8")))
        n, postings = len(ids), Postings(left.filter(pc.is_valid(left.column("term"))))
        at, length, window, near = [], [], [], []
        for row in right.select(["window_id", "places", "terms"]).to_pylist():
            loose = window_starts(postings, row["places"], row["terms"], slop)
            if not len(loose):
                continue
            near.append(np.unique(np.searchsorted(starts, loose + row["places"][0], side="right") - 1))
            exact = loose if not slop else window_starts(postings, row["places"], row["terms"], 0)
            at.append(exact)
            length.append(np.full(len(exact), len(row["terms"])))
            window.append(np.full(len(exact), row["window_id"]))
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        at, length, window, near = map(flat, (at, length, window, near))
        order = np.argsort(at, kind="stable")
        at, length, window = at[order], length[order], window[order]
        doc = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(np.stack([doc, window], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        a, b = _joined(at, at + length) if len(at) else (at, at)
        owner = np.searchsorted(starts, a, side="right") - 1
        hit = np.bincount(owner, weights=b - a, minlength=n).astype(np.int64)
        spans = np.stack([a - starts[owner], b - starts[owner]], axis=1).ravel()
        shard = held.column("shard")[0].as_py()
        return pa.Table.from_batches([batch(schema, [
            np.full(n, shard), np.arange(n), pa.array(ids, pa.int64(), mask=nulls.astype(bool)), sizes, hit,
            np.bincount(near, minlength=n), _lists(pairs[:, 0], pairs[:, 1], n), _lists(np.repeat(owner, 2), spans, n)])])
    return run


def search(index: DataFrame, planned: DataFrame, slop: int = 0) -> DataFrame:
    """A row per document: ids of the windows that occur in it, and the spans of its words that they cover (starts and
    ends, end exclusive); n_near counts the windows that match by proximity, exact ones included."""
    if not 0 <= 2 * slop < GAP:
        raise ValueError(f"slop must be below {GAP // 2}")
    terms = staged(planned.select(F.explode("terms").alias("term")).distinct(), "terms")
    rows = index.filter("term is not null")
    needed = rows.join(_small(terms, F.octet_length("term")), "term").select("shard", "term", "places")
    rarest = planned.withColumn("term", F.element_at("terms", 1))
    size = F.aggregate("terms", F.lit(0), lambda n, t: n + F.octet_length(t))
    # Under names of its own: both sides of the search come from the index.
    holders = rows.select(F.col("shard").alias("held_by"), F.col("term").alias("rare"))
    tests = holders.join(_small(rarest.withColumnRenamed("term", "rare"), size), "rare").select(
        F.col("held_by").alias("shard"), "window_id", "places", "terms")
    docs = index.filter("term is null").select("shard", "term", "places", "doc_ids", "nulls", "starts", "sizes")
    left = docs.unionByName(needed, allowMissingColumns=True)
    return left.groupBy("shard").cogroup(tests.groupBy("shard")).applyInArrow(_searcher(slop), FOUND)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 2, id_col: str = "doc_id",
                  text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids, as text), spans (of hit words) and n_near of every document."""
    listed = staged(item_windows(items, window), "item-windows")
    distinct = staged(listed.groupBy("words").agg(F.lit(1)).select("words"), "distinct")
    windows = staged(distinct.select(F.monotonically_increasing_id().alias("window_id"), "words"), "windows")
    owners = staged(listed.join(windows, "words").select("window_id", "item").distinct(), "owners")
    index = build_index(docs, id_col, text_col, shard_words)
    found = staged(search(index, plan_windows(index, windows), slop), "found")
    hit = found.filter(F.size("windows") > 0).select("shard", "ordinal", F.explode("windows").alias("window_id"))
    named = hit.join(_small(owners, F.octet_length("item")), "window_id").groupBy("shard", "ordinal").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    return found.join(named, ["shard", "ordinal"], "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", "n_near")


# The same for ``documents`` and ``benchmark`` in SQL: n-grams of documents beside those of items.
ORACLE = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents),
item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark),
windows AS (SELECT DISTINCT item, w[i:i + 9] AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
    FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(gram) AS n FROM windows),
grams AS (SELECT r, i, n, w[i:i + n - 1] AS gram FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT g.r, g.i, g.n FROM grams g JOIN windows USING (gram)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT g.r, item FROM grams g JOIN windows USING (gram)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
