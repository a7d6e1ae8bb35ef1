"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both encodings agree.

A text of up to ``chunk`` characters is encoded as it is. A longer one is cut into chunks that reach ``overlap``
characters into both neighbours, so no task holds more than a chunk's pieces of it. In each overlap the two encodings
are aligned at a stable common boundary: a place where both start a token and that no merge can cross, because no piece
of the vocabulary holds the two characters beside it in this order. Merges on either side of such a place do not depend
on each other, so the tokens between two of them equal those of the whole text. Where an overlap has no such place (one
very long word), the text is done again with a doubled overlap, and chunks four times as long as that, until it aligns or
is one chunk.

Null texts are empty: no bytes, no tokens. Repeated rows count alike; the chunks of equal long texts are encoded once.
Null ids are kept. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, Window, functions as F

from shardloom.llm.common import arrow_schema, batch, id_and_text, staged, worker_state

CHUNK = 1 << 15
OVERLAP = 256
COUNTS = "doc_id long, n_bytes long, n_tokens long, text_key string"
CHUNKS = "text_key string, k int, last int, at long, width long, text string"
ALIGNED = ("text_key string, k int, last int, n_tokens long, left_at array<long>, left_n array<long>, "
           "right_at array<long>, right_n array<long>")


class Pieces:
    """A SentencePiece BPE model and the character pairs that its pieces hold."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        # Places are proven on the text itself, so a model that rewrites texts has none and long texts stay whole.
        probe = "A  a\nﬁＡ éé"
        self.plain = self.model.normalize(probe).replace("▁", " ").lstrip(" ") == probe

    @classmethod
    def of_worker(cls, path: str) -> "Pieces":
        return worker_state(f"pieces:{path}", lambda: cls(path))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def starts(self, text: str) -> np.ndarray:
        """The character at which each token starts."""
        found = self.model.encode(text, return_type="offset_mapping")
        spans = found["offsets"] if isinstance(found, dict) else found[1]
        return np.array([s[0] for s in spans], dtype=np.int64)

    def proven(self, text: str, at: int) -> bool:
        return self.plain and text[at - 1:at + 1].replace(" ", "▁") not in self.pairs


def _count_short(model: str):
    schema = arrow_schema(COUNTS)

    def run(batches):
        pieces = Pieces.of_worker(model)
        for rows in batches:
            texts, keys = rows.column("text").to_pylist(), rows.column("text_key").to_pylist()
            short = iter(pieces.counts([t for t, k in zip(texts, keys) if k is None]))
            yield batch(schema, [rows.column("doc_id"), rows.column("n_bytes"),
                                 [next(short) if k is None else None for k in keys], keys])
    return run


def _cut(chunk: int, overlap: int):
    schema = arrow_schema(CHUNKS)

    def run(batches):
        for rows in batches:
            for key, text in zip(rows.column("text_key"), rows.column("text")):
                key, text = key.as_py(), text.as_py()
                last = (len(text) - 1) // chunk
                for k in range(last + 1):
                    at = max(0, k * chunk - overlap)
                    part = text[at:(k + 1) * chunk + overlap]
                    yield batch(schema, [[key], [k], [last], [at], [len(part)], [part]])
    return run


def _align(model: str, chunk: int, overlap: int):
    schema = arrow_schema(ALIGNED)

    def zone(pieces, text, at, starts, cut):
        """Stable token starts around a cut, and how many tokens start before each."""
        places = np.unique(starts[(starts > max(at, cut - overlap)) & (starts < cut + overlap)])
        places = [int(p) for p in places if pieces.proven(text, int(p) - at)]
        return places, np.searchsorted(starts, places, side="left").tolist()

    def run(batches):
        pieces = Pieces.of_worker(model)
        for rows in batches:
            for row in rows.to_pylist():
                if not row["last"]:
                    n, left, right = pieces.counts([row["text"]])[0], ([], []), ([], [])
                else:
                    starts, k, at = pieces.starts(row["text"]) + row["at"], row["k"], row["at"]
                    n = len(starts)
                    left = zone(pieces, row["text"], at, starts, k * chunk) if k else ([], [])
                    right = zone(pieces, row["text"], at, starts, (k + 1) * chunk) if k < row["last"] else ([], [])
                yield batch(schema, [[row["text_key"]], [row["k"]], [row["last"]], [n], [left[0]], [left[1]],
                                     [right[0]], [right[1]]])
    return run


def splice(texts: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """(text_key, n_tokens) of long texts; n_tokens is null where some overlap has no stable common boundary."""
    dealt = texts.mapInArrow(_cut(chunk, overlap), CHUNKS).repartition("text_key", "k")
    aligned = dealt.mapInArrow(_align(model, chunk, overlap), ALIGNED)
    following = Window.partitionBy("text_key").orderBy("k")
    joined = aligned.withColumn("next_at", F.lead("left_at").over(following)).withColumn(
        "next_n", F.lead("left_n").over(following))
    place = F.array_min(F.array_intersect("right_at", "next_at"))
    upto = lambda places, counts: F.element_at(counts, F.array_position(places, F.col("place")).cast("int"))
    spliced = joined.withColumn("place", place).select(
        "text_key", F.when(F.col("k") == F.col("last"), F.col("n_tokens")).when(
            F.col("place").isNotNull(), upto(F.col("right_at"), F.col("right_n")) - upto(F.col("next_at"), F.col("next_n"))
        ).alias("part"))
    return spliced.groupBy("text_key").agg(
        F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    rows = id_and_text(docs, id_col, text_col).withColumn(
        "text_key", F.when(F.length("text") > chunk, F.sha2("text", 256)))
    counted = staged(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text_key",
                                 F.when(F.col("text_key").isNull(), F.col("text")).otherwise("").alias("text"))
                     .mapInArrow(_count_short(model), COUNTS), "counts")
    long_texts = rows.filter("text_key is not null").select("text_key", "text").dropDuplicates(["text_key"])
    done, left = [], long_texts
    while True:
        found = staged(splice(left, model, chunk, overlap), "spliced")
        done.append(found.filter("n_tokens is not null"))
        failed = found.filter("n_tokens is null").select("text_key")
        if failed.isEmpty():
            break
        left = long_texts.join(failed, "text_key", "left_semi")
        overlap *= 2
        chunk = max(chunk, 4 * overlap)
    counts = done[0]
    for more in done[1:]:
        counts = counts.union(more)
    short = counted.filter("text_key is null").select("doc_id", "n_bytes", "n_tokens")
    long = counted.filter("text_key is not null").drop("n_tokens").join(counts, "text_key")
    return short.union(long.select("doc_id", "n_bytes", "n_tokens"))
