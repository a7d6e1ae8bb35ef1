"""Winnowed fingerprints of texts. DataFrame functions only.

A k-gram is ``k`` words in a row (a shorter text is one gram). Of every ``window`` grams in a row the least hash is kept,
of equal ones the rightmost, with its position. So two texts that share ``window + k - 1`` words in a row share a
fingerprint, and none is kept twice for overlapping windows. A kept gram is one long: 33 bits of hash above 30 bits of
position counted from the right, so that the least long is the least hash and then the rightmost gram; 2^30 words is more
than the longest string that a row can hold.

A null text is empty; an empty text has an empty fingerprint, which is like another empty one (1) and unlike any other
(0). A null id counts as the least long, first in order. Rows that share an id have the same next document, and of
several rows of the next id the one with the least text hash. Equal texts have equal fingerprints. A
table of one row is followed by itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shardloom.llm.common import ASCII_SPACE, range_bounds, range_of, staged

K = 5
WINDOW = 16
RANGE_ROWS = 5000  # rows of a range of ids
POSITIONS = (1 << 30) - 1
NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{ASCII_SPACE}]+"), lambda w: w != F.lit(""))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Kept grams, by position."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def grams(h):
        last = F.greatest(F.size(h) - F.lit(k), F.lit(0))
        gram = lambda i: F.xxhash64(*[F.get(h, i + F.lit(j)) for j in range(k)])
        packed = lambda i: F.shiftleft(gram(i).bitwiseAND(F.lit((1 << 33) - 1)), 30).bitwiseOR(
            F.lit(POSITIONS).cast("long") - i)
        return F.transform(F.sequence(F.lit(0), last), packed)

    def least(g):
        last = F.greatest(F.size(g) - F.lit(window), F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_min(F.slice(g, i + F.lit(1), F.lit(window)))))

    # A transform over an array of one evaluates its element once, however often it is used.
    once = lambda column, f: F.element_at(F.transform(F.array(column), f), 1)
    kept = once(hashed, lambda h: F.when(F.size(h) > 0, once(grams(h), least)))
    return F.coalesce(kept, F.array().cast("array<bigint>"))


def written(kept: Column) -> Column:
    """The fingerprint as text: hash in hex, position of the gram's first word."""
    return F.array_join(F.transform(kept, lambda x: F.concat(
        F.lower(F.hex(F.shiftright(x, 30))), F.lit(":"),
        (F.lit(POSITIONS) - x.bitwiseAND(F.lit(POSITIONS))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the kept hashes."""
    hashes = lambda kept: F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 30)))
    both = F.size(F.array_intersect(hashes(a), hashes(b)))
    either = F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def bucket_edges(rows: DataFrame, bucket: Column, k: int, window: int) -> DataFrame:
    """Per bucket: the text and the kept grams of the first row of the next bucket (of the last: the first)."""
    across = Window.orderBy("bucket")
    least = staged(rows.select("key", bucket.alias("bucket")).groupBy("bucket").agg(F.min("key").alias("least")), "least")
    links = least.select("bucket", F.coalesce(F.lead("least").over(across), F.first("least").over(
        across.rowsBetween(Window.unboundedPreceding, 0))).alias("edge_key"))
    # A key per bucket.
    keys = F.broadcast(links.select(F.col("edge_key").alias("key")).distinct())
    texts = rows.join(keys, "key").groupBy("key").agg(F.min_by("text", F.xxhash64("text")).alias("edge_text"))
    return links.join(texts, F.col("edge_key") == F.col("key")).select(
        "bucket", "edge_text", fingerprint(F.col("edge_text"), k, window).alias("edge_kept"))


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Per row: its fingerprint, and those of its text with the second half replaced by the next document's start.

    Texts are shuffled once, into ranges of ids; the next document is the next row there, or an edge between ranges.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = range_bounds(rows, "key", -(-rows.count() // RANGE_ROWS))
    bucket = range_of(F.col("key"), bounds)
    dealt = rows.withColumn("bucket", bucket).repartition("bucket").select(
        "bucket", "key", "text", F.xxhash64("text").alias("text_hash"),
        fingerprint(F.col("text"), k, window).alias("kept"))
    order = Window.partitionBy("bucket").orderBy("key", "text_hash")
    # The first row of each key stands for it; the next such row is the next document.
    first = F.coalesce(F.lag("key").over(order) != F.col("key"), F.lit(True))
    marked = dealt.withColumn("first", F.when(first, F.struct("text", "kept")))
    ahead = F.expr("lead(first) IGNORE NULLS OVER (PARTITION BY bucket ORDER BY key, text_hash)")
    both = marked.withColumn("ahead", ahead).join(bucket_edges(rows, bucket, k, window), "bucket").select(
        "key", "text", "text_hash", "kept", F.length("text").alias("n"),
        F.coalesce("ahead.text", "edge_text").alias("next"),
        F.when(F.col("ahead").isNull(), F.col("edge_kept")).otherwise(F.col("ahead.kept")).alias("next_kept"))
    edited = both.withColumn("edited", F.concat(F.expr("substring(text, 1, n - n div 2)"),
                                                F.expr("substring(next, 1, n div 2)")))
    done = edited.withColumn("edited_kept", fingerprint(F.col("edited"), k, window))
    return done.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), written(F.col("kept")).alias("fingerprint"),
        written(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"), "text_hash")
