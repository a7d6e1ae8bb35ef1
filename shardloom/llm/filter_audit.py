"""Filter interaction audit by decision diagrams of failure masks.

Each document has a mask with a bit per filter that it fails. A part's diagram branches on one filter per level, its leaves
are the masks' weights (documents, good ones, toxic ones), and each node knows the weight below it. Equal subtrees are one
node. All orders of the filters are visited by swapping adjacent levels, two neighbouring orders differing by one swap; a
swap makes anew the nodes of its two levels and of those above, and everything below stays. In each order the path on which
every filter is passed has the steps: what fails at a level is removed there, what passes is kept.

Masks are made in one pass over the texts; texts are compared by their SHA-256, so what is shuffled is some 50 bytes a
document. Rows of one id and text, and then all copies of a text, are combined before each shuffle, so a text or an id may
hold any share of the rows. Diagrams are made of at most 2^filters numbers a part.

A null text is empty, a null part is the empty one. A document without an id is no copy of another and has no label; a row
is a copy only of rows with a smaller id, so rows that share an id and a text aren't copies of each other. Several labels of
one id count as the highest of each. An empty table has no parts.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shardloom.llm.common import arrow_schema, batch, staged

FILTERS = "ABCDE"
COPY = FILTERS.index("E")  # the filter that needs the whole table
MARKS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that start no code point
MASKS = "doc_id long, part string, mask int, digest binary"
STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def text_mask(text: bytes) -> int:
    """Bits of the filters that a text alone decides, A first."""
    words = text.split()  # bytes are split at ASCII white space alone
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, CONTINUED)))
    upper = len(text) - len(text.translate(None, UPPER))
    return ((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * points) << 2
            | (len(text.translate(None, MARKS)) < len(text)) << 3)


def _mask_rows(batches):
    schema = arrow_schema(MASKS)
    for rows in batches:
        texts = [t.as_py() for t in rows.column("text")]
        yield batch(schema, [rows.column("doc_id"), rows.column("part"), list(map(text_mask, texts)),
                             [hashlib.sha256(t).digest() for t in texts]])


def mask_counts(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic), copies marked table-wide."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part_col, F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    masks = staged(read.mapInArrow(_mask_rows, MASKS), "masks")
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks.filter("doc_id is not null").groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    weigh = lambda c: (F.col("n") * F.coalesce(c, F.lit(0))).cast("long").alias(c)
    weighed = rows.join(marked, "doc_id", "left").select("doc_id", "part", "mask", "digest", "n", weigh("good"), weigh("toxic"))
    # Of each text in a part: all rows, and those of its least id there.
    least = F.min(F.struct("doc_id", F.struct("n", "good", "toxic").alias("w")))
    texts = weighed.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")], least.alias("least"))
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))  # a row per part
    own = lambda c: F.when(F.col("first"), F.col(f"least.w.{c}")).otherwise(0)
    copied = F.col("mask").bitwiseOR(F.lit(1 << COPY))
    split = texts.withColumn("first", first).select("part", F.explode(F.array(
        F.struct(F.col("mask"), *[own(c).alias(c) for c in ("n", "good", "toxic")]),
        F.struct(copied.alias("mask"), *[(F.col(c) - own(c)).alias(c) for c in ("n", "good", "toxic")]))).alias("s"))
    unnamed = masks.filter("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select(
        "part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return split.select("part", "s.mask", "s.n", "s.good", "s.toxic").union(unnamed).groupBy("part", "mask").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).filter("n > 0")


def adjacent_swaps(n: int):
    """Levels to swap, one after another, so that all orders of n are visited once."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


class Diagram:
    """A node is a number: its two nodes below (passed, failed), or a leaf's weight."""

    def __init__(self, weights: dict[int, tuple[int, ...]], n: int):
        self.n, self.nodes, self.known, self.weight = n, [], {}, []
        zero = (0,) * len(next(iter(weights.values()), ()))
        level = [self.make(None, weights.get(mask, zero)) for mask in range(1 << n)]
        # Level 0 is asked first and is the lowest bit; the last bit's pairs are joined first.
        for _ in range(n):
            half = len(level) // 2
            level = [self.make(level[i], level[half + i]) for i in range(half)]
        self.root = level[0]

    def make(self, passed, failed) -> int:
        key = (passed, failed)
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
            self.weight.append(failed if passed is None else
                               tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed])))
        return self.known[key]

    def swap(self, level: int) -> None:
        done: dict[int, int] = {}

        def made(node: int, depth: int) -> int:
            if node not in done:
                passed, failed = self.nodes[node]
                if depth < level:
                    done[node] = self.make(made(passed, depth + 1), made(failed, depth + 1))
                else:
                    (a, b), (c, d) = self.nodes[passed], self.nodes[failed]
                    done[node] = self.make(self.make(a, c), self.make(b, d))
            return done[node]

        self.root = made(self.root, 0)

    def steps(self):
        """(kept, removed) weights along the path on which all is passed."""
        node = self.root
        for _ in range(self.n):
            node, failed = self.nodes[node]
            yield self.weight[node], self.weight[failed]


def audit_part(weights: dict[int, tuple[int, int, int]], names: str = FILTERS):
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    diagram, order = Diagram(weights, len(names)), list(range(len(names)))
    fails = [sum(w[0] for mask, w in weights.items() if mask >> f & 1) for f in order]
    alone = [weights.get(1 << f, (0,))[0] for f in order]
    rows, removed_by = [], [0] * len(names)
    swaps = adjacent_swaps(len(names))
    while True:
        for step, (f, (kept, removed)) in enumerate(zip(order, diagram.steps()), 1):
            removed_by[f] += removed[0]
            rows.append(("".join(names[i] for i in order), step, f, kept[0], *removed))
        at = next(swaps, None)
        if at is None:
            break
        diagram.swap(at)
        order[at], order[at + 1] = order[at + 1], order[at]
    return [(o, step, kept, removed, fails[f] - removed, alone[f], good, toxic, removed_by[f])
            for o, step, f, kept, removed, good, toxic in rows]


def _audit_rows(names: str):
    schema = arrow_schema(STEPS)

    def run(batches):
        for rows in batches:
            for part, held in zip(rows.column("part").to_pylist(), rows.column("held").to_pylist()):
                found = audit_part({h["mask"]: (h["n"], h["good"], h["toxic"]) for h in held}, names)
                yield batch(schema, [[part] * len(found), *map(list, zip(*found))])
    return run


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every order and step of every part, out of (part, mask, n, good, toxic)."""
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    return held.mapInArrow(_audit_rows(names), STEPS)


def oracle() -> str:
    """The same for ``documents`` and ``labels`` in SQL, by masks and arithmetic on them."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
masks AS (SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM words),
marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM masks LEFT JOIN marked USING (doc_id) GROUP BY part, mask),
steps AS (SELECT o.filter_order, s.step, (1 << (instr('{FILTERS}', substr(o.filter_order, s.step, 1)) - 1)) AS bit,
    (SELECT coalesce(sum(1 << (instr('{FILTERS}', substr(o.filter_order, e.k, 1)) - 1)), 0)
     FROM (VALUES (1), (2), (3), (4), (5)) e(k) WHERE e.k < s.step)::INTEGER AS earlier
    FROM (VALUES {orders}) o(filter_order), (VALUES (1), (2), (3), (4), (5)) s(step)),
told AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
    redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM told"""
