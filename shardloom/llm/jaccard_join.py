"""Exact Jaccard join of word-shingle sets by trees over count vectors, and its components.

* Sets. A text's set holds the 64-bit hashes of its ``k``-word shingles (a shorter text is one shingle); equal sets are
  one point from then on, so copies never meet each other.
* Keys. A pair above the threshold shares one of the first ``n - ceil(t n) + 1`` members of each set in any order that is
  the same for all sets. The order is rarest first, by corpus-wide counts of hashed shingles, so passages that many
  documents share come last. Points that share a key are a leaf group of the index; others never meet.
  Of keys that exactly the same points share, one is kept.
* Points. Shingles are hashed into groups, one or two shingles a group on average; the counts are a point, and the sum of
  coordinate minima bounds the overlap of two sets. The number of groups is a power of two that follows the set's size
  class, and a point with twice the groups folds onto the other. Within a key, an R-tree over the points is joined with itself; a node pair whose summed minima of
  upper corners cannot reach the overlap that the smallest sizes need is left out.
* Verification. Surviving pairs are compared on their whole sets, which are made again from the texts they need.

A key may hold a third of all points. So pairs are found in two rounds. Round one compares each point of a crowded key
with ``HUBS`` others, which are the same for all the points that share its keys, and joins what is verified into
components. Round two looks, within all keys that hold several components, only for pairs across components; nodes of one
component are not compared. Long keys are cut into blocks by set size, and blocks meet in pairs unless their sizes or components rule them out. No link
between different components is lost, none within one is needed.

Null and empty texts have an empty set, are linked with nothing, and are their own component. Equal texts are linked.
Repeated rows are kept; a null id is never the least of a component unless all its ids are null. An empty table gives no
rows. Sets are told apart by a 64-bit hash of their members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from shardloom.llm.common import arrow_schema, batch, discard, drop_worker_state, id_and_text, staged, staged_alone

LEVEL_BITS = 20  # 2^20 counters order the shingles
SLICE = 1 << 12  # counters in one row
FAN = 16  # entries of a tree node
CROWD = 8  # points of a key from which round one takes part; smaller keys have few pairs
HUBS = 16
REPEATED = 64  # points of a key from which a pair is told only by the least key that it shares
BLOCK = 2048  # points of a key that one task holds twice at most
BOUND_BYTES = 16 << 20  # of points whose minima are taken at once
MEMO = 1_000_000  # word hashes that a task remembers
SEND_IDS = 2_000_000  # ids (8 bytes each) broadcast to pick texts; beyond, a join by id
FEW_BITS = 20  # a key that fewer than 2^20 shingles can be is dealt once, so its postings take some 25 MB in one task
POINTS = "set_id long, n int, counts binary, keys array<long>, few int"
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str, k: int, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, unsigned."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, count=len(words))
    width = min(k, len(words))
    with np.errstate(over="ignore"):
        made = np.full(len(words) - width + 1, width, np.uint64)
        for j in range(width):
            made = (made ^ hashes[j:len(words) - width + 1 + j]) * MIX
            made ^= made >> np.uint64(32)
        made *= STEP
    return np.unique(made ^ (made >> np.uint64(29)))


def set_id(members: np.ndarray) -> int | None:
    return int(np.array(xxhash.xxh3_64_intdigest(members.tobytes()), np.uint64).astype(np.int64)) if len(members) else None


def group_counts(members: np.ndarray) -> np.ndarray:
    """The point of a set: as many groups as its size class has, but eight at least."""
    groups = 1 << max(3, len(members).bit_length() - 1)
    counts = np.bincount((members & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    if counts.max(initial=0) > 0xFF:
        raise ValueError("a group of a point is out of range")
    return counts.astype(np.uint8)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Points (in rows) with fewer groups: what agrees in its lower bits meets."""
    if counts.shape[-1] == groups:
        return counts
    return counts.reshape(*counts.shape[:-1], -1, groups).sum(axis=-2, dtype=np.uint16)


def least_overlap(a, b, percent: int):
    """Members that two sets of these sizes must share: J >= t exactly if (100 + t) * overlap >= t * (a + b)."""
    return -(-percent * (a + b) // (100 + percent))


def _describe(k: int):
    """A row per document, and the task's shingle counts in slices."""
    schema = arrow_schema("doc_id long, n int, set_id long, slice int, counts binary")

    def run(batches):
        drop_worker_state()
        memo, seen = _Hashes(), np.zeros(1 << LEVEL_BITS, np.int64)
        for rows in batches:
            out = []
            for key, text in zip(rows.column("doc_id"), rows.column("text")):
                members = shingle_set(text.as_py(), k, memo)
                np.add.at(seen, (members >> np.uint64(64 - LEVEL_BITS)).astype(np.int64), 1)
                out.append((key.as_py(), len(members), set_id(members), None, None))
            yield batch(schema, [list(c) for c in zip(*out)] if out else [[]] * 5)
        for s in np.flatnonzero(seen.reshape(-1, SLICE).any(axis=1)):
            blob = pa.compress(seen.reshape(-1, SLICE)[s].astype("<i8").tobytes(), "zstd", asbytes=True)
            yield batch(schema, [[None], [None], [None], [s], [blob]])
    return run


def _added(key, table):
    total = np.zeros(SLICE, np.int64)
    for blob in table["counts"]:
        total += np.frombuffer(pa.decompress(blob.as_py(), SLICE * 8, "zstd", asbytes=True), "<i8")
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()),
                     "counts": [pa.compress(total.tobytes(), "zstd", asbytes=True)]})


def shingle_levels(described: DataFrame) -> np.ndarray:
    """log2 of the corpus-wide count of each hashed shingle: 2^LEVEL_BITS bytes whatever the size of the corpus."""
    rows = described.filter("slice is not null").select("slice", "counts")
    # Two steps, so that a task adds up some thousand rows, not one from every task before it.
    some = rows.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(64))).groupBy("slice", "part").applyInArrow(
        _added, "slice int, counts binary")
    levels = np.zeros((1 << LEVEL_BITS) // SLICE * SLICE, np.uint8).reshape(-1, SLICE)
    for row in some.groupBy("slice").applyInArrow(_added, "slice int, counts binary").collect():
        counts = np.frombuffer(pa.decompress(bytes(row.counts), SLICE * 8, "zstd", asbytes=True), "<i8")
        levels[row.slice] = np.ceil(np.log2(counts + 1)).astype(np.uint8)
    return levels.reshape(-1)


def _locate(k: int, percent: int, levels):
    schema = arrow_schema(POINTS)

    def run(batches):
        drop_worker_state()
        memo, done, level = _Hashes(), set(), levels.value
        for rows in batches:
            out = []
            for text in rows.column("text"):
                members = shingle_set(text.as_py(), k, memo)
                n, name = len(members), set_id(members)
                if name is None or name in done:
                    continue
                done.add(name)
                levels_of = level[(members >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
                order = np.lexsort((members, levels_of))
                first = order[:n + (-percent * n // 100) + 1]
                few = int(np.searchsorted(levels_of[first], FEW_BITS, side="right"))
                out.append((name, n, group_counts(members).tobytes(), members[first].view(np.int64), few))
            if out:
                yield batch(schema, [list(c) for c in zip(*out)])
    return run


def _sets(k: int):
    schema = arrow_schema("set_id long, members binary")

    def run(batches):
        drop_worker_state()
        memo = _Hashes()
        for rows in batches:
            found = [shingle_set(t.as_py(), k, memo) for t in rows.column("text")]
            yield batch(schema, [[set_id(m) for m in found], [m.tobytes() for m in found]])
    return run


def _reachable(percent: int):
    """Whether the bound of two points reaches what their sizes need."""
    @F.pandas_udf("boolean")
    def reachable(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        need, out = least_overlap(n.to_numpy(np.int64), m.to_numpy(np.int64), percent), []
        for x, y, least in zip(a, b, need):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            groups = min(len(x), len(y))
            out.append(int(np.minimum(folded(x, groups), folded(y, groups)).sum()) >= least)
        return pd.Series(out, dtype=bool)
    return reachable


def _linked(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            out.append(int((both[1:] == both[:-1]).sum()) >= least_overlap(len(x), len(y), percent))
        return pd.Series(out, dtype=bool)
    return linked


def verified(pairs: DataFrame, docs: DataFrame, described: DataFrame, k: int, percent: int) -> DataFrame:
    """The staged pairs (a, b) of set ids whose whole sets reach the threshold."""
    needed = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    holders = staged(described.filter("set_id is not null").join(needed, "set_id", "left_semi").groupBy("set_id").agg(
        F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("holder")).select("holder"), "holders").distinct()
    if holders.count() <= SEND_IDS:
        holders = F.broadcast(holders)
    texts = docs.withColumn("holder", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(holders, "holder", "left_semi")
    sets = staged(texts.select("text").mapInArrow(_sets(k), "set_id long, members binary")
                  .filter("set_id is not null").dropDuplicates(["set_id"]), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return staged(both.filter(_linked(percent)("x", "y")).select("a", "b"), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(set_id, component): the least id that each end of an edge reaches, by alternating large and small stars."""
    def both_ways(e):
        return e.union(e.select("b", "a")).toDF("u", "v")

    def star(e, larger: bool):
        around = both_ways(e) if larger else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = around.join(least, "u")
        moved = joined.filter("v > u" if larger else "v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not larger:
            moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a != b").distinct()

    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = staged(star(star(edges.filter("a != b"), True), False), "stars")
    before = state(edges)
    while True:
        last, edges = edges, staged(star(star(edges, True), False), "stars")
        after = state(edges)
        discard(last)
        if after == before:
            break
        before = after
    # Stars now: each node other than a centre has one edge, to the centre.
    return edges.select(F.col("a").alias("set_id"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())


class CountTree:
    """A packed R-tree over the points of one block: entries sorted by size and then by count, ``FAN`` to a node."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        self.order = np.lexsort((*counts.T[:4], component, sizes))
        points, sizes, component = counts[self.order], sizes[self.order], component[self.order]
        # Per level, leaves first: upper corners, least and greatest size, least and greatest component.
        self.levels = [(points, sizes, sizes, component, component)]
        while len(self.levels[-1][0]) > FAN:
            high, small, large, first, last = self.levels[-1]
            cuts = np.arange(0, len(high), FAN)
            self.levels.append((np.maximum.reduceat(high, cuts), np.minimum.reduceat(small, cuts),
                                np.maximum.reduceat(large, cuts), np.minimum.reduceat(first, cuts),
                                np.maximum.reduceat(last, cuts)))

    def level(self, k: int):
        """Levels of a shorter tree repeat its top."""
        return self.levels[min(k, len(self.levels) - 1)]


def tree_pairs(one: CountTree, other: CountTree, percent: int, same: bool):
    """Index pairs of points in different components whose bound reaches the threshold, in arrays."""
    top = max(len(one.levels), len(other.levels)) - 1
    most = max(FAN * FAN, BOUND_BYTES // one.levels[0][0].shape[1])
    rows = [np.arange(len(t.level(top)[0])) for t in (one, other)]
    work = [(top, *(x.ravel() for x in np.meshgrid(*rows, indexing="ij")))]
    while work:
        k, a, b = work.pop()
        if len(a) > most:
            half = len(a) // 2
            work += [(k, a[half:], b[half:]), (k, a[:half], b[:half])]
            continue
        high_a, small_a, large_a, first_a, last_a = one.level(k)
        high_b, small_b, large_b, first_b, last_b = other.level(k)
        keep = (first_a[a] != last_a[a]) | (first_b[b] != last_b[b]) | (first_a[a] != first_b[b])
        # A set within t of another has at least t percent and at most 100 / t of its size.
        keep &= (large_a[a] * 100 >= small_b[b] * percent) & (large_b[b] * 100 >= small_a[a] * percent)
        if same:
            keep &= a <= b if k else a < b
        a, b = a[keep], b[keep]
        bound = np.minimum(high_a[a], high_b[b]).sum(axis=1)
        keep = bound >= least_overlap(small_a[a].astype(np.int64), small_b[b].astype(np.int64), percent)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if not k:
            yield one.order[a], other.order[b]
            continue
        sides = []
        for tree, own in ((one, a), (other, b)):
            if k < len(tree.levels):
                child = own[:, None] * FAN + np.arange(FAN)
                sides.append((child, child < len(tree.level(k - 1)[0])))
            else:
                sides.append((own[:, None], np.ones((len(own), 1), bool)))
        (ca, ga), (cb, gb) = sides
        good = ga[:, :, None] & gb[:, None, :]
        grid_a = np.broadcast_to(ca[:, :, None], good.shape)[good]
        grid_b = np.broadcast_to(cb[:, None, :], good.shape)[good]
        work.append((k - 1, grid_a, grid_b))


def _tree_join(percent: int):
    schema = arrow_schema("a long, b long")

    def run(bucket, table):
        frame = table.select(["key", "i", "j", "side", "set_id", "n", "component"]).to_pandas()
        counts, keys = table["counts"].to_pylist(), table["keys"]
        sizes, component, names = (frame[c].to_numpy() for c in ("n", "component", "set_id"))
        cell = frame.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
        order = np.lexsort((frame.side.to_numpy(), cell))
        cell, side, found = cell[order], frame.side.to_numpy()[order], []
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:]):
            split = a + int(np.searchsorted(side[a:b], 1))
            sides = [order[a:split]] if split == b else [order[a:split], order[split:b]]
            # A block is of one size class, so its points have equally many groups.
            points = [np.stack([np.frombuffer(counts[r], np.uint8) for r in rows]) for rows in sides]
            groups = min(p.shape[1] for p in points)
            trees = [CountTree(folded(p, groups), sizes[rows], component[rows]) for p, rows in zip(points, sides)]
            for x, y in tree_pairs(trees[0], trees[-1], percent, len(sides) == 1):
                if keys[int(order[a])].is_valid:
                    own = [{r: keys[int(r)].values.to_numpy() for r in np.unique(rows[z])}
                           for rows, z in ((sides[0], x), (sides[-1], y))]
                    here = frame.key.iat[order[a]]
                    told = np.array([np.intersect1d(own[0][p], own[1][q], assume_unique=True)[0] == here
                                     for p, q in zip(sides[0][x], sides[-1][y])], dtype=bool)
                    x, y = x[told], y[told]
                found.append(np.sort(np.column_stack((names[sides[0]][x], names[sides[-1]][y])), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.Table.from_batches([batch(schema, [pairs[:, 0], pairs[:, 1]])])
    return run


def across_components(members: DataFrame, points: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs (a, b) across components whose bound can't rule them out. members: key, set_id, n, component."""
    mixed = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.min("set_id").alias("a"), F.max("set_id").alias("b")).filter("lo != hi")
    # A key of two points is their pair.
    twos = bounded(mixed.filter("c = 2").select("a", "b").distinct(), points, percent)
    own = members.join(mixed.filter("c > 2").select("key", "c"), "key").withColumn(
        "class", F.shiftleft(F.floor(F.log2("n")).cast("long"), 32))
    by_size = Window.partitionBy("key", "class").orderBy("n", "component", "set_id")
    blocked = staged(own.filter(F.col("c") <= BLOCK).withColumn("block", F.col("class")).union(
        own.filter(F.col("c") > BLOCK).withColumn(
            "block", F.col("class") + F.floor((F.row_number().over(by_size) - 1) / BLOCK).cast("long"))
    ).drop("c", "class"), "blocks")
    nodes = blocked.groupBy("key", "block").agg(F.min("n").alias("small"), F.max("n").alias("large"),
                                                F.min("component").alias("lo"), F.max("component").alias("hi"))
    left = nodes.toDF("key", "i", "small_i", "large_i", "lo_i", "hi_i")
    right = nodes.toDF("key2", "j", "small_j", "large_j", "lo_j", "hi_j")
    met = staged(left.join(right, (F.col("key") == F.col("key2")) & (F.col("i") <= F.col("j"))
                    & (F.col("large_i") * 100 >= F.col("small_j") * percent)
                    & (F.col("large_j") * 100 >= F.col("small_i") * percent)
                    & ((F.col("lo_i") != F.col("hi_j")) | (F.col("hi_i") != F.col("lo_j")))).select("key", "i", "j"), "met")
    sides = met.select("key", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).union(
        met.filter("i != j").select("key", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    # Points of crowded keys bring all such keys of theirs, no more than their sets have.
    crowded = mixed.filter(F.col("c") >= REPEATED).select("key")
    lists = members.join(crowded, "key").groupBy("set_id").agg(F.collect_set("key").alias("keys"))
    # Narrow joins first: counts and lists are wide and move once to their rows and once to the trees.
    narrow = blocked.join(sides, ["key", "block"]).join(crowded.withColumn("crowded", F.lit(True)), "key", "left")
    wide = points.select("set_id", "counts").join(lists, "set_id", "left")
    rows = narrow.join(wide, "set_id").withColumn("keys", F.when(F.col("crowded"), F.col("keys")))
    bucket = F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)).alias("bucket")
    trees = rows.select(bucket, "key", "i", "j", "side", "set_id", "n", "component", "counts", "keys").groupBy(
        "bucket").applyInArrow(_tree_join(percent), "a long, b long")
    return trees.union(twos).distinct()


def shared_postings(points: DataFrame) -> DataFrame:
    """(key, set_id, n) of the keys that several points have. points: set_id, n, keys, of which the first ``few`` are few.

    All postings of a key of few meet in one exchange, where a window that spills tells whether they differ. What may be
    a frequent key is told by an aggregate that adds up before its shuffle, and joined, where Spark can split it.
    """
    each = lambda keys: points.select(F.explode(keys).alias("key"), "set_id", "n")
    same = Window.partitionBy("key")
    few = each(F.slice("keys", F.lit(1), F.col("few"))).withColumn("least", F.min("set_id").over(same)).withColumn(
        "greatest", F.max("set_id").over(same)).filter("least != greatest").select("key", "set_id", "n").distinct()
    many = each(F.slice("keys", F.col("few") + 1, F.size("keys")))
    shared = many.groupBy("key").agg(F.min("set_id").alias("least"), F.max("set_id").alias("greatest")).filter(
        "least != greatest").select("key")
    return few.union(many.join(shared, "key").distinct())


def hub_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a below b, of the points of crowded keys with their hubs.

    A mask turns the order of ids into another one. The least of a key's ids in each of ``HUBS`` orders are its hubs, and
    the least of the hubs of all of its keys are a point's.
    """
    masks = [int(m) for m in np.random.default_rng(1).integers(-(1 << 63), 1 << 63, HUBS, dtype=np.int64)]
    least = lambda column: [F.min(column(m)).alias(f"h{r}") for r, m in enumerate(masks)]
    hubs = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *least(
        lambda m: F.col("set_id").bitwiseXOR(F.lit(m)))).filter(F.col("c") >= CROWD).drop("c")
    own = members.select("key", "set_id").join(hubs, "key").groupBy("set_id").agg(
        *[F.min(f"h{r}").alias(f"h{r}") for r in range(HUBS)])
    each = F.explode(F.array(*[F.col(f"h{r}").bitwiseXOR(F.lit(m)) for r, m in enumerate(masks)]))
    pairs = own.select("set_id", each.alias("hub")).filter("set_id != hub")
    return pairs.select(F.least("set_id", "hub").alias("a"), F.greatest("set_id", "hub").alias("b")).distinct()


def without_twins(members: DataFrame) -> DataFrame:
    """Of keys that the same points share, the least: the others lead to the same pairs. members: key, set_id, n.

    Near copies share most of their keys, so this leaves few of theirs. Points are told apart by their number and by the
    exclusive or of two 64-bit hashes of each.
    """
    marks = [F.bit_xor(F.xxhash64("set_id", F.lit(seed))).alias(f"mark{seed}") for seed in (1, 2)]
    kept = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *marks).groupBy("c", "mark1", "mark2").agg(
        F.min("key").alias("key")).select("key")
    return members.join(kept, "key")


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and points allow a link."""
    of = lambda side: points.toDF(side, f"n_{side}", f"counts_{side}")
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(
        (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)).filter(
        _reachable(percent)("counts_a", "counts_b", "n_a", "n_b")).select("a", "b")


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                      percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    rows = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    everything = staged(rows.mapInArrow(_describe(k), "doc_id long, n int, set_id long, slice int, counts binary"),
                        "described")
    described = everything.filter("slice is null").select("doc_id", "n", "set_id")
    levels = spark.sparkContext.broadcast(shingle_levels(everything))
    points = staged(rows.select("text").mapInArrow(_locate(k, percent, levels), POINTS), "points")
    members = staged_alone(lambda: staged(without_twins(staged(shared_postings(points), "postings")), "members"))
    # Only points that share a key are compared.
    once = staged(points.select("set_id", "n", "counts").join(members.select("set_id").distinct(), "set_id", "left_semi")
                  .dropDuplicates(["set_id"]), "sharing")
    discard(points)
    tried = staged(bounded(hub_pairs(members), once, percent), "hubs-tried")
    edges = staged_alone(lambda: verified(tried, rows, described, k, percent))
    first = components(edges)

    grown = members.select("key", "set_id", "n").join(first, "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id")).select("key", "set_id", "n", "component")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = staged_alone(lambda: staged(
        across_components(grown, once, percent, tasks).join(tried, ["a", "b"], "left_anti"), "rest"))
    discard(once, members, tried)
    if not rest.isEmpty():
        first = components(edges.union(staged_alone(lambda: verified(rest, rows, described, k, percent))))
    discard(rest)

    named = described.join(first, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least_id = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least_id"))
    alone = named.filter("component is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"),
                                                     F.col("doc_id").alias("component_id"))
    return named.filter("component is not null").join(least_id, "component").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("least_id").alias("component_id")).union(alone)
