"""Approximate nearest neighbours in balanced posting lists.

* Classes. Rows with the same vector are one class that keeps its ``k + 1`` least ids; ties go to smaller ids, so no
  further copy can be among the ``k`` nearest of any query. A vector that a third of all rows share is one entry.
* Lists. Centroids come from balanced hierarchical clustering of a sample of at most ``SAMPLE`` classes (the least hashes
  of their ids). Every class is then indexed: in its nearest list and, as a boundary vector, in up to ``REPLICAS`` lists
  whose centroids are at most ``1 + CLOSURE`` times as far, unless a list already chosen is closer to that centroid than
  ``SPREAD`` times the vector is. Centroids are means and lie closer together than vectors do, hence less than once.
* Search. The centroids are in memory as a graph of near neighbours, searched best first. A query reads all lists whose
  distance is at most ``1 + ratio`` times that of its nearest one. The ratio is the table's own: ``TRIED`` classes are
  compared with all others, and it is the least that reaches ``RECALL`` of their ``k`` nearest. No number of lists is set.
  A table of at most ``BLOCK`` classes is one list, so its answers are exact.
* Cells. Neighbouring lists share a cell up to ``BLOCK`` classes, and a query goes to a cell once. A list longer than
  that, or a cell asked for by more than ``BLOCK`` queries, is dealt out in blocks, so no task holds a whole long list.
  Distances are exact, in double precision, on the original vectors.

Rows with a null id, or whose vector is null, empty, zero, of another length than most, or holds null or non-finite
components, take no part. Equal rows are one row. Rows that share an id but not the vector exclude each other and are
asked for one by one. With fewer than ``k`` candidates all of them are returned. Empty
tables give no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from shardloom.llm.common import arrow_schema, batch, staged

SAMPLE = 32_768
LIST_SIZE = 64  # classes of a list, on average, until MAX_LISTS
MAX_LISTS = 4096
REPLICAS, CLOSURE, SPREAD = 6, 0.15, 0.8
TRIED, RECALL = 256, 0.98
BEAM, DEGREE = 192, 24
BLOCK = 4096
WANTED = "cell int, lists array<int>, q_class long, q_vec array<float>"
FOUND = "q_class long, class long, first long, score double"


def taking_part(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec of the rows that can be found or ask."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("vec"))
    good = rows.filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite)
                       & F.exists("vec", lambda x: x != 0))
    length = good.agg(F.mode(F.size("vec")).alias("n")).first().n or 0
    return good.filter(F.size("vec") == length)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """A staged row per distinct vector: class, vec, its least ids."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    least = rows.withColumn("rn", F.dense_rank().over(order)).filter(F.col("rn") <= k + 1)
    return staged(least.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(
        F.monotonically_increasing_id().alias("class"), F.col("ids")[0].alias("first"), "vec", "ids"), "classes")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two blocks, for choosing only."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _split(points: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Balanced k-means: a part that is over its share becomes farther away for everyone."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), parts, replace=False)]
    share, price = len(points) / parts, np.zeros(parts)
    for _ in range(8):
        d = _distances(points, centres)
        own = np.argmin(d + price, axis=1)
        sizes = np.bincount(own, minlength=parts)
        price += 0.5 * d.mean() * (sizes - share) / share / parts
        for c in np.flatnonzero(sizes):
            centres[c] = points[own == c].mean(axis=0)
    return own


def balanced_centroids(sample: np.ndarray, lists: int, branch: int = 8) -> np.ndarray:
    """Centroids by splitting the largest group into ``branch`` until there are ``lists`` groups."""
    groups = [(-len(sample), 0, np.arange(len(sample)))]
    made = 1
    while len(groups) < lists and -groups[0][0] > 1:
        _, _, rows = heapq.heappop(groups)
        parts = min(branch, len(rows), lists - len(groups))
        own = _split(sample[rows], max(2, parts), made)
        if len(np.unique(own)) == 1:
            own = np.arange(len(rows)) % 2
        for part in np.unique(own):
            heapq.heappush(groups, (-int((own == part).sum()), made, rows[own == part]))
            made += 1
    return np.stack([sample[rows].mean(axis=0) for _, _, rows in sorted(groups, key=lambda g: g[1])])


class CentroidGraph:
    """Near neighbours of each centroid, and a few far ones so that all are reached; searched best first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, n = centroids, len(centroids)
        near = [set() for _ in range(n)]
        far = np.random.default_rng(n).integers(0, n, (n, 2))
        for at in range(0, n, 512):
            d = _distances(centroids[at:at + 512], centroids)
            degree = min(DEGREE + 1, n)
            for i, row in enumerate(np.argpartition(d, degree - 1, axis=1)[:, :degree], at):
                for j in (*row.tolist(), *far[i].tolist(), (i + 1) % n):
                    if i != j:
                        near[i].add(int(j))
                        near[int(j)].add(i)
        self.near = [np.array(sorted(x), dtype=np.int64) for x in near]
        self.entry = int(np.argmin(_distances(centroids.mean(axis=0)[None, :], centroids)))

    def search(self, query: np.ndarray, beam: int = BEAM, ratio: float = 0.0) -> list[tuple[float, int]]:
        """By ascending distance, the ``beam`` nearest centroids and all within ``1 + ratio`` times the least distance."""
        start = float(np.sqrt(((self.centroids[self.entry] - query) ** 2).sum()))
        seen = np.zeros(len(self.centroids), dtype=bool)
        seen[self.entry] = True
        open_, best, least = [(start, self.entry)], [(-start, self.entry)], start
        found = [(start, self.entry)]
        while open_:
            d, i = heapq.heappop(open_)
            if len(best) >= beam and d > -best[0][0] and d > least * (1 + ratio):
                break
            new = self.near[i][~seen[self.near[i]]]
            seen[new] = True
            for dist, j in zip(np.sqrt(((self.centroids[new] - query) ** 2).sum(axis=1)).tolist(), new.tolist()):
                if len(best) < beam or dist < -best[0][0] or dist <= least * (1 + ratio):
                    least = min(least, dist)
                    heapq.heappush(open_, (dist, j))
                    found.append((dist, j))
                    heapq.heappush(best, (-dist, j))
                    if len(best) > beam:
                        heapq.heappop(best)
        found.sort()
        return [(d, i) for at, (d, i) in enumerate(found) if at < beam or d <= least * (1 + ratio)]

    def lists_for(self, query: np.ndarray, ratio: float) -> list[int]:
        found = self.search(query, ratio=ratio)
        limit = found[0][0] * (1 + ratio)
        return [i for d, i in found if d <= limit]


def _vectors(column, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _index(centroids: np.ndarray, apart: np.ndarray):
    """Posting rows of every class: its own list and those that it is on the boundary of."""
    schema = arrow_schema("list int, class long, first long, vec array<float>")

    def run(batches):
        for rows in batches:
            for a in range(0, rows.num_rows, 2000):
                part = rows.slice(a, 2000)
                d = np.sqrt(_distances(_vectors(part.column("vec")), centroids))
                m = min(REPLICAS * 3, d.shape[1])
                close = np.argpartition(d, m - 1, axis=1)[:, :m]
                close = np.take_along_axis(close, np.argsort(np.take_along_axis(d, close, 1), axis=1, kind="stable"), 1)
                lists, rows_of = [], []
                for r in range(len(part)):
                    limit, chosen = d[r, close[r, 0]] * (1 + CLOSURE), []
                    for c in close[r]:
                        if d[r, c] > limit or len(chosen) == REPLICAS:
                            break
                        if not any(apart[c, o] < SPREAD * d[r, c] for o in chosen):
                            chosen.append(c)
                    lists += chosen
                    rows_of += [r] * len(chosen)
                taken = part.take(rows_of)
                yield batch(schema, [np.array(lists, np.int32), taken.column("class"), taken.column("first"),
                                     taken.column("vec")])
    return run


def _nearest_of(tried: np.ndarray, k: int):
    """The ``k + 1`` nearest classes of every tried vector among a task's, the vector's own among them."""
    schema = arrow_schema("tried int, class long, score double")

    def run(batches):
        own, score = np.zeros((len(tried), 0), np.int64), np.zeros((len(tried), 0))
        for rows in batches:
            for a in range(0, rows.num_rows, 2000):
                part = rows.slice(a, 2000)
                score = np.hstack([score, _distances(tried, _vectors(part.column("vec")))])
                own = np.hstack([own, np.broadcast_to(part.column("class").to_numpy(), (len(tried), len(part)))])
                if score.shape[1] > k + 1:
                    least = np.argpartition(score, k, axis=1)[:, :k + 1]
                    own, score = np.take_along_axis(own, least, 1), np.take_along_axis(score, least, 1)
        yield batch(schema, [np.repeat(np.arange(len(tried), dtype=np.int32), own.shape[1]), own.ravel(), score.ravel()])
    return run


def fitted_ratio(classes: DataFrame, postings: DataFrame, centroids: np.ndarray, k: int) -> float:
    """The least ratio at which ``TRIED`` classes find ``RECALL`` of their ``k`` nearest classes, by comparing with all."""
    tried = classes.select("class", "vec").orderBy(F.xxhash64("class", F.lit(1)), "class").limit(TRIED).toArrow()
    vecs = _vectors(tried["vec"])
    own = postings.sparkSession.createDataFrame(list(enumerate(tried["class"].to_pylist())), "tried int, self long")
    nearest = Window.partitionBy("tried").orderBy("score", "class")
    each = classes.select("class", "vec").mapInArrow(_nearest_of(vecs, k), "tried int, class long, score double").join(
        F.broadcast(own), "tried").filter("class != self")
    true = each.withColumn("rn", F.row_number().over(nearest)).filter(F.col("rn") <= k)
    # k rows of each tried class, with its lists.
    held = postings.select("class", "list").join(F.broadcast(true.select("tried", "class")), "class").groupBy(
        "tried", "class").agg(F.collect_list("list").alias("lists")).collect()
    d = np.sqrt(_distances(vecs, centroids))
    least = d.min(axis=1)
    needed = sorted(float(d[r.tried, r.lists].min() / max(least[r.tried], 1e-12)) - 1 for r in held)
    # A little more than that: the distances here and in a search are rounded differently.
    return (needed[min(len(needed) - 1, int(len(needed) * RECALL))] if needed else 0.0) + 1e-6


def _ask(graph: CentroidGraph, ratio: float, base: np.ndarray, blocks: np.ndarray):
    """A row per query and cell that it reads, with the lists that it reads there."""
    schema = arrow_schema(WANTED)

    def run(batches):
        for rows in batches:
            # A few queries at a time, as each may go to all cells.
            for a in range(0, rows.num_rows, 32):
                part = rows.slice(a, 32)
                cells, lists, of = [], [], []
                for r, vec in enumerate(_vectors(part.column("vec"))):
                    own = {}
                    for i in graph.lists_for(vec, ratio):
                        for cell in range(int(base[i]), int(base[i] + blocks[i])):
                            own.setdefault(cell, []).append(i)
                    cells += own.keys()
                    lists += own.values()
                    of += [r] * len(own)
                taken = part.take(of)
                yield batch(schema, [np.array(cells, np.int32), lists, taken.column("class"), taken.column("vec")])
    return run


def _cell(k: int):
    schema = arrow_schema(FOUND)

    def run(key, asked, held):
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        vecs, first, own = _vectors(held["vec"]), held["first"].to_numpy(), held["class"].to_numpy()
        queries, q_class = _vectors(asked["q_vec"]), asked["q_class"].to_numpy()
        names, at = np.unique(held["list"].to_numpy(), return_inverse=True)
        # A class has at most REPLICAS rows here, so this many hold the k + 1 nearest classes.
        most = (k + 1) * REPLICAS
        out = []
        for a in range(0, len(queries), 256):
            near = _distances(queries[a:a + 256], vecs)
            for q, vec, d, lists in zip(q_class[a:a + 256], queries[a:a + 256], near, asked["lists"][a:a + 256]):
                rows = np.flatnonzero(np.isin(names, lists.values.to_numpy())[at])
                if len(rows) > most:
                    # Chosen by rounded distances, so all that may be as near as the last one are measured.
                    d = d[rows]
                    rows = rows[d <= np.partition(d, most - 1)[most - 1] * (1 + 1e-9) + 1e-9 * (vec * vec).sum()]
                rows = rows[np.unique(own[rows], return_index=True)[1]]
                score = np.sqrt(((vecs[rows] - vec) ** 2).sum(axis=1))
                best = np.lexsort((first[rows], score))[:k + 1]
                rows = rows[best]
                out.append((np.full(len(best), q), own[rows], first[rows], score[best]))
        return type(held).from_batches([batch(schema, [np.concatenate(c) for c in zip(*out)])])
    return run


@dataclass
class Index:
    """Centroids, staged postings (list, class, first, vec) and the ratio that queries read by."""

    centroids: np.ndarray
    postings: DataFrame
    ratio: float


def index_of(classes: DataFrame, k: int, ratio: float | None = None) -> Index | None:
    """The index of staged classes; None without any."""
    taken = classes.select("class", "vec").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).toArrow()
    if not taken.num_rows:
        return None
    # What fits into a cell is one list, so it is compared whole.
    n = classes.count()
    lists = max(1, min(MAX_LISTS, taken.num_rows, n // LIST_SIZE)) if n > BLOCK else 1
    centroids = balanced_centroids(_vectors(taken["vec"]), lists)
    apart = np.sqrt(_distances(centroids, centroids)).astype(np.float32)
    flat = "list int, class long, first long, vec array<float>"
    postings = staged(classes.select("class", "first", "vec").mapInArrow(_index(centroids, apart), flat), "postings")
    return Index(centroids, postings, fitted_ratio(classes, postings, centroids, k) if ratio is None else ratio)


def cells_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of every list: lists in their order share one up to ``BLOCK`` classes."""
    base, blocks = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    cell, filled = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if filled and filled + n > BLOCK:
            cell, filled = cell + 1, 0
        base[i], blocks[i] = cell, max(1, -(-n // BLOCK))
        filled += n
        if blocks[i] > 1:
            cell, filled = cell + int(blocks[i]), 0
    return base, blocks


def search(vectors: DataFrame, asks: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           ratio: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id fulfils the SQL condition ``asks`` on vec_id.

    Without a ``ratio`` the table's own is fitted."""
    spark = vectors.sparkSession
    rows = taking_part(vectors, id_col, vec_col)
    classes = classes_of(rows, k)
    index = index_of(classes, k, ratio)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # The classes of queries: found by the vector, so each is searched once.
    queries = staged(rows.filter(asks).join(classes.select("class", "vec"), "vec").select(
        F.col("vec_id").alias("query_id"), "class").distinct(), "queries")
    # A row per list, MAX_LISTS at most.
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in index.postings.groupBy("list").count().collect():
        sizes[r.list] = r["count"]
    base, blocks = cells_of(sizes)
    places = spark.createDataFrame([(i, int(base[i]), int(blocks[i])) for i in range(len(base))],
                                   "list int, base int, blocks int")
    wanted = staged(classes.join(queries.select("class").distinct(), "class", "left_semi").select("class", "vec")
                    .mapInArrow(_ask(CentroidGraph(index.centroids), index.ratio, base, blocks), WANTED), "wanted")
    # Every block of a cell's queries meets the cell.
    q_blocks = wanted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_blocks"))
    asked = wanted.join(q_blocks, "cell").withColumn("q_block", F.pmod(F.xxhash64("q_class"), "q_blocks").cast("int"))
    held = index.postings.join(F.broadcast(places), "list").withColumn(
        "cell", (F.col("base") + F.pmod(F.xxhash64("class"), "blocks")).cast("int")).join(q_blocks, "cell").withColumn(
        "q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    cell = ["cell", "q_block"]
    found = asked.select(*cell, "lists", "q_class", "q_vec").groupBy(*cell).cogroup(
        held.select(*cell, "list", "class", "first", "vec").groupBy(*cell)).applyInArrow(_cell(k), FOUND)
    once = found.groupBy("q_class", "class").agg(F.first("first").alias("first"), F.first("score").alias("score"))
    nearest = Window.partitionBy("q_class").orderBy("score", "first")
    best = once.withColumn("rn", F.row_number().over(nearest)).filter(F.col("rn") <= k + 1).drop("rn")
    each = queries.join(best.withColumnRenamed("class", "near"), queries["class"] == best["q_class"]).join(
        classes.select(F.col("class").alias("near"), "ids"), "near").select(
        "query_id", "q_class", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id")
    ranked = Window.partitionBy("query_id", "q_class").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
