"""Nearest neighbours and toxicity: recall and exact scores, segments, held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import all_segments, nearest
from pyspark.sql import functions as F

from shardloom.llm import posting_lists, toxicity
from shardloom.llm.common import crc_of_id

VECTORS = "vec_id long, embedding array<float>, rank string, score string, list string"
EVERY = "vec_id % 20 = 0"


def recall(found, expected):
    want, got = {}, {}
    for q, _, i, _ in expected:
        want.setdefault(q, set()).add(i)
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(want[q] & got.get(q, set())) for q in want) / sum(map(len, want.values()))


def test_recall_on_the_given_vectors(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = frame.select("vec_id", "embedding").collect()
    expected = nearest([r[0] for r in rows], [r[1] for r in rows], 10, lambda i: i % 20 == 0)
    found = posting_lists.search(frame, EVERY).collect()
    assert recall(found, expected) >= 0.9
    exact = {(q, i): s for q, _, i, s in nearest([r[0] for r in rows], [r[1] for r in rows], 10_000, lambda i: i % 20 == 0)}
    for r in found:
        assert abs(exact[r.query_id, r.vec_id] - r.score) < 1e-9
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    for own in by_query.values():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)


def test_hot_vectors_and_odd_rows(spark, monkeypatch):
    """A third of the rows share a vector; rows that take no part; tiny blocks."""
    generator = np.random.default_rng(7)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else generator.normal(size=3).round(1).tolist(), "x", "y", "z") for i in range(600)]
    odd = [(600, None, "", "", ""), (None, [1.0, 2.0, 3.0], "", "", ""), (620, [0.0, 0.0, 0.0], "", "", ""),
           (640, [1.0, None, 2.0], "", "", ""), (660, [float("nan"), 1.0, 1.0], "", "", ""),
           (680, [float("inf"), 1.0, 1.0], "", "", ""), (700, [1.0, 2.0], "", "", ""), (720, [], "", "", "")]
    good = [r for r in rows if any(r[1])] + [(0, [1.0, 2.0, 3.0], "", "", "")]
    frame = spark.createDataFrame(rows + odd + good[-1:], VECTORS)
    monkeypatch.setattr(posting_lists, "BLOCK", 32)
    monkeypatch.setattr(posting_lists, "LIST_SIZE", 1 << 20)
    found = sorted(map(tuple, posting_lists.search(frame, EVERY, k=10).collect()))
    data = [(i, np.float32(v)) for i, v, *_ in good]
    expected = nearest([i for i, _ in data], [v for _, v in data], 10, lambda i: i % 20 == 0)
    assert [r[:3] for r in found] == [r[:3] for r in sorted(expected)]


def made_vectors(spark, n, path):
    """Unit vectors of 64 independent normal components."""
    raw = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(seed=100 + i) for i in range(64)]).alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))
    raw.select("vec_id", F.transform("z", lambda x: (x / norm).cast("float")).alias("embedding")).write.parquet(path)
    return spark.read.parquet(path)


def brute_recall(frame, step):
    """Recall of ten for every ``step``-th id against all distances."""
    rows = frame.select("vec_id", "embedding").toArrow()
    ids, vecs = rows["vec_id"].to_numpy(), posting_lists._vectors(rows["embedding"])
    asking = np.flatnonzero(ids % step == 0)
    d = posting_lists._distances(vecs[asking], vecs)
    d[np.arange(len(asking)), asking] = np.inf
    expected = [(ids[q], 0, i, 0) for q, row in zip(asking, np.argpartition(d, 10, axis=1)[:, :10]) for i in ids[row]]
    return recall(posting_lists.search(frame, f"vec_id % {step} = 0").collect(), expected)


def test_recall_with_many_lists(spark, tmp_path, monkeypatch):
    """No number of lists caps what a query reads: here are more lists than any fixed number was."""
    monkeypatch.setattr(posting_lists, "LIST_SIZE", 8)
    assert brute_recall(made_vectors(spark, 8000, str(tmp_path / "vectors")), 80) >= 0.9


def test_recall_on_a_large_table(spark, tmp_path):
    """100,000 vectors in more than 1,500 lists, of which queries read a part; the given tables have few lists."""
    frame = made_vectors(spark, 100_000, str(tmp_path / "vectors"))
    assert brute_recall(frame, 500) >= 0.95
    index = posting_lists.index_of(posting_lists.classes_of(posting_lists.taking_part(frame, "vec_id", "embedding"), 10), 10)
    graph = posting_lists.CentroidGraph(index.centroids)
    asking = posting_lists._vectors(frame.filter("vec_id % 1000 = 0").toArrow()["embedding"])
    share = np.mean([len(graph.lists_for(v, index.ratio)) for v in asking]) / len(index.centroids)
    print(f"lists read: {share:.3f}")
    assert len(index.centroids) > 1500 and share < 0.9


def test_boundary_vectors_are_replicated():
    points = np.random.default_rng(6).normal(size=(12_000, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    centroids = posting_lists.balanced_centroids(points, 800)
    apart = np.sqrt(posting_lists._distances(centroids, centroids))
    ids = np.arange(1000)
    rows = pa.RecordBatch.from_pydict({"class": ids, "first": ids, "vec": pa.array(list(points[:1000].astype(np.float32)))})
    held = [b.num_rows for b in posting_lists._index(centroids, apart)([rows])]
    assert 1.1 < sum(held) / 1000 < posting_lists.REPLICAS


def test_lists_share_cells(monkeypatch):
    monkeypatch.setattr(posting_lists, "BLOCK", 10)
    base, blocks = posting_lists.cells_of(np.array([4, 6, 1, 25, 0, 10, 3]))
    assert base.tolist() == [0, 0, 1, 2, 5, 5, 6] and blocks.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 1.0], "", "", ""), (1, [2.0, 1.0], "", "", "")], VECTORS)
    assert [tuple(r) for r in posting_lists.search(frame, EVERY).collect()] == [(0, 1, 1, 1.0)]
    assert posting_lists.search(frame.limit(0), EVERY).count() == 0


def test_graph_finds_near_centroids():
    points = np.random.default_rng(3).normal(size=(800, 16))
    graph = posting_lists.CentroidGraph(points)
    hits = 0
    for q in np.random.default_rng(4).normal(size=(50, 16)):
        truth = set(np.argsort(((points - q) ** 2).sum(axis=1))[:20].tolist())
        hits += len(truth & {i for _, i in graph.search(q)[:20]})
    assert hits >= 0.97 * 50 * 20


def test_lists_are_balanced():
    points = np.random.default_rng(5).normal(size=(4000, 8))
    centroids = posting_lists.balanced_centroids(points, 60)
    assert len(centroids) == 60
    own = np.argmin(posting_lists._distances(points, centroids), axis=1)
    assert np.bincount(own, minlength=60).max() < 6 * 4000 / 60


def test_segments():
    generator = random.Random(9)
    for _ in range(300):
        scores = [generator.choice([-3, -2, -1, -0.5, 1, 2, 2.5]) for _ in range(generator.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == [(a, b) for a, b, _ in all_segments(scores)]


def test_sparse_segments():
    generator = random.Random(11)
    for _ in range(300):
        n = generator.randrange(1, 30)
        scores = [generator.choice([-0.5, -0.5, -0.5, 2.0, 0.4]) for _ in range(n)]
        places = [i for i, s in enumerate(scores) if s > 0]
        dense = [(a, b, round(s, 9)) for a, b, s in toxicity.segments(scores)]
        sparse = toxicity.sparse_segments(places, [scores[i] for i in places], -0.5)
        assert [(a, b, round(s, 9)) for a, b, s in sparse] == dense


def rank_quality(scores, labels):
    order = np.argsort(np.argsort(scores))
    positive = labels.sum()
    return (order[labels == 1].sum() - positive * (positive - 1) / 2) / (positive * (len(labels) - positive))


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.1"


def test_held_out_accuracy(spark, larger):
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    model = toxicity.fit(docs, labels, F.pmod(crc_of_id(), F.lit(5)) != 0)
    # In this table the labels of other languages follow nothing in the texts.
    held = docs.filter("lang = 'en'").join(labels, "doc_id").filter(F.pmod(crc_of_id(), F.lit(5)) == 0).select(
        "toxic", toxicity.scorer(model)(F.col("text")).alias("score")).toPandas()
    assert rank_quality(held.score.to_numpy(), held.toxic.to_numpy()) > 0.9
    guess = (held.score >= 0.5).astype(int)
    assert (guess == held.toxic).mean() > 0.95
    some = toxicity.passages(docs, model).filter("e_value < 1e-3")
    assert some.count() > 0


def test_prior_does_not_follow_the_sample(spark, larger):
    """With as many clean as toxic texts in the sample, mean scores still are the share of toxic labels."""
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True), sample=300)
    found = docs.join(labels, "doc_id").select(
        F.avg("toxic").alias("share"), F.avg(toxicity.scorer(model)(F.col("text"))).alias("score")).first()
    assert abs(found.score - found.share) < 0.04


def test_odd_texts(spark, odd, none, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    found = odd.select("doc_id", toxicity.scorer(model)(F.col("text")).alias("score")).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.passages(none, model).count() == 0
    messy = labels.select("doc_id", "toxic").union(spark.createDataFrame(
        [(None, 1), (1, None), (10 ** 9, 1), (1, 0)], "doc_id long, toxic int"))
    assert toxicity.fit(docs, messy, F.lit(True)).share is None


def test_without_classes(spark, documents):
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, toxic int")
    assert toxicity.fit(documents, labels, F.lit(True)).score("any") == 1.0
    assert toxicity.fit(documents, labels.limit(0), F.lit(True)).score("any") == 0.0
