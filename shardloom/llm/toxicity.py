"""Toxic passages as maximum-scoring segments of token log-odds, and document scores by extreme-value calibration.

* Token scores. Log-odds of a token between toxic and clean texts under an informative Dirichlet prior, the prior being
  ``PRIOR`` times the token's count in the sample. Tokens whose log-odds are at least ``LEAST_ODDS`` and ``Z`` standard
  errors above zero score their log-odds; all others cost ``DRIFT``. Tokens that pass by their counts must pass again by
  the number of different neighbours that they stand between, so a text does not teach its own words by being copied.
* Passages. The linear-time scan for all maximal segments over a text's token scores, each segment being a run that no
  extension or shortening improves.
* Calibration. On clean texts the best segment of n tokens follows an extreme-value law with E = K n exp(-lambda S).
  lambda solves the moment equation of the clean tokens' scores, K fits the clean texts' best segments. A passage is
  significant if its E is under one. A document's two figures, the best and the summed ``-ln E`` of its significant
  passages, go through a logistic curve.

The fit uses at most ``SAMPLE`` labelled texts of each class, those with the least hashes of their ids; the curve weights
each class by its learning labels over those in the sample, so its prior is that of all labels at any size. Statistics, the
segments and the scores cover whole texts. Labels, languages, sources and ids are no inputs of a score. Without texts
of both classes the score is the share of toxic ones (0 without any).

Null texts are empty and score as a text without passages. Labels that are null or without a document do not count; of
repeated labels for an id the highest counts. Repeated rows score alike. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shardloom.llm.common import arrow_schema, batch, drop_worker_state, id_and_text, staged

SAMPLE = 10_000
PRIOR = 0.1  # weight of the prior, in samples
Z = 4.0
LEAST_ODDS = 1.5
LEAST_COUNT = 5  # of a token in the sample
DRIFT = -0.5
TOKEN = re.compile(r"[^\W\d_]+")
COUNTS = "token string, toxic long, clean long"
CONTEXTS = "token string, before string, after string, toxic long, clean long"
PASSAGES = "doc_id long, start long, end long, score double, e_value double, text string"


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, sum) in one pass; each candidate links to the last one that starts lower."""
    found: list[list] = []  # from, to, sum before, sum after, link
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, -1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new[0], new[2], after = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = after
    return [(a, b, high - low) for a, b, low, high, _ in found]


def sparse_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """The same where only ``places`` score and all else costs ``drift``: a gap is one step, so time follows places."""
    steps, last = [], -1
    for p, s in zip(places, scores):
        if p > last + 1:
            steps.append((last + 1, drift * (p - last - 1)))
        steps.append((p, s))
        last = p
    out = []
    for a, b, total in segments([s for _, s in steps]):
        end = steps[b][0] if b < len(steps) else last + 1
        out.append((steps[a][0], end, total))
    return out


@dataclass
class Model:
    """Bounded by the sample: the scoring tokens, two constants of the law, three of the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    k: float = 1.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    share: float | None = 0.0  # score of everything, if there is nothing to learn from

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens of the text, and its maximal segments."""
        found = tokens(text)
        if self.weights.keys().isdisjoint(found):
            return len(found), []
        places = [i for i, t in enumerate(found) if t in self.weights]
        return len(found), sparse_segments(places, [self.weights[found[i]] for i in places], DRIFT)

    def log_e(self, n: int, score: float) -> float:
        return float(np.log(self.k * max(n, 1)) - self.decay * score)

    def figures(self, n: int, found) -> tuple[float, float]:
        surprise = [-e for _, _, s in found if (e := self.log_e(n, s)) < 0]
        return max(surprise, default=0.0), sum(surprise)

    def score(self, text: str) -> float:
        if self.share is not None:
            return self.share
        best, total = self.figures(*self.passages(text))
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(best) + c * np.log1p(total), -500, 500))))


def _count(batches):
    drop_worker_state()
    schema = arrow_schema(COUNTS)
    kinds = (Counter(), Counter())
    for rows in batches:
        for text, toxic in zip(rows.column("text"), rows.column("toxic")):
            kinds[toxic.as_py()].update(tokens(text.as_py()))
    names = list(kinds[0].keys() | kinds[1].keys())
    for a in range(0, len(names), 10_000):
        part = names[a:a + 10_000]
        yield batch(schema, [part, [kinds[1][t] for t in part], [kinds[0][t] for t in part]])


def _contexts(names: frozenset[str]):
    """A candidate token between its neighbours, per class."""
    schema = arrow_schema(CONTEXTS)

    def run(batches):
        for rows in batches:
            seen = set()
            for text, toxic in zip(rows.column("text"), rows.column("toxic")):
                found = ["", *tokens(text.as_py()), ""]
                kind = toxic.as_py()
                seen.update((found[i], found[i - 1], found[i + 1], kind, 1 - kind)
                            for i in range(1, len(found) - 1) if found[i] in names)
            yield batch(schema, [list(c) for c in zip(*seen)] if seen else [[]] * len(schema))
    return run


def _figures(model: Model):
    schema = arrow_schema("toxic int, n_tokens long, best double, total double")

    def run(batches):
        for rows in batches:
            out = []
            for text, toxic in zip(rows.column("text"), rows.column("toxic")):
                n, found = model.passages(text.as_py())
                out.append((toxic.as_py(), n, max((s for *_, s in found), default=0.0), model.figures(n, found)[1]))
            yield batch(schema, [list(c) for c in zip(*out)] if out else [[]] * 4)
    return run


def sample_of(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str,
              size: int) -> tuple[DataFrame, dict[int, float]]:
    """Staged (text, toxic): at most ``size`` labelled texts of each class. How many labels one of each class stands for."""
    named = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).filter(learn)
    least = [named.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for c in (0, 1)]
    # 2 * size rows of 12 bytes.
    chosen = F.broadcast(least[0].union(least[1]))
    stands_for = {r.toxic: max(1.0, r["count"] / size) for r in named.groupBy("toxic").count().collect()}
    return staged(docs.join(chosen, "doc_id").select("text", "toxic"), "toxicity-sample"), stands_for


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows whose doc_id fulfils ``learn``."""
    rows, stands_for = sample_of(id_and_text(docs, id_col, text_col), labels, learn, label_col, sample)
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(share=1.0 if sizes.get(1) else 0.0)
    whole = {kind: 0 for kind in ("toxic", "clean")}

    def scoring_tokens(counts: DataFrame) -> DataFrame:
        prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean"))
        weight = PRIOR * sum(whole.values())
        odds = lambda c: F.log((F.col(c) + prior) / (F.lit(whole[c] + weight) - F.col(c) - prior))
        error = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
        delta = odds("toxic") - odds("clean")
        return counts.filter(F.col("toxic") + F.col("clean") >= LEAST_COUNT).withColumn("delta", delta).filter(
            (delta / error >= Z) & (delta >= LEAST_ODDS))

    each = [F.sum(c).alias(c) for c in whole]
    counts = staged(rows.mapInArrow(_count, COUNTS).groupBy("token").agg(*each), "toxicity-counts")
    totals = counts.agg(*each).first()
    whole = {kind: float(totals[kind] or 0) for kind in whole}
    candidates = [r.token for r in scoring_tokens(counts).select("token").collect()]
    # Copies of one text repeat its tokens between the same neighbours: candidates count once between any two.
    apart = rows.mapInArrow(_contexts(frozenset(candidates)), CONTEXTS).distinct().groupBy("token").agg(*each)
    scoring = scoring_tokens(apart).toPandas()
    model = Model(dict(zip(scoring.token, scoring.delta)), share=None)
    # Clean tokens' scores: what scores by its share, smoothed by half a token, and the drift for the rest.
    share = (scoring.clean.to_numpy(float) + 0.5) / (whole["clean"] + 1)
    values = scoring.delta.to_numpy(float)
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        moment = (share * np.exp(np.minimum(mid * values, 600))).sum() + (1 - share.sum()) * np.exp(mid * DRIFT)
        low, high = (mid, high) if moment < 1 else (low, mid)
    model.decay = low
    figures = rows.mapInArrow(_figures(model), "toxic int, n_tokens long, best double, total double").toPandas()
    clean = figures[figures.toxic == 0]
    model.k = len(clean) / float((clean.n_tokens.clip(lower=1) * np.exp(-model.decay * clean.best)).sum())
    figures = rows.mapInArrow(_evaluated(model), "toxic int, best double, total double").toPandas()
    x = np.log1p(figures[["best", "total"]].to_numpy(float))
    weight = figures.toxic.map(stands_for).to_numpy(float)
    model.curve = tuple(_logistic(x, figures.toxic.to_numpy(float), weight).tolist())
    return model


def _evaluated(model: Model):
    schema = arrow_schema("toxic int, best double, total double")

    def run(batches):
        for rows in batches:
            out = [(x.as_py(), *model.figures(*model.passages(t.as_py())))
                   for t, x in zip(rows.column("text"), rows.column("toxic"))]
            yield batch(schema, [list(c) for c in zip(*out)] if out else [[]] * 3)
    return run


def scorer(model: Model):
    """A column function from text to score."""
    @F.pandas_udf("double")
    def toxicity(text: pd.Series) -> pd.Series:
        drop_worker_state()
        return pd.Series([model.score(t or "") for t in text], dtype="float64")
    return toxicity


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant passage: token span, segment score, E and the words."""
    schema = arrow_schema(PASSAGES)

    def run(batches):
        for rows in batches:
            out = []
            for key, text in zip(rows.column("doc_id"), rows.column("text")):
                n, found = model.passages(text.as_py())
                words = tokens(text.as_py()) if found else []
                out += [(key.as_py(), a, b, s, float(np.exp(model.log_e(n, s))), " ".join(words[a:b]))
                        for a, b, s in found if model.log_e(n, s) < 0]
            yield batch(schema, [list(c) for c in zip(*out)] if out else [[]] * len(schema))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PASSAGES)
