"""Quality classifier: naive Bayes support vectors.

Features are indicators of lower-cased white-space words and word pairs, hashed to ``BUCKETS`` buckets. Each is scaled by
the log of the ratio of its smoothed class counts, and texts by the root of their number of features. A linear hinge-loss
model (L2 penalty) is fitted to them by dual coordinate descent; margins become scores by a sigmoid fitted on a fifth of
the sample that the model didn't see.

Defined results: null, empty and wordless texts have no feature but the constant one, and get its score. If the sample has
one class only (or none), the score is that class's (or 0.5) everywhere. Repeated ids get a row each; labels that disagree
on one id count as 1. A score that equals the cut is predicted 1 and kept (ties). Very long texts are scored whole. An
empty table gives no rows. :func:`classify` reads the id and text columns only; :func:`keep_good` passes all columns on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import linear
from .shared import Memo, load, trim

BUCKETS = 1 << 18
EPOCHS = 12
COST = 1.0
CUT = 0.7


def features(text: bytes | None, hashes: Memo) -> np.ndarray:
    words = text.lower().split() if text else []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    both = np.concatenate([linear.mixed(h, salt=1), linear.mixed(h[:-1], h[1:], salt=2)]) if len(h) else h
    return np.unique((both >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64))


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Weights (class ratios times the fitted ones), constant, and the sigmoid's a and b."""
    if len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0, 1.0, (30.0 if y[0] else -30.0) if len(y) else 0.0
    tuned = np.arange(len(y)) % 5 == 4
    if len(set(y[~tuned].tolist())) < 2 or len(set(y[tuned].tolist())) < 2:
        tuned[:] = False
    learn = np.nonzero(~tuned)[0]
    counts = np.ones((2, BUCKETS))
    for i in learn:
        counts[y[i], rows[i]] += 1
    share = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    ratio = share[1] - share[0]
    values = [ratio[x] / max(1.0, len(x)) ** 0.5 for x in rows]
    sign = 2.0 * y - 1
    cost = np.where(y == 1, COST, COST * min(10.0, max(1.0, (y[learn] == 1).sum() / max(1, (y[learn] == 0).sum()))))
    w, constant = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(y))
    square = np.array([x @ x + 1.0 for x in values])
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            gradient = sign[i] * (w[rows[i]] @ values[i] + constant) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                constant += step
                alpha[i] = new
    margins = np.array([w[x] @ v + constant for x, v in zip(rows, values, strict=True)])
    a, b = linear.platt(margins[tuned], y[tuned]) if tuned.any() else linear.platt(margins, y)
    return (w * ratio).astype(np.float32), float(constant), a, b


def scorer(model: tuple):
    def make():
        hashes = linear.word_hashes()
        w, constant, a, b = model.value

        def score(texts: list[bytes | None]) -> list[float]:
            out = []
            for text in texts:
                found = features(text, hashes)
                margin = float(w[found].sum(dtype=np.float64)) / max(1, len(found)) ** 0.5 + constant
                out.append(float(1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))))
            return out

        return score

    return make


def model(docs: DataFrame, labels: DataFrame, label: str = "quality"):
    """The fitted model, broadcast: one weight for each of BUCKETS buckets."""
    fitted = fit(*linear.sample(docs, labels, label, features))
    trim(docs.sparkSession)  # the sample's features are gone
    return docs.sparkSession.sparkContext.broadcast(fitted)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    return linear.scored(docs, scorer(model(docs, labels)), cut)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    return linear.kept(docs, scorer(model(docs, labels)), cut)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
