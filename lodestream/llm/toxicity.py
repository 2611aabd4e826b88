"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, ASCII lower-cased. Features are indicators of words,
word pairs, and pairs with one word between them, hashed to ``BUCKETS`` buckets. Each coordinate has its own rate
(``ALPHA``, ``BETA``) and an L1 penalty that leaves most weights at 0, so what is broadcast is the list of the others.

Defined results: null, empty and wordless texts have the constant feature alone. A sample without labels gives 0.5.
Repeated ids get a row each; labels that disagree on one id count as 1. A score that equals the cut is predicted 1 (ties).
Very long texts are scored whole. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import linear
from .decontaminate import words_of
from .shared import Memo, load

BUCKETS = 1 << 22
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 0.1
EPOCHS = 4
CUT = 0.3


def _hashed(text: bytes | None, hashes: Memo) -> np.ndarray:
    words = words_of(text)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return np.zeros(0, np.int64)
    every = np.concatenate([linear.mixed(h, salt=1), linear.mixed(h[:-1], h[1:], salt=2), linear.mixed(h[:-2], h[2:], salt=3)])
    return (every >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def features(text: bytes | None, hashes: Memo) -> np.ndarray:
    return np.unique(_hashed(text, hashes))


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Buckets with a weight, their weights, the constant, and the sigmoid's a and b."""
    if not len(y):
        return np.zeros(0, np.int64), np.zeros(0), 0.0, 1.0, 0.0
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rng = np.random.default_rng(11)

    def weights(at: np.ndarray) -> np.ndarray:
        part = z[at]
        w = -(part - np.sign(part) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(part) <= L1, 0.0, w)

    def constant() -> float:
        return float(-z[BUCKETS] / ((BETA + n[BUCKETS] ** 0.5) / ALPHA))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            at = rows[i]
            w, c = weights(at), constant()
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, float(w.sum()) + c))))
            g = p - y[i]
            square = g * g
            before = n[at]
            z[at] += g - (np.sqrt(before + square) - np.sqrt(before)) / ALPHA * w
            n[at] = before + square
            z[BUCKETS] += g - ((n[BUCKETS] + square) ** 0.5 - n[BUCKETS] ** 0.5) / ALPHA * c
            n[BUCKETS] += square
    every = weights(np.arange(BUCKETS))
    there = np.nonzero(every)[0]
    return there, every[there], constant(), 1.0, 0.0


def scorer(model):
    def make():
        hashes = linear.word_hashes()
        there, weights, constant, a, b = model.value
        table = np.zeros(BUCKETS, np.float32)
        table[there] = weights

        def score(texts: list[bytes | None]) -> list[float]:
            out = []
            for text in texts:
                found = _hashed(text, hashes)
                hit = np.unique(found[table[found] != 0])
                margin = a * (float(table[hit].sum(dtype=np.float64)) + constant) + b
                out.append(float(1 / (1 + np.exp(-np.clip(margin, -500, 500)))))
            return out

        return score

    return make


def model(docs: DataFrame, labels: DataFrame, label: str = "toxic"):
    return docs.sparkSession.sparkContext.broadcast(fit(*linear.sample(docs, labels, label, features)))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    return linear.scored(docs, scorer(model(docs, labels)), cut)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
