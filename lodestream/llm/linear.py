"""What the linear text classifiers share: labelled samples, hashed word features, scoring of whole tables.

A model is fitted on a bounded sample of labelled rows: of the labelled ids that may be learned from, the ``SAMPLE`` with
the smallest id hashes, and of these as many, in that order, as have ``SAMPLE_FEATURES`` features together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Memo, held_out, sliced, utf8

SAMPLE = 8_000
SAMPLE_FEATURES = 24_000_000
#: Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2

#: ``features(text, hashes)`` gives the distinct hashed features of a text, sorted.
Features = Callable[[bytes | None, Memo], np.ndarray]


def word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, most=150_000)  # a miss is cheap


def mixed(*parts: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit hash for each row of word hashes."""
    out = np.full(len(parts[0]), salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for part in parts:
        out = (out ^ part) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, features: Features, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels (0 or 1) of the sample, in the order of the ids' hashes."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", FOLDS, HELD_OUT))
    ids = ids.groupBy("doc_id").agg(F.max(label).alias("label")).withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")  # ``limit`` ids at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in sliced(batches):
            found = [features(x, hashes).astype("<u4").tobytes() for x in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["label", "at", "found"])

    made = texts.select("text", F.col("label").cast("int").alias("label"), "at").mapInArrow(extract, "label int, at long, found binary")
    ahead, rows, y = 0, [], []
    # one row of each id, should ids repeat in the documents
    for row in made.groupBy("at").agg(F.min("label").alias("label"), F.min("found").alias("found")).orderBy("at").toLocalIterator():
        ahead += len(row.found) // 4
        if ahead > SAMPLE_FEATURES:
            break
        rows.append(np.frombuffer(bytes(row.found), "<u4"))
        y.append(row.label)
    return rows, np.array(y, np.int64)


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of sigmoid(a * margin + b) by Newton's method on smoothed targets."""
    good, bad = int(y.sum()), int(len(y) - y.sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(1e-9, float(np.abs(margins).mean()))
    x = np.stack([margins / scale, np.ones(len(y))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-6 * w)
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
    return float(w[0] / scale), float(w[1])


def scored(docs: DataFrame, scorer: Callable[[], Callable[[list[bytes | None]], list[float]]], cut: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for batch in sliced(batches):
            values = np.array(of(utf8(batch.column(1))), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array((values >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    made = texts.mapInArrow(score, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return made.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", "predicted")


def kept(docs: DataFrame, scorer: Callable[[], Callable[[list[bytes | None]], list[float]]], cut: float, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches ``cut``, all columns as they are."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for batch in sliced(batches):
            yield batch.filter(pa.array([x >= cut for x in of(utf8(batch.column(at)))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
