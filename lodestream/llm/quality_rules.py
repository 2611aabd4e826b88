"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

The method: two multinomials over hashed n-grams of ``GRAM`` bytes (``BUCKETS`` buckets, add-``SMOOTHING``), one of all
documents and one of trusted ones (labelled quality 1). A text's score is the sum over its n-grams of
log(p_trusted / p_raw), divided by the number of n-grams. Every document is held against one threshold: a low quantile of
the trusted documents' own scores less a margin. The corpus counts cover all documents, the trusted counts and the threshold
all documents labelled quality 1. Scores are written once, before the verdict, and the threshold is their exact quantile.
Trusted ids are broadcast if there are ``SMALL`` of them at most, which are counted first; more are joined by a shuffle, of
texts for the counts and of scores for the threshold.

Defined results: null, empty and wordless texts have no words and fail the base rule on length. Repeated ids get a row
each. Only the id and text columns are read, so others, whatever their names, play no part. A corpus without trusted labels
has no ratio: then all pass the threshold. A score that equals the threshold passes (ties). A text of less than ``GRAM``
bytes scores 0. A very long text is counted and scored whole, apart from others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Memo, count_array, discard, load, materialize, sliced, utf8

GRAM = 4
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Trusted ids of a broadcast at most.
SMALL = 1 << 18
QUANTILE, MARGIN = 0.002, 0.05
MIN_WORDS, MOST_REPEATED = 50, 50
#: Bins that scores are counted in at a time.
BINS = 4096
_STEP = 4 << 20

_CONTINUED = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"
_NO_SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>")


def base_counts(text: bytes | None, hashes: Memo) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    n = len(words)
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                duplicates += 1
            seen.add(line)
    repeated = 0
    if n > 3:
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        windows = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            hit = np.zeros(n, bool)
            starts = order[np.append(same, False) | np.append(False, same)]
            for k in range(3):
                hit[starts + k] = True
            repeated = int(hit.sum())
    return n, len(text.translate(None, _CONTINUED)), len(text.translate(None, _NO_SYMBOL)), duplicates, repeated


def _groups(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of a few MB together, or one longer text, so that working memory stays bounded."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= _STEP:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts in a row, and how many each text has."""
    data = b"".join(x or b"" for x in texts)
    sizes = np.array([len(x or b"") for x in texts], np.int64)
    counts = np.maximum(0, sizes - (GRAM - 1))
    if len(data) < GRAM:
        return np.zeros(0, np.int64), counts
    codes = np.ndarray((len(data) - GRAM + 1,), "<u4", data, strides=(1,))
    buckets = (codes * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    for k in range(1, GRAM):  # an n-gram that begins in the last GRAM - 1 bytes of a text reaches into the next
        at = ends[sizes >= k] - k
        inside[at[at < len(codes)]] = False
    return buckets[inside], counts


class Ratio:
    def __init__(self, table: np.ndarray):
        self.table = table.astype(np.float32)

    def __call__(self, texts: list[bytes | None]) -> list[float]:
        out: list[float] = []
        for a, b in _groups(texts):
            buckets, counts = grams(texts[a:b])
            total = np.append(0.0, np.cumsum(self.table[buckets], dtype=np.float64))
            ends = np.cumsum(counts)
            out += ((total[ends] - total[ends - counts]) / np.maximum(1, counts)).tolist()
        return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def _joinable(trusted: DataFrame) -> DataFrame:
    """The ids to be broadcast, or else to be hashed in the partitions of a shuffle, so that texts aren't sorted."""
    return trusted.hint("broadcast" if trusted.limit(SMALL + 1).count() <= SMALL else "shuffle_hash")


def fit(texts: DataFrame, trusted: DataFrame) -> np.ndarray | None:
    """The log-ratio of each bucket; none if trusted documents have no n-gram."""

    def counter():
        def add(batch: pa.RecordBatch, counts: np.ndarray) -> None:
            values, good = utf8(batch.column(0)), batch.column(1).to_pylist()
            for a, b in _groups(values):
                buckets, sizes = grams(values[a:b])
                counts[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                counts[BUCKETS:] += np.bincount(buckets[np.repeat(np.array([bool(x) for x in good[a:b]]), sizes)], minlength=BUCKETS)

        return add

    marked = texts.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left").select("text", "trusted")
    counts = count_array(marked, counter, 2 * BUCKETS).reshape(2, BUCKETS)
    if not counts[1].any():
        return None
    share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(share[1]) - np.log(share[0])


def quantile(scores: DataFrame, share: float) -> float:
    """The exact quantile of the column ``score``, as numpy's: each pass counts the scores in ``BINS`` bins and goes on with
    the bin that holds the rank, until it holds one value. The driver gets a row of each bin."""

    def ranked(rank: int, low: float, high: float) -> float:
        while low < high:
            place = F.least(F.floor((F.col("score") - low) / F.lit(high - low) * BINS), F.lit(BINS - 1))
            rows = scores.where(F.col("score").between(low, high)).groupBy(place.alias("place"))
            for _, n, low, high in sorted(rows.agg(F.count("*"), F.min("score"), F.max("score")).collect()):  # noqa: B007
                if rank < n:
                    break
                rank -= n
        return low

    n, low, high = scores.agg(F.count("*"), F.min("score"), F.max("score")).first()
    at = share * (n - 1)
    return float(np.quantile([ranked(k, low, high) for k in (int(at), min(int(at) + 1, n - 1))], at - int(at)))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``score`` and ``kept`` for each document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    trusted = _joinable(trusted_ids(labels))
    table = fit(texts, trusted)
    judged = materialize(judge_texts(texts, np.zeros(BUCKETS) if table is None else table), "judged")
    threshold = float("-inf")
    if table is not None:
        own = materialize(judged.join(trusted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("score").alias("score")), "own")
        threshold = quantile(own, QUANTILE) - MARGIN
        discard(own)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def judge_texts(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """Base counts and verdict, and the score, of each document."""
    sent = texts.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, hashes = Ratio(sent.value), Memo(xxhash.xxh3_64_intdigest)
        for batch in sliced(batches):
            values = utf8(batch.column(1))
            counts = np.array([base_counts(x, hashes) for x in values], np.int64).reshape(-1, 5)
            scores = np.array(ratio(values))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            columns = [batch.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(judge, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
