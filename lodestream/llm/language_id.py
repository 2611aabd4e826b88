"""Language ID: word-first backoff.

A text's words are its runs of letters, lower-cased. A word that the model knows adds its smoothed log frequency in each
language. An unseen word falls back to its character n-grams (with a boundary mark at both ends): of the longest n, from
``LONGEST`` down to 1, of which the model knows any, the mean of the known n-grams' log frequencies is added; if none is
known, nothing. The language with the largest sum wins (ties: the first in order); the score is its share after a softmax
of the sums.

The model is learned from a bounded sample: about ``PER_LANGUAGE`` documents, and about ``LANGUAGE_BYTES`` of text, of each
language, those with the smallest hashes, of the rows that may be learned from. It holds every word and n-gram of the
sample; the sample's bytes bound its size, so it may be broadcast.

Defined results: null texts and texts without letters are ``und`` with score 0. Null langs and held-out rows teach
nothing; without any other rows all is ``und``, and an empty table gives no rows. Repeated ids get a row each. Very long
texts are scored whole, in parts of 100,000 words. A combining mark is no letter, so it parts a word. Only the id, text and
language columns are read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, load, sliced

LONGEST = 5
PER_LANGUAGE = 2_000
LANGUAGE_BYTES = 8 << 20
FOLDS, HELD_OUT = 3, 1
#: Letters, and marks of numbers, which are dropped below.
_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    found = _WORDS(text.lower())
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[tuple[list[str], np.ndarray]]]:
    """Languages, and by n the n-grams (0: the words) and their log frequencies in each language."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", FOLDS, HELD_OUT))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()  # one row per language
    totals = {r.lang: min(1.0, PER_LANGUAGE / r.n, LANGUAGE_BYTES / max(1, r.size)) for r in sizes}
    langs = sorted(totals)
    if not langs:
        return [], []
    share = F.element_at(F.create_map(*[x for k, part in totals.items() for x in (F.lit(k), F.lit(part))]), F.col("lang"))
    taught = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, 0, w) for w in words_of(text))
            if len(counts) > 500_000:
                yield rows_of(counts)
                counts = Counter()
        yield rows_of(counts)

    def rows_of(counts: Counter) -> pa.RecordBatch:
        every = Counter(counts)
        for (lang, _, word), c in counts.items():
            for n in range(1, LONGEST + 1):
                for g in grams_of(word, n):
                    every[lang, n, g] += c
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in every], pa.string()), pa.array([k[1] for k in every], pa.int32()), pa.array([k[2] for k in every], pa.string()), pa.array(list(every.values()), pa.int64())], names=["lang", "kind", "gram", "n"])

    counted = taught.mapInArrow(count, "lang string, kind int, gram string, n long").groupBy("kind", "gram").pivot("lang", langs).agg(F.sum("n")).fillna(0)
    grams: list[list[str]] = [[] for _ in range(LONGEST + 1)]
    counts: list[array] = [array("q") for _ in range(LONGEST + 1)]
    for row in counted.select("kind", "gram", F.array(*[F.col(f"`{x}`") for x in langs]).alias("counts")).toLocalIterator():
        grams[row.kind].append(row.gram)
        counts[row.kind].extend(row.counts)
    return langs, [(known, _logs(np.array(n, np.float64).reshape(-1, len(langs)))) for known, n in zip(grams, counts, strict=True)]


def _logs(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 0.1
    return (np.log(smooth) - np.log(smooth.sum(axis=0))).astype(np.float32)


class Scorer(dict):
    """Places of words in a table of their evidence; a word not met before gets its place when it is looked up."""

    def __init__(self, langs: list[str], grams: list[tuple[list[str], np.ndarray]]):
        super().__init__()
        self.langs, self.logs = langs, [x[1] for x in grams]
        self.at = [dict(zip(x[0], range(len(x[0])), strict=True)) for x in grams]
        self.table = np.zeros((1 << 12, max(1, len(langs))), np.float32)

    def _evidence(self, word: str) -> np.ndarray:
        known = self.at[0].get(word)
        if known is not None:
            return self.logs[0][known]
        for n in range(LONGEST, 0, -1):
            found = [x for x in map(self.at[n].get, grams_of(word, n)) if x is not None]
            if found:
                return self.logs[n][found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self._evidence(word)
        self[word] = at
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for start in range(0, len(words), 100_000):
            if len(self) > 400_000:
                self.clear()
            places = list(map(self.__getitem__, words[start : start + 100_000]))
            total += self.table[places].sum(axis=0, dtype=np.float64)
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(*sent.value)
        for batch in sliced(batches):
            found = [score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    made = texts.mapInArrow(predict, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return made.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))
