"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A window is ``WINDOW`` consecutive words of a benchmark item (an item with fewer words, but not none, is one window).
Windows are searched in whole document texts. For each window length ``m`` there is one search table: a block is the
last two words at a text position (one word if ``m`` is 1); the block shift table tells how far the search may skip;
where the shift is 0, the block's hash bucket lists the windows that end with it, and comparison confirms them.

Defined results: null or empty text and text without words have no words and no hits. A null ``item_id`` is reported as
no id but its words count as hits. Repeated ``item_id`` values count as one item. Repeated documents get a row each.
Windows that occur in several items count for each of them, and overlapping hits count each word once. An empty benchmark
gives rows without hits, an empty table no rows.
Only the named id and text columns are read, so other columns, whatever their names, play no part; in
:func:`drop_contaminated` they pass through. Very long texts are searched whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import load, materialize, sliced, utf8

WINDOW = 10
#: Benchmark text in one search table at most, in bytes. More is searched in further passes, block by block.
BLOCK_BYTES = 2 << 20

#: ASCII letters and digits (upper case folded) and all bytes of non-ASCII characters are word bytes; others separate.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WordSearch:
    """Wu-Manber tables for windows of ``m`` words each."""

    def __init__(self, m: int):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}

    def add(self, words: list[bytes], item: int) -> None:
        for end in range(self.block, self.m + 1):
            block = tuple(words[end - self.block : end]) if self.block > 1 else words[end - 1]
            self.shift[block] = min(self.shift.get(block, self.most), self.m - end)
        self.buckets.setdefault(block, {}).setdefault(tuple(words), set()).add(item)

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[int]) -> None:
        m, most, shift, n = self.m, self.most, self.shift.get, len(words)
        at = m - 1
        while at < n:
            block = (words[at - 1], words[at]) if self.block > 1 else words[at]
            if skip := shift(block, most):
                at += skip
                continue
            found = self.buckets[block].get(tuple(words[at - m + 1 : at + 1]))
            if found:
                spans.append((at - m + 1, at + 1))
                items |= found
            at += 1


def _tables(texts: list[bytes | None], window: int) -> list[WordSearch]:
    tables: dict[int, WordSearch] = {}
    for item, text in enumerate(texts):
        words = words_of(text)
        m = min(window, len(words))
        for start in range(len(words) - m + 1 if m else 0):
            tables.setdefault(m, WordSearch(m)).add(words[start : start + m], item)
    return list(tables.values())


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[str | None], list[bytes | None]]]:
    """The benchmark in parts of at most ``BLOCK_BYTES`` of text (or one item), streamed to the driver part by part."""
    ids: list[str | None] = []
    texts: list[bytes | None] = []
    size = 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        data = None if row[1] is None else bytes(row[1])
        if ids and size + len(data or b"") > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(data)
        size += len(data or b"")
    yield ids, texts


_HIT = "n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its id, ``n_words``, merged hit ``spans`` (word positions, end exclusive), ``item_ids``."""
    spark = docs.sparkSession
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {wanted.schema['doc_id'].dataType.simpleString()}, {_HIT}"
    parts = _blocks(benchmark, item_col, item_text_col)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _search(wanted, first, schema, window, spark)
    # a benchmark larger than one table: a pass for each part, of which two at most are held here
    held = materialize(wanted.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "docs")
    return _many(held, chain((first, second), parts), schema, window, spark)


def _many(held: DataFrame, parts: Iterator, schema: str, window: int, spark: SparkSession) -> DataFrame:
    total = None
    for part in parts:
        hits = materialize(_search(held, part, f"row long, {schema}", window, spark, ["row"]).select("row", "doc_id", "n_words", "spans", "item_ids"), "hits")
        total = hits if total is None else total.unionByName(hits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(name) for name in ("doc_id", "n_words")}
            spans = [_merged([(s["start"], s["end"]) for part in row for s in part]) for row in batch.column("spans").to_pylist()]
            ids = [sorted({i for part in row for i in part}) for row in batch.column("item_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([cols["doc_id"], cols["n_words"], pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPAN), pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "item_ids"])

    # one row per document and benchmark block: as many as there are blocks
    grouped = total.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("item_ids").alias("item_ids")).drop("row")
    return grouped.mapInArrow(merge, schema)


def _search(docs: DataFrame, part: tuple, schema: str, window: int, spark: SparkSession, keep: list[str] | None = None) -> DataFrame:
    sent = spark.sparkContext.broadcast(part)  # at most BLOCK_BYTES, or one item

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = sent.value
        tables = _tables(texts, window)
        for batch in sliced(batches):
            counts, all_spans, all_items = [], [], []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                spans: list[tuple[int, int]] = []
                items: set[int] = set()
                for table in tables:
                    table.search(words, spans, items)
                counts.append(len(words))
                all_spans.append([{"start": a, "end": b} for a, b in _merged(spans)])
                all_items.append(sorted({ids[i] for i in items if ids[i] is not None}))
            names = [*(keep or []), "doc_id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(counts, pa.int64()), pa.array(all_spans, _SPAN), pa.array(all_items, pa.list_(pa.string()))], names=[*names, "n_words", "spans", "item_ids"])

    return docs.mapInArrow(search, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, all columns as they are, without those in which any benchmark window occurs."""
    spark = docs.sparkSession
    kept = docs
    for number, part in enumerate(_blocks(benchmark, benchmark.columns[0], item_text_col)):
        sent = spark.sparkContext.broadcast(part)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tables = _tables(sent.value[1], window)
            for batch in sliced(batches):
                mask = []
                for text in utf8(batch.column(batch.schema.names.index(text_col))):
                    words, spans, items = words_of(text), [], set()
                    for table in tables:
                        table.search(words, spans, items)
                    mask.append(not spans)
                yield batch.filter(pa.array(mask, pa.bool_()))

        kept = (materialize(kept, "clean") if number else kept).mapInArrow(clean, docs.schema)
    return kept


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
gram AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, i, m FROM gram JOIN win USING (m, g)),
per AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN per USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
