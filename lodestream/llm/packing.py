"""Best-fit packing: pattern packing by non-negative least squares.

1. Every text is tokenised, gets the separator id 0, and is cut into pieces of at most ``LENGTH`` ids (only longer ones).
2. The histogram of piece lengths (``LENGTH`` counters at most, whatever the input) goes to the driver. Patterns of two
   or three lengths that fill a sequence exactly are enumerated over the lengths that occur; repeat counts are fitted to
   the histogram by weighted non-negative least squares (projected gradients with momentum); rounded counts are taken,
   largest first, as far as the histogram has pieces. Full-length pieces are sequences of their own.
3. Residuals are packed by best fit on the histogram itself: the longest remaining length opens a pattern, the longest
   length that still fits is added again and again, and the pattern is repeated until one of its lengths runs out. So the
   work is bounded by the number of lengths, not of pieces.
4. Patterns are written as intervals of ranks: pieces ``lo <= rank < hi`` of a length go to consecutive sequences. Pieces
   are ranked within their length by salted windows (a hot length is dealt over as many groups as it needs), and each
   piece finds its interval by binary search in a broadcast table. Its size is bounded by ``LENGTH`` alone: there are
   about LENGTH ** 2 / 12 exact patterns, and each residual pattern uses up a length.

Defined results: a null or empty text is the separator alone (one piece of one id). Repeated rows and ids are packed as
often as they occur. Null doc_ids are kept. An empty table gives no rows. Of pieces of one length, which one goes to which
sequence is open (ties). A very long text is cut into as many pieces as it needs. Other columns pass through :func:`pack`,
whatever their names; ``sequence_id`` and ``offset`` of its input are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import load, materialize, sliced, utf8
from .tokens import Ids, read_vocabulary

LENGTH = 2048
SEPARATOR = 0
STEPS = 300
#: Pieces in one ranking group, about.
GROUP = 512


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids`` for each piece of each document; ``ids`` is little-endian u32, and
    left out if not asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, step = Ids(sent.value), struct.pack("<I", separator), 4 * length
        for batch in sliced(batches):
            rows, numbers, parts = [], [], []
            for row, text in enumerate(utf8(batch.column(1))):
                ids = ids_of(text) + end
                for number, at in enumerate(range(0, len(ids), step)):
                    rows.append(row)
                    numbers.append(number)
                    parts.append(ids[at : at + step])
            number = np.array(numbers, np.int32)
            made = {"doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "piece": pa.array(number), "start": pa.array(number.astype(np.int64) * length)}
            made |= {"length": pa.array([len(x) // 4 for x in parts], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64())}
            if with_ids:
                made["ids"] = pa.array(parts, pa.binary())
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    schema = f"doc_id {wanted.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return wanted.mapInArrow(cut, schema + ", ids binary" * with_ids)


def _exact_patterns(lengths: np.ndarray, full: int) -> np.ndarray:
    """All (a, b, c) of occurring lengths with a >= b >= c >= 0 and a + b + c == full; c is 0 in patterns of two."""
    there = np.zeros(full + 1, bool)
    there[lengths] = True
    out = []
    for a in lengths[lengths < full]:
        b = lengths[(lengths <= a) & (lengths <= full - a)]
        c = full - a - b
        good = (c <= b) & ((c == 0) | there[c])
        out.append(np.stack([np.full(good.sum(), a), b[good], c[good]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 with the least squares of w * (A x - histogram); long lengths weigh more, as they are harder to place."""
    full = len(histogram) - 1
    weight = (np.arange(full + 1) / full + 0.05) ** 2
    weight[0] = 0.0
    columns = [np.ascontiguousarray(patterns[:, i]) for i in range(3)]

    def made(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c, x, full + 1) for c in columns)

    scale = max(1.0, float(histogram.max()))
    target = histogram / scale
    # a bound of the largest eigenvalue of A'WA: its largest absolute row sum
    bound = made(np.ones(len(patterns)))
    weighted = weight * bound
    step = 1.0 / max(1e-9, float(sum(weighted[c] for c in columns).max()))
    # A'WA has rows of very different sums, so each pattern gets its own step
    own = 1.0 / np.maximum(1e-9, sum(weighted[c] for c in columns))
    own = np.maximum(own, step)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        miss = weight * (made(y) - target)
        new = np.maximum(0.0, y - own * sum(miss[c] for c in columns))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x * scale


def plan(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: pieces of it}, repeats) that use up the histogram (index: length)."""
    full = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    if left[full]:
        out.append(({full: 1}, int(left[full])))
        left[full] = 0
    patterns = _exact_patterns(np.nonzero(left)[0], full)
    if len(patterns):
        counts = np.rint(fit_counts(patterns, left)).astype(np.int64)
        used = np.nonzero(counts)[0]
        for k in used[np.argsort(-counts[used], kind="stable")]:
            need: dict[int, int] = {}
            for n in patterns[k].tolist():
                if n:
                    need[n] = need.get(n, 0) + 1
            repeats = min(int(counts[k]), *(int(left[n]) // c for n, c in need.items()))
            if repeats > 0:
                out.append((need, repeats))
                for n, c in need.items():
                    left[n] -= c * repeats
    for longest in range(full - 1, 0, -1):
        while left[longest]:
            need, gap = {longest: 1}, full - longest
            for n in np.nonzero(left[: gap + 1])[0][::-1].tolist():
                if n <= gap and (fits := min(gap // n, int(left[n]) - need.get(n, 0))) > 0:
                    need[n] = need.get(n, 0) + fits
                    gap -= fits * n
            repeats = min(int(left[n]) // c for n, c in need.items())
            out.append((need, repeats))
            for n, c in need.items():
                left[n] -= c * repeats
    return out


def intervals(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Rank intervals sorted by (length, lo): pieces of a length with lo <= rank < hi go, ``each`` to a sequence, to the
    sequences from ``base`` on, at ``offset``."""
    rows, ranks, base = [], {}, 0
    for need, repeats in patterns:
        offset = 0
        for n, each in sorted(need.items(), reverse=True):
            lo = ranks.get(n, 0)
            rows.append((n, lo, base, each, offset))
            ranks[n] = lo + each * repeats
            offset += n * each
        base += repeats
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {name: np.ascontiguousarray(table[:, i]) for i, name in enumerate(("length", "lo", "base", "each", "offset"))}


def pack(pieces_table: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table with a ``length`` column (1 to ``length``)."""
    spark = pieces_table.sparkSession
    columns = [c for c in pieces_table.columns if c not in ("sequence_id", "offset")]
    rows = pieces_table.select(F.struct(*columns).alias("row"), F.col("length"), F.monotonically_increasing_id().alias("uid"))
    counted = materialize(rows, "pieces")
    histogram = np.zeros(length + 1, np.int64)
    for n, count in counted.groupBy("length").count().collect():  # LENGTH rows at most
        histogram[n] = count
    found = intervals(plan(histogram))
    total = int(histogram.sum())
    size = max(group, -(-total // 50_000))  # so that there are at most 50,000 groups more than lengths
    of_length = F.element_at(F.from_json(F.lit(str(histogram.tolist())), "array<bigint>"), F.col("length").cast("int") + 1)
    salted = counted.withColumn("grp", F.pmod(F.xxhash64("uid"), F.greatest(F.lit(1), F.ceil(of_length / F.lit(size))).cast("long")))
    ahead, firsts = {}, {}
    for n, g, count in sorted(map(tuple, salted.groupBy("length", "grp").count().collect())):  # as many rows as groups
        firsts[n, g] = ahead.get(n, 0)
        ahead[n] = firsts[n, g] + count
    keys = sorted(firsts)
    sent = spark.sparkContext.broadcast((found, np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64), np.array([firsts[k] for k in keys], np.int64)))
    ranked = salted.withColumn("local", F.row_number().over(Window.partitionBy("length", "grp").orderBy("uid")) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of_length, of_group, first = sent.value
        key = table["length"] << 44 | table["lo"]
        group_key = of_length << 32 | of_group
        for batch in batches:
            n, grp, local = (batch.column(x).to_numpy().astype(np.int64) for x in ("length", "grp", "local"))
            rank = first[np.searchsorted(group_key, n << 32 | grp)] + local
            at = np.searchsorted(key, n << 44 | rank, side="right") - 1
            inside = rank - table["lo"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.column("row").flatten(), pa.array(table["base"][at] + inside // table["each"][at]), pa.array(table["offset"][at] + inside % table["each"][at] * n)],
                names=[*columns, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{c}` {pieces_table.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select("row", "length", "grp", "local").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of the documents with their places; the ids themselves are left out (see :func:`pieces`)."""
    return pack(pieces(docs, vocabulary, length, with_ids=False), length)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
