"""Token-ID output: patched frame-of-reference blocks.

A segment holds whole documents, in ascending order of their ids. Its bytes, all little-endian::

    magic "PFR1" | u32 documents | u64 ids | u32 blocks | u32 bytes of packed data | u32 exceptions
    u32[documents]   ids of each document, its end id included
    u64[blocks]      index: where each block's packed data starts, in bytes
    u32[blocks]      block minimum
    u8[blocks]       packed width in bits
    u32[blocks+1]    index: the first exception of each block
    u8[...]          packed data: (id - minimum), the low ``width`` bits of each
    u16[exceptions]  place within its block
    u32[exceptions]  id - minimum

A block has ``BLOCK`` ids (the last is padded with its first id). Its width is the bit length of the ``PERCENTILE``-th
percentile of (id - minimum); ids that need more bits are in the exception list. The block index lets a reader decode
any block alone (:func:`read_block`).

Segments are rows of a Parquet table, so that any store Spark can write to may hold them and a task that is run again
replaces its own rows. Documents are dealt by ranges of their ids; the place of a segment in the whole is its range
number and number within it.

Defined results: a null text counts as empty and gives the end id alone. Null doc_ids come first. Repeated ids are
ordered by their texts' hashes and get a row each (repeated texts of one id in any order). An empty table gives no segments
and no rows. Only the id and text columns are read. A very long text is one segment, for which its task needs about 20
bytes an id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import load, materialize, utf8
from .tokens import Ids, read_vocabulary

BLOCK = 256
PERCENTILE = 95
#: A segment is closed when it has so many ids; a single longer document is one segment.
SEGMENT_IDS = 1 << 17
END_ID = 1
#: Words whose ids a worker remembers.
MEMO = 400_000
_HEAD = struct.Struct("<4sIQIII")


def encode_segment(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // block)
    values = np.empty(blocks * block, np.uint32)
    values[:n] = ids
    if blocks:
        values[n:] = values[(blocks - 1) * block]
    values = values.reshape(blocks, block)
    low = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    values = values - low[:, None]
    at = min(block - 1, int(block * percentile / 100))
    high = np.partition(values, at, axis=1)[:, at] if blocks else low
    width = np.zeros(blocks, np.uint8)
    for bit in range(32):
        width[high >> bit > 0] = bit + 1
    over = values >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0
    over &= (width < 32)[:, None]
    row, place = np.nonzero(over)
    starts = np.zeros(blocks, np.uint64)
    np.cumsum(width[:-1].astype(np.uint64) * (block // 8), out=starts[1:])
    packed = np.zeros(int(width.astype(np.int64).sum()) * (block // 8), np.uint8)
    for w in np.unique(width):
        if w:
            chosen = np.nonzero(width == w)[0]
            bits = ((values[chosen][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            data = np.packbits(bits.reshape(len(chosen), -1), axis=1, bitorder="little")
            packed[(starts[chosen].astype(np.int64)[:, None] + np.arange(data.shape[1])).ravel()] = data.ravel()
    firsts = np.searchsorted(row, np.arange(blocks + 1)).astype("<u4")
    return b"".join(
        [
            _HEAD.pack(b"PFR1", len(lengths), n, blocks, len(packed), len(row)),
            lengths.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), low.astype("<u4").tobytes(), width.tobytes(), firsts.tobytes(),
            packed.tobytes(), place.astype("<u2").tobytes(), values[row, place].astype("<u4").tobytes(),
        ]
    )


class Segment:
    """Views of a segment's parts; nothing is decoded yet."""

    def __init__(self, data: bytes):
        magic, docs, self.n, self.blocks, packed, exceptions = _HEAD.unpack_from(data)
        if magic != b"PFR1":
            raise ValueError("not a segment")
        at = _HEAD.size
        for name, kind, count in (("lengths", "<u4", docs), ("starts", "<u8", self.blocks), ("low", "<u4", self.blocks), ("width", "u1", self.blocks), ("firsts", "<u4", self.blocks + 1), ("packed", "u1", packed), ("places", "<u2", exceptions), ("values", "<u4", exceptions)):
            view = np.frombuffer(data, kind, count, at)
            setattr(self, name, view)
            at += view.nbytes

    def decode(self, chosen: np.ndarray | None = None, block: int = BLOCK) -> np.ndarray:
        """The ids of the chosen blocks (all by default), one row per block, padding included."""
        chosen = np.arange(self.blocks) if chosen is None else chosen
        out = np.zeros((len(chosen), block), np.uint32)
        for w in np.unique(self.width[chosen]):
            if w:
                rows = np.nonzero(self.width[chosen] == w)[0]
                size = int(w) * block // 8
                data = self.packed[self.starts[chosen[rows]].astype(np.int64)[:, None] + np.arange(size)]
                bits = np.unpackbits(data, axis=1, bitorder="little").reshape(len(rows), block, int(w))
                part = np.zeros((len(rows), block), np.uint32)
                for bit in range(int(w)):
                    part |= bits[:, :, bit].astype(np.uint32) << np.uint32(bit)
                out[rows] = part
        for k, b in enumerate(chosen) if len(chosen) < self.blocks else []:
            own = slice(self.firsts[b], self.firsts[b + 1])
            out[k, self.places[own]] = self.values[own]
        if len(chosen) == self.blocks:
            out[np.repeat(np.arange(self.blocks), np.diff(self.firsts.astype(np.int64))), self.places] = self.values
        return out + self.low[chosen][:, None]

    def ids(self) -> np.ndarray:
        return self.decode().ravel()[: self.n]


def read_block(data: bytes, number: int) -> np.ndarray:
    """The ids of one block, found through the block index."""
    segment = Segment(data)
    return segment.decode(np.array([number]))[0][: segment.n - number * BLOCK]


def write_segments(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode all documents and write the segment table: ``part, number, ahead, n_ids, doc_ids, segment``

    ``ahead`` is the number of ids that the same range has in earlier segments.
    ."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids_of, end = TaskContext.get().partitionId(), Ids(sent.value, MEMO), struct.pack("<I", end_id)
        number, ahead, names, held, size = 0, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            data = encode_segment(ids, np.array([len(x) // 4 for x in held], np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([ahead], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([data], pa.binary())], names=["part", "number", "ahead", "n_ids", "doc_ids", "segment"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                names.append(name)
                held.append(ids_of(text) + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield closed()
                    number, ahead, names, held, size = number + 1, ahead + size, [], [], 0
        if names:
            yield closed()

    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the number of ranges is fixed here so that range numbers are the partitions' numbers
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = wanted.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return materialize(dealt.mapInArrow(encode, f"part int, number int, ahead long, n_ids long, doc_ids array<{kind.simpleString()}>, segment binary"), "segments", row_group=8 << 20)


def read_segments(segments: DataFrame) -> DataFrame:
    """Decode a segment table: ``doc_id, start, n_tokens, ids_crc32`` for each document."""
    spark = segments.sparkSession
    # one row per range: as many as tasks wrote, not as many as documents
    totals = {r.part: r.n for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(totals):
        base[part], total = total, total + totals[part]
    sent = spark.sparkContext.broadcast(base)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.column("segment")[i].as_py())
                ids = segment.ids().astype("<u4", copy=False)
                lengths = segment.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                first = sent.value[batch.column("part")[i].as_py()] + batch.column("ahead")[i].as_py()
                view = memoryview(ids.tobytes())
                crcs = [zlib.crc32(view[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(starts + first), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_segments(write_segments(load(spark, sf_dir, "documents")))
