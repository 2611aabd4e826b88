"""Helpers shared by the training-data operators: scratch tables, text access, counting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word patterns ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on the same six bytes.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
#: Spark's setting by which an execution's shuffle files are deleted when it ends, without waiting for a driver GC.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one local
    process (tests, notebooks) a temporary folder is made and kept in the session's setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestream"


def materialize(df: DataFrame, name: str, row_group: int = 32 << 20) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return the table.

    This cuts the lineage: a lost executor costs a re-read, never a re-run of what made the table. The write's shuffle files go
    when it ends, as nothing else refers to them; the session's setting is put back.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", row_group).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so after a driver GC.

    The driver's JVM hears from a background thread, once a second, of plans that Python let go. Called between the large
    steps of an operator, not after each table. What the driver has freed goes back to the system, see :func:`trim`.
    """
    gc.collect()
    time.sleep(1.1)
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Give the memory that the driver's Python and JVM have freed, and malloc keeps, back to the system; whether both did.

    Each plan is compiled on the driver, by threads that allocate from malloc arenas of their own, which glibc doesn't
    shrink; so a driver that runs many plans grows by memory that nothing uses. Where libc or the JVM has no such call
    nothing is done.
    """
    try:
        ctypes.CDLL(None).malloc_trim(0)
        gateway, jvm = spark.sparkContext._gateway, spark._jvm
        # by the interface's method, as the server's own class isn't open to reflection
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        values = gateway.new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except (AttributeError, OSError, Py4JError):
        return False
    return True


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for parent in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Rows that a task works on at once.
ROWS = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what a task makes of them is small beside the batch that Spark sent."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_mod(doc_id: object, mod: int) -> int:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def held_out(id_col: str, mod: int, rest: int):
    """Column: the row is held out of the fitting."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == rest


class Memo(dict):
    """Function values by word. Long words are not kept.

    A full memo keeps what it has, as frequent words come early; after ``8 * most`` further misses it starts anew.
    So memory stays bounded.
    """

    def __init__(self, function: Callable[[bytes], object], most: int = 400_000, longest: int = 48):
        super().__init__()
        self.function, self.most, self.longest, self.missed = function, most, longest, 0

    def __missing__(self, word: bytes):
        value = self.function(word)
        if len(self) < self.most:
            if len(word) <= self.longest:
                self[word] = value
        else:
            self.missed += 1
            if self.missed > 8 * self.most:
                self.clear()
                self.missed = 0
        return value


# ---------------------------------------------------------------- counting into fixed-size arrays

_CHUNK = 1 << 13


def _blobs(counts: np.ndarray, task: int) -> pa.RecordBatch:
    """One row for each chunk of the task's counters that is not all zero."""
    parts = counts.reshape(-1, min(_CHUNK, len(counts)))
    keep = [i for i in range(len(parts)) if parts[i].any()]
    return pa.RecordBatch.from_arrays(
        [pa.array(keep, pa.int32()), pa.array([task] * len(keep), pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in keep], pa.binary())],
        names=["chunk", "task", "counts"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the blobs of each chunk; memory: one array for each chunk that the partition holds."""
    sums: dict[int, np.ndarray] = {}
    task = 0
    for batch in batches:
        for chunk, task, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):  # noqa: B007
            part = np.frombuffer(zlib.decompress(blob), np.int64)
            if chunk in sums:
                sums[chunk] += part
            else:
                sums[chunk] = part.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([task] * len(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())],
        names=["chunk", "task", "counts"],
    )


def count_array(df: DataFrame, counter: Callable[[], Callable[[pa.RecordBatch, np.ndarray], None]], size: int) -> np.ndarray:
    """Sum over all rows of what ``counter()(batch, counts)`` adds to ``counts``, an int64 array of ``size`` places.

    The array has a fixed size whatever the input, so it may go to the driver. Each task sends one blob for each
    of ``size / 8192`` chunks; blobs are added in two rounds (first by chunk and task modulo 64, then by chunk), as
    streams, so neither a task nor the driver ever holds the blobs of all tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        add, counts = counter(), np.zeros(size, np.int64)
        for batch in batches:
            add(batch, counts)
        yield _blobs(counts, TaskContext.get().partitionId() % 64)

    schema = "chunk int, task int, counts binary"
    first = df.mapInArrow(count, schema).repartition("chunk", "task").mapInArrow(_added, schema)
    rows = first.repartition("chunk").mapInArrow(_added, schema).collect()
    out = np.zeros(size, np.int64)
    width = min(_CHUNK, size)
    for row in rows:
        out[row.chunk * width : (row.chunk + 1) * width] += np.frombuffer(zlib.decompress(bytes(row.counts)), np.int64)
    return out
