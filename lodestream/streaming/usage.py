"""Streaming counterparts: windowed usage with late data, idempotent index updates, per-key admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_usage(events: DataFrame, key: str, ts: str, amount: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls and amount by key and tumbling window; events later than ``late`` are left out once a window is closed."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", width), key).agg(F.count("*").alias("calls"), F.sum(amount).alias("used")).select(F.col("window.start").alias("start"), key, "calls", "used")


def rate_admission(events: DataFrame, key: str, ts: str, amount: str, limit: float, seconds: int = 60, calls: int = 0, late: str = "10 seconds") -> DataFrame:
    """Adds ``admitted``: with it, the calls admitted in the last ``seconds`` are ``calls`` at most (0: any number) and their
    amounts ``limit`` at most (0: any).

    An event beyond the limit by itself is admitted into an empty window. A micro-batch's events of a key are judged in
    order of time, whatever order and frames they come in; events that come later than ``late`` may be dropped, and
    an event older than what was judged before is held against the admitted events of its own window. State: the admitted
    events of one window and the lateness; it is dropped when they are past the watermark.
    """
    rows = events.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col(amount).cast("double").alias("amount"))
    width = seconds * 1_000_000

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        parts = [f[["at", "amount"]] for f in frames]
        out = []
        for at, x in pd.concat(parts).sort_values("at", kind="stable").itertuples(index=False):
            near = [h for h in held if at - width < h[0] <= at]
            fits = (not calls or len(near) < calls) and (not limit or not near or sum(h[1] for h in near) + x <= limit)
            if fits:
                held.append((int(at), float(x)))
            out.append((group[0], int(at), float(x), bool(fits)))
        mark = state.getCurrentWatermarkMs() * 1000
        held = [h for h in held if h[0] > mark - width]
        if held:
            state.update(([h[0] for h in held], [h[1] for h in held]))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, (max(h[0] for h in held) + width) // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "at", "amount", "admitted"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(fold, f"key {kind}, at long, amount double, admitted boolean", "ats array<long>, amounts array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def settle_streams(events: DataFrame, late: str = "1 minute", patience: int = 90) -> DataFrame:
    """``call_id, charged, ended`` once for each call of a stream of answer events (call_id, kind, ts, reserved, cost).

    The terminal event (kind ``end``) carries the cost; a call whose terminal event isn't there ``patience`` seconds after its
    last event, by event time, is charged its reserved worst case. Later events of a call that was charged are dropped
    with the watermark.
    """
    rows = events.withWatermark("ts", late).select("call_id", "kind", "ts", F.unix_millis("ts").alias("at"), F.col("reserved").cast("double").alias("reserved"), F.col("cost").cast("double").alias("cost"))
    kind = rows.schema["call_id"].dataType.simpleString()

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["call_id", "charged", "ended"]
        if state.hasTimedOut:
            worst, _, done = state.get
            state.remove()
            if not done:
                yield pd.DataFrame([(group[0], worst, False)], columns=names)
            return
        worst, last, done = state.get if state.exists else (0.0, 0, False)
        found = pd.concat(list(frames)).sort_values("at", kind="stable")
        worst, last = max(worst, float(found["reserved"].fillna(0).max())), max(last, int(found["at"].max()))
        ends = found[found["kind"] == "end"]
        if len(ends) and not done:
            done = True
            cost = ends["cost"].iloc[0]
            yield pd.DataFrame([(group[0], worst if pd.isna(cost) else float(cost), True)], columns=names)
        state.update((worst, last, done))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last + patience * 1000))

    return rows.groupBy("call_id").applyInPandasWithState(fold, f"call_id {kind}, charged double, ended boolean", "worst double, last long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def replace_documents(path: str, doc: str, buckets: int = 64):
    """A ``foreachBatch`` sink: each batch's documents replace what the index under ``path`` has of them.

    The index is kept by buckets of the documents' hashes. The buckets that a batch touches are written beside the index
    and then put in their place, so a batch that is run again gives the same index.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return
        try:
            old = spark.read.parquet(path).where(F.col("bucket").isin(*touched)).select(*new.columns)
            new = old.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        staged = f"{path.rstrip('/')}-staged/{number}"
        new.write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return write
