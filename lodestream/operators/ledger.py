"""Costs, quotas and usage windows."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def price_cost(tokens: Column, cached: Column, written: Column, output: Column, price: str = "") -> Column:
    """Cost at prices per million tokens; columns ``input, output, cached_input, cache_write`` (null: the input price)."""
    p = lambda name: F.col(f"{price}{name}")
    plain = tokens - cached - written
    return (plain * p("input") + cached * F.coalesce(p("cached_input"), p("input")) + written * F.coalesce(p("cache_write"), p("input")) + output * p("output")) / F.lit(1_000_000)


def price_key(model: Column, tier: Column) -> Column:
    return F.when(tier.isNull() | (tier == "standard"), model).otherwise(F.concat_ws("@", model, tier))


def cost_on_error(status: Column, reserved: Column) -> Column:
    """A refused call (4xx) costs nothing; any other failure counts as its worst case."""
    return F.when(status.between(400, 499), F.lit(0.0)).otherwise(reserved)


def counted_input(tokens: Column) -> Column:
    return F.floor(tokens * 1.1).cast("long") + 50


def local_day(ts: Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def sliding_usage(rows: DataFrame, key: str, ts: str, amount: str, seconds: int = 60) -> DataFrame:
    """Adds ``calls`` and ``used``: of the key, in the ``seconds`` up to each row (strictly younger than that).

    A key's rows are dealt by spans of 60 windows; each span also gets the rows of the window before it, which it counts
    but doesn't return. So no task has a whole key.
    """
    width = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    placed = rows.withColumn("_at", micros).withColumn("_span", F.floor(F.col("_at") / (60 * width)))
    late = F.col("_at") >= (F.col("_span") + 1) * (60 * width) - width
    spans = F.array(F.struct(F.col("_span").alias("span"), F.lit(True).alias("own")), F.when(late, F.struct((F.col("_span") + 1).alias("span"), F.lit(False).alias("own"))))
    dealt = placed.withColumn("_s", F.explode_outer(F.filter(spans, lambda s: s.isNotNull())))
    window = Window.partitionBy(key, F.col("_s.span")).orderBy("_at").rangeBetween(-(width - 1), 0)
    counted = dealt.withColumn("calls", F.count("*").over(window)).withColumn("used", F.sum(amount).over(window))
    return counted.where(F.col("_s.own")).drop("_at", "_span", "_s")


def running_total(rows: DataFrame, keys: list[str], order: list[str], amount: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(amount).over(window))


def admit(rows: DataFrame, key: str, order: str, amount: str, limit: float, total_limit: float | None = None) -> DataFrame:
    """Adds ``admitted``: a row is refused if what was admitted of its key before it and itself exceed ``limit``, or all
    that was admitted and itself exceed ``total_limit``.

    Refused rows don't count, so this is a fold in order: over sorted Arrow batches of a key's rows, with one number of
    state for each key. A total limit puts all rows in one order, and so in one task. Null amounts count as 0.
    """
    schema = StructType([*rows.schema.fields, StructField("admitted", BooleanType())])
    at, by = rows.columns.index(amount), rows.columns.index(key)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent: dict = {}
        total, last = 0.0, None
        for batch in batches:
            out = []
            for k, x in zip(batch.column(by).to_pylist(), batch.column(at).to_pylist(), strict=True):
                x = float(x or 0)
                if total_limit is None and k != last:  # keys come one after the other
                    spent, last = {}, k
                good = spent.get(k, 0.0) + x <= limit and (total_limit is None or total + x <= total_limit)
                if good:
                    spent[k] = spent.get(k, 0.0) + x
                    total += x
                out.append(good)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "admitted"])

    sorted_rows = rows.repartition(key).sortWithinPartitions(key, order) if total_limit is None else rows.coalesce(1).sortWithinPartitions(order, key)
    return sorted_rows.mapInArrow(fold, schema)


# The ledger -----------------------------------------------------------------------------------------------------

#: Columns of the ledger, and what older files that lack one mean.
LEDGER = {"day": ("date", None), "ts": ("timestamp", None), "provider": ("string", "openai"), "model": ("string", None), "cost_usd": ("double", 0.0), "input_tokens": ("long", 0), "output_tokens": ("long", 0)}


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; columns that came later have their defaults in older files."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return rows.select(*((F.coalesce(F.col(c), F.lit(d)) if d is not None else F.col(c)).cast(kind).alias(c) if c in rows.columns else F.lit(d).cast(kind).alias(c) for c, (kind, d) in LEDGER.items()))


def settle(calls: DataFrame, path: str) -> None:
    """Append settled calls: with usage at their cost, else at what ``cost_on_error`` says (column cost_usd)."""
    calls.select(*(F.col(c).cast(kind) if c in calls.columns else F.lit(d).cast(kind).alias(c) for c, (kind, d) in LEDGER.items())).write.mode("append").parquet(path)


def spent(ledger: DataFrame, today: str) -> DataFrame:
    """``today, total`` as of the day given (the clock is the caller's)."""
    cost = F.coalesce(F.col("cost_usd"), F.lit(0.0))
    return ledger.agg(F.coalesce(F.sum(F.when(F.col("day") == F.lit(today).cast("date"), cost)), F.lit(0.0)).alias("today"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("total"))


def usage_since(ledger: DataFrame, since: Column) -> DataFrame:
    """``provider, model, calls, tokens`` of calls from an instant on, failed ones included."""
    return ledger.where(F.col("ts") >= since).groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


def quota(ledger: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """``provider, model, calls, tokens, calls_left, tokens_left`` in the current quota day of each profile (provider, model,
    zone, calls_per_day, tokens_per_day; null or 0: no limit, then nothing is left to say)."""
    start = F.to_utc_timestamp(F.to_timestamp(F.to_date(F.from_utc_timestamp(now, F.col("zone")))), F.col("zone"))
    named = profiles.select("provider", "model", "calls_per_day", "tokens_per_day", start.alias("since"))
    used = ledger.select("provider", "model", "ts", (F.col("input_tokens") + F.col("output_tokens")).alias("t")).join(F.broadcast(named), ["provider", "model"]).where(F.col("ts") >= F.col("since"))  # a row a model
    used = used.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum("t").alias("tokens"))
    rows = named.join(used, ["provider", "model"], "left").withColumns({"calls": F.coalesce("calls", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    left = lambda most, c: F.when(F.col(most) > 0, F.col(most) - F.col(c))
    return rows.select("provider", "model", "calls", "tokens", left("calls_per_day", "calls").alias("calls_left"), left("tokens_per_day", "tokens").alias("tokens_left"))


def fits_quota(calls_left: Column, tokens_left: Column, tokens: Column) -> Column:
    """A call of so many tokens may still be made."""
    return F.coalesce(calls_left > 0, F.lit(True)) & F.coalesce(tokens_left >= tokens, F.lit(True))


def usage_of(usage: Column) -> Column:
    """``calls, input_tokens, cached_input_tokens, cache_write_tokens, output_tokens, reasoning_tokens`` of a usage object (JSON
    text) of either kind of API. No usage: one call, no tokens."""
    n = lambda *paths: F.coalesce(*[F.get_json_object(usage, f"$.{p}").try_cast("long") for p in paths], F.lit(0).cast("long"))
    return F.struct(
        F.lit(1).cast("long").alias("calls"), n("input_tokens", "prompt_tokens").alias("input_tokens"),
        n("input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens").alias("cached_input_tokens"), n("input_tokens_details.cache_write_tokens").alias("cache_write_tokens"),
        n("output_tokens", "completion_tokens").alias("output_tokens"), n("output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"),
    )


class BudgetExceeded(RuntimeError):
    """A call could cost more than what is left."""


class Budgeted:
    """A client whose calls are reserved at their worst case and settled at their cost, within a day's and a project's limit.

    For the driver, which calls models one at a time or in threads. ``client(request)`` returns an answer and its cost;
    ``worst(request)`` is what it can cost. Errors with a ``status`` from 400 to 499 cost nothing, others their worst case.
    ``settled`` has a row for each call, to be appended to the ledger.
    """

    def __init__(self, client: Callable[[object], tuple[object, float]], worst: Callable[[object], float], day_limit: float, day_spent: float = 0.0, limit: float | None = None, total_spent: float = 0.0) -> None:
        self.client, self.worst, self.day_limit, self.limit = client, worst, day_limit, limit
        self.day_spent, self.total_spent, self.pending = day_spent, total_spent, 0.0
        self.settled: list[float] = []
        self.lock = threading.Lock()

    def reserve(self, amount: float) -> None:
        with self.lock:
            if self.day_spent + self.pending + amount > self.day_limit:
                raise BudgetExceeded(f"{self.day_spent:.4f} spent today; a call of up to {amount:.4f} passes the day's limit of {self.day_limit:.2f}")
            if self.limit is not None and self.total_spent + self.pending + amount > self.limit:
                raise BudgetExceeded(f"{self.total_spent:.4f} spent in all; a call of up to {amount:.4f} passes the limit of {self.limit:.2f}")
            self.pending += amount

    def settle(self, reserved: float, cost: float) -> None:
        with self.lock:
            self.pending = max(0.0, self.pending - reserved)
            self.day_spent += cost
            self.total_spent += cost
            self.settled.append(cost)

    def __call__(self, request: object) -> object:
        worst = self.worst(request)
        self.reserve(worst)
        try:
            answer, cost = self.client(request)
        except BaseException as error:
            refused = 400 <= (getattr(error, "status", None) or 0) < 500
            self.settle(worst, 0.0 if refused else worst)
            raise
        self.settle(worst, cost)
        return answer

    def stream(self, request: object, events: Callable[[object], Iterator[tuple[object, float | None]]]) -> Iterator[object]:
        """The parts of a streamed answer; the last one has the cost. A stream that ends without it costs its worst case."""
        worst = self.worst(request)
        self.reserve(worst)
        cost = None
        try:
            for part, known in events(request):
                cost = cost if known is None else known
                yield part
        finally:
            self.settle(worst, worst if cost is None else cost)
