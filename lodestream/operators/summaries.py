"""Reports over questions: retrieval, answers, judges, gold sets. Each is one aggregation over long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import normalize_for_match
from lodestream.operators.evaluation import by_dimensions, largest_remainder, latency_stats

# Fixed values -------------------------------------------------------------------------------------------------
METRICS = ("faithfulness", "citation_precision", "citation_recall", "correctness", "relevancy")
#: Tokens (in, out) of one call that an estimate counts with, and its limit.
ESTIMATES = {"answer": (3000, 500), "rewrite": (400, 100), "embedding": (60, 0), "judge": (5000, 3000)}
MOST_COST = 0.30
# --------------------------------------------------------------------------------------------------------------


def mean(c: Column | str) -> Column:
    """The mean of what is there, to four digits; null if nothing is."""
    return F.round(F.avg(c), 4)


def rate(part: Column, whole: Column) -> Column:
    """The share of rows with ``part`` among those with ``whole``; null if there are none."""
    return F.round(F.try_divide(F.count_if(part & whole), F.count_if(whole)), 4)


def mean_metrics(rows: DataFrame, metrics: list[str], dimensions: list[str]) -> DataFrame:
    """``dimension, value, n`` and the mean of each metric, over all rows and by each dimension."""
    return by_dimensions(rows, dimensions, F.count("*").alias("n"), *(mean(c).alias(c) for c in metrics))


def retrieval_summary(rows: DataFrame, metrics: list[str], dimensions: list[str], steps: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (mode, metrics, dimensions, times of steps, cost_usd, query_error, rerank_error, rewrite_method): the means
    by mode, dimension and value (rows without metrics are left out); times by mode and step; cost and errors by mode."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), (F.lit("all") if d == "all" else F.col(d).cast("string")).alias("value")) for d in ("all", *dimensions)])
    known = rows.where(F.col(metrics[0]).isNotNull()).withColumn("_d", F.explode(pairs))
    means = known.groupBy("mode", F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")).agg(F.count("*").alias("n"), *(mean(c).alias(c) for c in metrics))
    costs = rows.groupBy("mode").agg(
        F.round(F.avg("cost_usd"), 7).alias("cost_mean"), F.round(F.sum("cost_usd"), 5).alias("cost_total"),
        F.count("query_error").alias("query_errors"), F.count("rerank_error").alias("rerank_errors"), F.count_if(F.col("rewrite_method") == "concat_fallback").alias("rewrite_fallbacks"),
    )
    return means, step_times(rows, ["mode"], steps), costs


def step_times(rows: DataFrame, by: list[str], steps: list[str]) -> DataFrame:
    """``by, step, p50, p95, mean, max`` of the columns that hold the steps' times."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).cast("double").alias("ms")) for s in steps])).alias("t"))
    return long.select(*by, "t.step", "t.ms").groupBy(*by, "step").agg(*latency_stats("ms"))


def quality_measures() -> list[Column]:
    """Measures of answers, of columns ``answerable, abstained, hit, recall, context_precision`` (null: not answerable),
    ``invalid, malformed, warnings`` (arrays), ``status, judged`` and a column for each of METRICS (null: not judged)."""
    answerable, abstained, every = F.col("answerable"), F.col("abstained"), F.lit(True)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    measures = {
        "n": F.count("*"), "answerable": F.count_if(answerable), "unanswerable": F.count_if(~answerable),
        "correct_refusal": rate(abstained, ~answerable), "false_refusal": rate(abstained, answerable),
        "false_refusal_gold_in_context": rate(abstained & (F.col("hit") == 1), answerable),
        **{c: mean(F.when(answerable, F.col(c))) for c in ("hit", "recall", "context_precision")},
        "invalid_citation_rate": rate(some("invalid"), every), "malformed_citation_rate": rate(some("malformed"), every),
        "malformed_citations": F.sum(F.coalesce(F.size("malformed"), F.lit(0))), "answers_with_amendment_warning": F.count_if(some("warnings")),
        "failed_answers": F.count_if(F.col("status") == "failed"), "judged": F.count_if(F.col("judged")),
    }
    for metric in METRICS:
        measures |= {metric: mean(metric), f"{metric}_n": F.count(metric)}
    return [c.alias(name) for name, c in measures.items()]


def answer_summary(rows: DataFrame, dimensions: list[str], steps: list[str], tokens: list[str]) -> dict[str, DataFrame]:
    """``quality`` by dimension; ``latency`` by step; ``ttft`` of first turns and follow-ups; ``tokens`` (means) and
    ``cost`` (means and sums of pipeline_usd and judge_usd)."""
    turn = F.when(F.col("follow_up"), "follow_up").otherwise("first_turn").alias("turn")
    costs = [f(c).alias(f"{c}_{name}") for c in ("pipeline_usd", "judge_usd") for name, f in (("per_question", lambda x: F.round(F.avg(x), 6)), ("total", lambda x: F.round(F.sum(x), 4)))]
    return {
        "quality": by_dimensions(rows, dimensions, *quality_measures()),
        "latency": step_times(rows, [], steps),
        "ttft": rows.groupBy(turn).agg(F.count("*").alias("n"), *latency_stats("ttft")),
        "tokens": rows.agg(*(F.round(F.avg(c), 1).alias(c) for c in tokens)),
        "cost": rows.agg(*costs),
    }


def usage_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens of all kinds and cost, added up."""
    names = ("calls", "input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "cost_usd")
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in names))


# Judges -------------------------------------------------------------------------------------------------------


def judge_label(runs: Column, label: str = "correctness") -> Column:
    """The label of the first run without an error; null if there is none."""
    return F.try_element_at(F.filter(runs, lambda r: r["error"].isNull()), F.lit(1))[label]


def needs_judge(status: Column, runs: Column) -> Column:
    """The answer didn't fail, and no run so far is without an error."""
    return (status != "failed") & ~F.coalesce(F.exists(runs, lambda r: r["error"].isNull()), F.lit(False))


def consistent(runs: Column, label: str = "correctness") -> Column:
    """All runs without an error gave one label; false if there is no such run."""
    good = F.filter(F.coalesce(runs, F.filter(runs, lambda r: F.lit(False))), lambda r: r["error"].isNull())
    return F.coalesce(F.size(F.array_distinct(F.transform(good, lambda r: r[label]))) == 1, F.lit(False))


def consistency(judged: DataFrame, runs: str = "runs") -> DataFrame:
    """``n, same_label``: the share of questions whose runs agree."""
    return judged.agg(F.count("*").alias("n"), F.round(F.avg(consistent(F.col(runs)).cast("int")), 4).alias("same_label"))


def agreement(labels: DataFrame, judged: DataFrame) -> DataFrame:
    """``metric, n, agreement`` of people's labels (id, faithful, citations_ok, correctness, relevancy; null: not given)
    with judged answers (id, faithfulness, citation_precision, correctness, relevancy): pairs that lack a side don't count."""
    full = lambda c: F.when(F.col(c).isNotNull(), F.col(c) == 1.0).cast("string")
    j = judged.select("id", full("faithfulness").alias("j_f"), full("citation_precision").alias("j_c"), F.col("correctness").alias("j_k"), F.col("relevancy").alias("j_r"))
    binary = lambda c, yes: F.when(F.col(c).isNotNull(), F.col(c) == yes).cast("string")
    pairs = {
        "faithful": (F.col("faithful").cast("string"), F.col("j_f")), "citations_ok": (F.col("citations_ok").cast("string"), F.col("j_c")),
        "correctness": (F.col("correctness"), F.col("j_k")), "correctness_binary": (binary("correctness", "correct"), binary("j_k", "correct")),
        "relevancy": (F.col("relevancy"), F.col("j_r")), "relevancy_binary": (binary("relevancy", "relevant"), binary("j_r", "relevant")),
    }
    met = labels.join(j, "id").select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), a.alias("a"), b.alias("b")) for m, (a, b) in pairs.items()])).alias("p"))
    met = met.select("p.*").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return met.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 4).alias("agreement"))


def missing(wanted: DataFrame, there: DataFrame, key: str = "id") -> DataFrame:
    """Keys of ``wanted`` that ``there`` lacks: labels not given yet, samples not scored yet."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti")


def resume(samples: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The samples that have no score yet."""
    return samples.join(done.select(key), key, "left_anti")


def interleaved_sample(rows: DataFrame, kind: str, good: str, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """``n`` rows, by kind in proportion (largest remainders), in each kind the bad and the good in turns, bad ones first;
    when one side is used up the other goes on. Which rows of a side come first is by a hash of key and seed."""
    quotas = largest_remainder(rows.groupBy(kind).agg(F.count("*").alias("_rows")), "_rows", n, kind).select(F.col(kind).alias("_kind"), "quota")
    side = Window.partitionBy(kind, good).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    placed = rows.withColumn("_at", F.row_number().over(side))
    turn = Window.partitionBy(kind).orderBy("_at", F.col(good).cast("int"))
    placed = placed.withColumn("_turn", F.row_number().over(turn)).join(F.broadcast(quotas), F.col(kind) == F.col("_kind"))  # one row a kind
    return placed.where(F.col("_turn") <= F.col("quota")).select(*rows.columns)


def check_identity(saved: dict, current: dict, keys: tuple[str, ...] = ("provider", "model", "prompt_version", "service_tier")) -> None:
    """Judgments under another identity can't be mixed."""
    if wrong := [k for k in keys if saved.get(k) != current.get(k)]:
        raise ValueError(f"the saved judgments differ in {', '.join(wrong)}")


# Costs --------------------------------------------------------------------------------------------------------


def estimate_cost(questions: DataFrame, prices: dict[str, tuple[float, float]], judge_calls: int = 0, rewrites: bool = True) -> DataFrame:
    """``answers, judge, total`` (USD) that a run over ``questions`` (history) is expected to cost. ``prices``: for answer,
    rewrite, embedding and judge, of a million tokens in and out."""
    cost = {k: sum(t * p for t, p in zip(ESTIMATES[k], prices.get(k, (0.0, 0.0)), strict=True)) / 1e6 for k in ESTIMATES}
    follow_ups = F.count_if(F.coalesce(F.size("history"), F.lit(0)) > 0)
    answers = F.count("*") * F.lit(cost["answer"] + cost["embedding"]) + follow_ups * F.lit(cost["rewrite"] * rewrites)
    return questions.agg(answers.alias("answers")).withColumn("judge", F.lit(judge_calls * cost["judge"])).withColumn("total", F.col("answers") + F.col("judge"))


def check_estimate(estimate: DataFrame, most: float = MOST_COST) -> float:
    total = estimate.first().total
    if total > most:
        raise ValueError(f"the run is expected to cost {total:.4f}, over its limit of {most:.2f}")
    return most


# Gold sets and indexes ------------------------------------------------------------------------------------------


def validation_report(items: DataFrame, cross: DataFrame) -> DataFrame:
    """``what, value, n``: items (qid, type, language, tags, gold_sources, reviewed) by type, tag and language, and how many
    are answerable, reviewed and cross-lingual (cross: qid, cross_lingual)."""
    rows = items.join(cross, "qid", "left")
    entry = lambda what, value: F.struct(F.lit(what).alias("what"), value.alias("value"))
    flag = lambda name, test: F.when(test, entry(name, F.lit("yes")))
    single = F.array(
        entry("total", F.lit("all")), entry("type", F.col("type")), entry("language", F.col("language")), flag("answerable", F.coalesce(F.size("gold_sources"), F.lit(0)) > 0),
        flag("reviewed", F.coalesce("reviewed", F.lit(False))), flag("cross_lingual", F.coalesce("cross_lingual", F.lit(False)) & (F.coalesce(F.size("gold_sources"), F.lit(0)) > 0)),
    )
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: entry("tag", t))
    counted = rows.select(F.explode(F.concat(single, tags)).alias("e")).where(F.col("e").isNotNull())
    return counted.groupBy(F.col("e.what").alias("what"), F.col("e.value").alias("value")).agg(F.count("*").alias("n"))


def covered_sources(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """The gold sources (doc_id, page, quote) that some chunk (doc_id, page, page_end, text) covers."""
    held = chunks.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.coalesce("page_end", "page").alias("_last"), normalize_for_match("text").alias("_text"))
    asked = sources.withColumn("_quote", normalize_for_match("quote"))
    covers = (F.col("doc_id") == F.col("_doc")) & (F.col("page").isNull() | F.col("page").between(F.col("_page"), F.col("_last"))) & F.contains("_text", F.col("_quote"))
    return asked.join(held, covers, "left_semi").drop("_quote")


def choose_ids(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of the given ids; an id that no row has is an error."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(x,) for x in ids], f"{key} {rows.schema[key].dataType.simpleString()}")
    unknown = [r[0] for r in wanted.join(rows.select(key), key, "left_anti").collect()]  # of the given ids
    if unknown:
        raise KeyError(f"unknown: {', '.join(map(str, sorted(unknown)))}")
    return rows.where(F.col(key).isin(*ids))
