"""Ranking metrics, grouped summaries, judge scores, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import normalize_for_match


def source_ranks(ranked: DataFrame, texts: DataFrame, sources: DataFrame) -> DataFrame:
    """Rank of the first hit that covers each gold source: same document, page within range, quote within the text.

    ranked: qid, id, rk; texts: id, doc_id, page, page_end, text; sources: qid, source, doc_id, page, quote.
    """
    hits = ranked.join(texts, "id").select("qid", "rk", "doc_id", "page", F.coalesce("page_end", "page").alias("last"), normalize_for_match("text").alias("text"))
    gold = sources.select(F.col("qid").alias("g_qid"), "source", F.col("doc_id").alias("g_doc"), F.col("page").alias("g_page"), normalize_for_match("quote").alias("quote"))
    covers = (F.col("qid") == F.col("g_qid")) & (F.col("doc_id") == F.col("g_doc")) & (F.col("g_page").isNull() | F.col("g_page").between(F.col("page"), F.col("last"))) & F.contains("text", F.col("quote"))
    return gold.join(hits, covers, "left").groupBy(F.col("g_qid").alias("qid"), "source").agg(F.min("rk").alias("rk"))


def question_metrics(ranks: DataFrame, ks: tuple[int, ...] = (5, 50)) -> DataFrame:
    """hit, recall, mrr and ndcg at each k from ``qid, source, rk`` (rk null: not found)."""
    out = []
    for k in ks:
        near = F.when(F.col("rk") <= k, F.col("rk"))
        gain = F.coalesce(F.sum(1 / F.log2(near + 1)), F.lit(0.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.count("*").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
        out += [
            F.max(F.when(near.isNotNull(), 1.0).otherwise(0.0)).alias(f"hit_{k}"),
            F.avg(F.when(near.isNotNull(), 1.0).otherwise(0.0)).alias(f"recall_{k}"),
            F.coalesce(1 / F.min(near), F.lit(0.0)).alias(f"mrr_{k}"),
            F.least(F.lit(1.0), gain / ideal).alias(f"ndcg_{k}"),
        ]
    return ranks.groupBy("qid").agg(*out)


def by_dimensions(rows: DataFrame, dimensions: list[str], *aggregates: Column) -> DataFrame:
    """The same aggregates over all rows and by each dimension alone: ``dimension, value`` and the aggregates."""
    pairs = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return rows.withColumn("_d", F.explode(pairs)).groupBy(F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")).agg(*aggregates)


def rank_histogram(first: Column) -> Column:
    return F.when(first.isNull(), "none").when(first <= 1, "1").when(first <= 5, "2-5").when(first <= 10, "6-10").when(first <= 20, "11-20").when(first <= 50, "21-50").otherwise("none")


def latency_stats(c: str) -> list[Column]:
    return [F.round(F.percentile(c, 0.5), 1).alias("p50"), F.round(F.percentile(c, 0.95), 1).alias("p95"), F.round(F.avg(c), 1).alias("mean"), F.round(F.max(c), 1).alias("max")]


def judgment_scores(claims: Column) -> list[Column]:
    """faithfulness, citation precision and recall of an array of claims (cited, supported, supporting_cited)."""
    total = lambda f: F.aggregate(claims, F.lit(0), lambda s, c: s + f(c))
    n = F.nullif(F.size(claims), F.lit(0))
    return [
        F.try_divide(total(lambda c: c["supported"].cast("int")), n).alias("faithfulness"),
        F.try_divide(total(lambda c: F.size(F.array_intersect(c["cited"], c["supporting_cited"]))), F.nullif(total(lambda c: F.size(c["cited"])), F.lit(0))).alias("citation_precision"),
        F.try_divide(total(lambda c: (F.size(F.array_intersect(c["cited"], c["supporting_cited"])) > 0).cast("int")), n).alias("citation_recall"),
    ]


def every_kth(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """Of each group, rows 0, step, 2 * step, ... (k at most), step = max(1, n // k)."""
    window = Window.partitionBy(by)
    placed = rows.withColumn("_at", F.row_number().over(window.orderBy(order)) - 1).withColumn("_step", F.greatest(F.lit(1), F.floor(F.count("*").over(window) / k)))
    return placed.where((F.col("_at") % F.col("_step") == 0) & (F.col("_at") / F.col("_step") < k)).drop("_at", "_step")


def largest_remainder(groups: DataFrame, weight: str, seats: int, key: str) -> DataFrame:
    """Adds ``quota``: seats dealt in proportion to the weight, the rest to the largest remainders (ties: by key).

    ``groups`` has a row per group, few of them.
    """
    total = groups.agg(F.sum(weight)).scalar()
    exact = groups.withColumn("_exact", F.col(weight) * seats / total).withColumn("_floor", F.floor("_exact"))
    left = seats - exact.agg(F.sum("_floor")).scalar()
    placed = exact.withColumn("_at", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), key)))
    return placed.withColumn("quota", F.col("_floor") + (F.col("_at") <= left).cast("long")).drop("_exact", "_floor", "_at")


def context_precision(ranked: DataFrame, texts: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """``qid, precision``: the share of the first k hits that cover any gold source. Columns as in ``source_ranks``."""
    hits = ranked.where(F.col("rk") <= k)
    rows = hits.join(texts, "id").withColumn("_last", F.coalesce("page_end", "page")).withColumn("_text", normalize_for_match("text"))
    gold = sources.select(F.col("qid").alias("g_qid"), F.col("doc_id").alias("g_doc"), F.col("page").alias("g_page"), normalize_for_match("quote").alias("g_quote"))
    covers = (F.col("qid") == F.col("g_qid")) & (F.col("doc_id") == F.col("g_doc")) & (F.col("g_page").isNull() | F.col("g_page").between(F.col("page"), F.col("_last"))) & F.contains("_text", F.col("g_quote"))
    good = rows.join(gold, covers, "left_semi").groupBy("qid").agg(F.count("*").alias("_good"))
    return hits.groupBy("qid").agg(F.count("*").alias("_n")).join(good, "qid", "left").select("qid", (F.coalesce("_good", F.lit(0)) / F.col("_n")).alias("precision"))


def answer_quality(answerable: Column, abstained: Column, gold_in_context: Column) -> list[Column]:
    """Counts and refusal rates; null where no question is of the kind."""
    refused = answerable & abstained
    return [
        F.count("*").alias("n"),
        F.count_if(answerable).alias("answerable"),
        F.try_divide(F.count_if(~answerable & abstained), F.count_if(~answerable)).alias("correct_refusal"),
        F.try_divide(F.count_if(refused), F.count_if(answerable)).alias("false_refusal"),
        F.count_if(refused & gold_in_context).alias("false_refusal_with_gold"),
    ]
