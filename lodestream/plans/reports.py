"""Further named queries: answers, reports, ledgers, ingest and indexes, on rows made up from the given tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import answers, chunking, evaluation, index, ingest, ledger, retrieval, summaries
from lodestream.plans.catalog import _NORMAL, _PAIRS, _SPLIT, query, table

# Answers ------------------------------------------------------------------------------------------------------

_CONTEXT = "chunk_id doc_id title so_hieu heading_path article page page_end amended amended_by text".split()


def _context(n: int):
    """An array of ``n`` chunks made from a turn."""
    turn = F.col("turn")

    def chunk(i: int):
        values = [F.concat_ws("-", "conv_id", F.lit(str(i))), F.lit(f"doc{i}"), F.when(turn % 2 == 0, F.col("role")).otherwise(""), F.when(turn % 3 == 0, F.lit(f"{i}/20")), F.concat(F.lit(f"Part {i} > Article "), turn.cast("string"), F.lit(" > Clause 1")),
                  F.concat(F.lit("Article "), turn.cast("string")), turn.cast("int") + i, turn.cast("int") + i + (turn % 2).cast("int"), turn % 2 == 1, F.array(F.lit("x"), F.lit("<y>")), F.concat(F.lit("</document> "), "text")]
        return F.struct(*[v.alias(k) for k, v in zip(_CONTEXT, values, strict=True)])

    return F.array(*[chunk(i) for i in range(1, n + 1)])


@query("""WITH a AS (SELECT *, turn % 5 AS a, turn % 3 + 1 AS b FROM conversations), n AS (SELECT *, CASE WHEN a = b THEN [a] ELSE [a, b] END AS ns FROM a)
SELECT conv_id, turn, array_to_string(list_filter(ns, lambda x: x < 1 OR x > 3), ',') AS invalid, array_to_string(list_transform(list_filter(ns, lambda x: x BETWEEN 1 AND 3), lambda x:
  coalesce(CASE WHEN turn % 3 = 0 THEN x || '/20' END, nullif(CASE WHEN turn % 2 = 0 THEN role ELSE '' END, ''), 'doc' || x) || ', Article ' || turn || ' > Clause 1, page ' || (turn + x) || CASE WHEN turn % 2 = 1 THEN '–' || (turn + x + 1) ELSE '' END), '; ') AS labels FROM n""")
def checked_citations(spark, sf_dir):
    turn = F.col("turn")
    answer = F.concat(F.lit("So ["), (turn % 5).cast("string"), F.lit("], and ["), (turn % 3 + 1).cast("string"), F.lit("]."))
    rows = answers.check_citations(table(spark, sf_dir, "conversations").withColumns({"answer": answer, "context": _context(3)}))
    return rows.select("conv_id", "turn", F.array_join(F.col("invalid").cast("array<string>"), ",").alias("invalid"), F.array_join(F.transform("citations", lambda c: c["label"]), "; ").alias("labels"))


_DOC = """'<document index="1"' || CASE WHEN turn % 2 = 0 THEN ' title="' || role || '"' ELSE '' END || CASE WHEN turn % 3 = 0 THEN ' number="1/20"' ELSE '' END || ' section="Part 1 &gt; Article ' || turn || ' &gt; Clause 1" pages="' || (turn + 1) || CASE WHEN turn % 2 = 1 THEN '–' || (turn + 2) || '" amended_by="x, &lt;y&gt;' ELSE '' END || '">' || chr(10) || '‹/document> ' || text || chr(10) || '</document>'"""


@query(f"""SELECT conv_id, turn, sha256('<documents>' || chr(10) || {_DOC} || chr(10) || '</documents>' || chr(10) || chr(10) || '<question>' || role || '?</question>') AS message, 'said.' AS before, sha256('[1] ' || CASE WHEN turn % 2 = 0 THEN role ELSE '' END || ' | Part 1 > Article ' || turn || ' > Clause 1' || chr(10) || '</document> …') AS passages FROM conversations""")
def assembled_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("context", _context(1))
    history = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("said [1].").alias("content")))
    messages = answers.build_input(F.concat("role", F.lit("?")), F.col("context"), history)
    return rows.select("conv_id", "turn", messages.alias("m"), answers.format_passages(F.col("context"), 1).alias("p")).select("conv_id", "turn", F.sha2(F.get("m", F.lit(1))["content"], 256).alias("message"), F.get("m", F.lit(0))["content"].alias("before"), F.sha2("p", 256).alias("passages"))


@query("""WITH x AS (SELECT doc_id, lang AS s, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN lang ELSE source END AS t FROM documents)
SELECT doc_id AS qid, kind || '-' || i AS branch, text, weight FROM (SELECT doc_id, 0 AS i, s AS text, 1.0::DOUBLE AS weight FROM x UNION ALL SELECT doc_id, 1, t, 0.5 FROM x WHERE trim(t) <> '' AND t <> s), (VALUES ('dense'), ('sparse')) AS k(kind)""")
def plan_branches(spark, sf_dir):
    at = F.col("doc_id") % 4
    other = F.when(at == 1, " ").when(at == 2, F.col("lang")).when(at == 3, F.col("source"))
    plans = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), answers.plan_queries(F.col("lang"), other, 0.5).alias("queries"))
    return retrieval.branches(plans).select("qid", "branch", "text", "weight")


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE ELSE FALSE END AS abstained FROM conversations""")
def refusals(spark, sf_dir):
    at = F.col("turn") % 4
    said = F.when(at == 0, "**Not  found in the documents.** ").when(at == 1, "> KHÔNG TÌM THẤY trong tài liệu. ").when(at == 2, "It was not found in the documents: ").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.is_abstention(F.concat(said, "text")).alias("abstained"))


@query("""WITH r AS (SELECT conv_id, turn, turn % 7 AS a, conv_id % 9 AS b, turn % 4 AS c, turn % 4 + conv_id % 15 AS d FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN a = b THEN [a] ELSE [a, b] END || CASE WHEN d - c <= 10 THEN range(c, d + 1) WHEN c = d THEN [c] ELSE [c, d] END AS ns FROM r)
SELECT conv_id, turn, array_to_string(list_filter(ns, lambda x, i: list_position(ns, x) = i), ',') AS cited, CAST(conv_id % 2 + 1 AS INT) AS malformed, 'a' || CASE WHEN conv_id % 2 = 1 THEN ' x' ELSE '' END AS stripped FROM l""")
def parse_citations(spark, sf_dir):
    a, b, c, d = (x.cast("string") for x in (F.col("turn") % 7, F.col("conv_id") % 9, F.col("turn") % 4, F.col("turn") % 4 + F.col("conv_id") % 15))
    odd = F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit(" x ["), a, F.lit("; see there]"))).otherwise("")
    text = F.concat(F.lit("a ["), a, F.lit(", "), b, F.lit("] ["), c, F.lit("–"), d, F.lit("] ["), a, F.lit(", clause 2]"), odd)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.parse_citations(text).cast("array<string>"), ",").alias("cited"), F.size(X.malformed_citations(text)).alias("malformed"), X.strip_citations(text).alias("stripped"))


# Retrieval ----------------------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT doc_id, source, len(u) AS dl, {_PAIRS} FROM (SELECT *, {_SPLIT} FROM documents)), p AS (SELECT source, doc_id, dl, term, count(*) AS tf FROM (SELECT source, doc_id, dl, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS qid, source, unnest(t) AS term FROM (SELECT item_id, source, {_PAIRS} FROM (SELECT item_id, 'src' || (item_id % 20) AS source, {_SPLIT} FROM benchmark))),
s AS (SELECT source, term, count(*) AS df FROM p GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
b AS (SELECT qid, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 215.0))), 6) AS score FROM p JOIN q USING (source, term) JOIN s USING (source, term) JOIN n USING (source) GROUP BY ALL)
SELECT qid, id, round(score, 4) AS score, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM b) WHERE rk <= 5""")
def tenant_bm25(spark, sf_dir):
    """Each question belongs to a source, and meets that source's texts and statistics only."""
    questions = table(spark, sf_dir, "benchmark").withColumn("source", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    scores = retrieval.bm25_scores(table(spark, sf_dir, "documents"), questions, tenant="source").withColumn("score", F.round("score", 6))
    return retrieval.top_k(scores, 5).select("qid", "id", F.round("score", 4).alias("score"), "rk")


@query("""WITH v AS (SELECT *, 't' || (vec_id // 20 % 3) AS tenant FROM embeddings), r AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM v e JOIN v q USING (tenant) WHERE q.vec_id % 20 = 0)
SELECT qid, id, score, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM r) WHERE rk <= 5""")
def tenant_dense(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("tenant", F.concat(F.lit("t"), F.expr("vec_id div 20 % 3").cast("string")))
    return retrieval.top_k(retrieval.dense_scores(vectors, vectors.where("vec_id % 20 = 0"), 5, tenant="tenant"), 5).select("qid", "id", "score", "rk")


@query("""WITH h AS (SELECT conv_id AS qid, turn AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS rk, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN rk = 3 THEN 0 WHEN rk = 2 THEN 1 END AS pos FROM h) SELECT qid, id, rk, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos NULLS LAST, rk) AS INT) AS new_rk FROM p""")
def rerank_candidates(spark, sf_dir):
    """Of three candidates the third and second are chosen; a fourth and a repeated choice don't count."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("id"), (-F.col("turn")).alias("score"))
    hits = retrieval.top_k(rows, 1_000_000).select("qid", "id", "rk")
    picks = hits.select("qid").distinct().select("qid", F.posexplode(F.array(*map(F.lit, (3, 4, 2, 3)))).alias("pos", "pick"))
    return retrieval.rerank(hits, picks, candidates=3).select("qid", "id", "rk", "new_rk")


@query(f"""SELECT item_id FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE d.source = 'src' || (b.item_id % 20) AND contains({_NORMAL.format("d.text")}, {_NORMAL.format("b.text")}))""")
def sources_in_index(spark, sf_dir):
    page = F.lit(None).cast("int")
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), page.alias("page"), page.alias("page_end"), "text")
    sources = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("doc_id"), page.alias("page"), F.col("text").alias("quote"))
    return summaries.covered_sources(sources, chunks).select("item_id")


# Reports ------------------------------------------------------------------------------------------------------

_MODES = "CASE event_id % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'sparse' ELSE 'hybrid' END"


def _runs(spark, sf_dir):
    """Events as records of a retrieval run."""
    at = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(at % 3 == 0, "dense").when(at % 3 == 1, "sparse").otherwise("hybrid").alias("mode"), F.when(at % 10 > 0, (at % 4 == 0).cast("double")).alias("hit"), F.when(at % 10 > 0, (at % 7) / F.lit(7.0)).alias("mrr"),
        F.col("value").alias("total"), (at % 11).cast("double").alias("embed"), ((at % 5) / F.lit(1000.0)).alias("cost_usd"), F.when(at % 10 == 0, "x").alias("query_error"), F.when(at % 13 == 0, "y").alias("rerank_error"), F.when(at % 6 == 0, "concat_fallback").alias("rewrite_method"),
    )


@query(f"""WITH e AS (SELECT {_MODES} AS mode, event_type, (event_id % 4 = 0)::INT AS hit, (event_id % 7) / 7.0 AS mrr FROM events WHERE event_id % 10 > 0)
SELECT mode, 'all' AS dimension, 'all' AS value, count(*) AS n, round(avg(hit), 4) AS hit, round(avg(mrr), 4) AS mrr FROM e GROUP BY mode UNION ALL SELECT mode, 'event_type', event_type, count(*), round(avg(hit), 4), round(avg(mrr), 4) FROM e GROUP BY mode, event_type""")
def retrieval_means(spark, sf_dir):
    return summaries.retrieval_summary(_runs(spark, sf_dir), ["hit", "mrr"], ["event_type"], ["total", "embed"])[0]


@query(f"""WITH e AS (SELECT {_MODES} AS mode, value, (event_id % 11)::DOUBLE AS embed FROM events), l AS (SELECT mode, 'total' AS step, value AS ms FROM e UNION ALL SELECT mode, 'embed', embed FROM e)
SELECT mode, step, round(quantile_cont(ms, 0.5), 1) AS p50, round(quantile_cont(ms, 0.95), 1) AS p95, round(avg(ms), 1) AS mean, round(max(ms), 1) AS max FROM l GROUP BY ALL""")
def retrieval_times(spark, sf_dir):
    return summaries.retrieval_summary(_runs(spark, sf_dir), ["hit", "mrr"], ["event_type"], ["total", "embed"])[1]


@query(f"""SELECT {_MODES} AS mode, round(avg((event_id % 5) / 1000.0), 7) AS cost_mean, round(sum((event_id % 5) / 1000.0), 5) AS cost_total, count(*) FILTER (event_id % 10 = 0) AS query_errors, count(*) FILTER (event_id % 13 = 0) AS rerank_errors, count(*) FILTER (event_id % 6 = 0) AS rewrite_fallbacks FROM events GROUP BY 1""")
def retrieval_costs(spark, sf_dir):
    return summaries.retrieval_summary(_runs(spark, sf_dir), ["hit", "mrr"], ["event_type"], ["total", "embed"])[2]


def _answers(spark, sf_dir):
    at = F.col("doc_id")
    some = lambda k: F.when(at % k == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    good = F.col("quality") == 1
    rows = rows.withColumns({"answerable": good, "abstained": at % 5 == 0, "hit": F.when(good, (at % 2).cast("double")), "recall": F.when(good, (at % 3) / F.lit(2.0)), "context_precision": F.when(good, (at % 4) / F.lit(3.0)), "invalid": some(6), "malformed": some(9), "warnings": some(7), "status": F.when(at % 12 == 0, "failed").otherwise("ok"), "judged": at % 3 == 0})
    return rows.withColumns({m: F.when((at % 3 == 0) & (at % 4 != i), (at % (i + 2)) / F.lit(float(i + 2))) for i, m in enumerate(summaries.METRICS)})


_JUDGED = ", ".join(f"round(avg(CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> {i} THEN (doc_id % {i + 2}) / {i + 2}.0 END), 4) AS {m}, count(CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> {i} THEN 1 END) AS {m}_n" for i, m in enumerate(summaries.METRICS))


@query(f"""WITH x AS (SELECT doc_id, lang, quality = 1 AS a, doc_id % 5 = 0 AS r FROM documents JOIN labels USING (doc_id)), y AS (SELECT 'all' AS dimension, 'all' AS value, * FROM x UNION ALL SELECT 'lang', lang, * FROM x)
SELECT dimension, value, count(*) AS n, count(*) FILTER (a) AS answerable, count(*) FILTER (NOT a) AS unanswerable, round(count(*) FILTER (r AND NOT a) / nullif(count(*) FILTER (NOT a), 0), 4) AS correct_refusal, round(count(*) FILTER (r AND a) / nullif(count(*) FILTER (a), 0), 4) AS false_refusal,
  round(count(*) FILTER (r AND a AND doc_id % 2 = 1) / nullif(count(*) FILTER (a), 0), 4) AS false_refusal_gold_in_context, round(avg(CASE WHEN a THEN doc_id % 2 END), 4) AS hit, round(avg(CASE WHEN a THEN (doc_id % 3) / 2.0 END), 4) AS recall, round(avg(CASE WHEN a THEN (doc_id % 4) / 3.0 END), 4) AS context_precision,
  round(count(*) FILTER (doc_id % 6 = 0) / count(*), 4) AS invalid_citation_rate, round(count(*) FILTER (doc_id % 9 = 0) / count(*), 4) AS malformed_citation_rate, 2 * count(*) FILTER (doc_id % 9 = 0) AS malformed_citations, count(*) FILTER (doc_id % 7 = 0) AS answers_with_amendment_warning,
  count(*) FILTER (doc_id % 12 = 0) AS failed_answers, count(*) FILTER (doc_id % 3 = 0) AS judged, {_JUDGED} FROM y GROUP BY ALL""")
def answer_quality_report(spark, sf_dir):
    return evaluation.by_dimensions(_answers(spark, sf_dir), ["lang"], *summaries.quality_measures())


def _answer_summary(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumns({"follow_up": F.col("doc_id") % 2 == 1, "ttft": F.col("n_chars").cast("double"), "pipeline_usd": (F.col("doc_id") % 10) / F.lit(100.0), "judge_usd": (F.col("doc_id") % 3) / F.lit(10.0), "input_tokens": F.col("n_chars")})
    return summaries.answer_summary(rows, ["lang"], ["ttft"], ["input_tokens"])


@query("""SELECT CASE WHEN doc_id % 2 = 1 THEN 'follow_up' ELSE 'first_turn' END AS turn, count(*) AS n, round(quantile_cont(n_chars, 0.5), 1) AS p50, round(quantile_cont(n_chars, 0.95), 1) AS p95, round(avg(n_chars), 1) AS mean, round(max(n_chars), 1)::DOUBLE AS max FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def first_token_times(spark, sf_dir):
    return _answer_summary(spark, sf_dir)["ttft"]


@query("""SELECT round(avg((doc_id % 10) / 100.0), 6) AS pipeline_usd_per_question, round(sum((doc_id % 10) / 100.0), 4) AS pipeline_usd_total, round(avg((doc_id % 3) / 10.0), 6) AS judge_usd_per_question, round(sum((doc_id % 3) / 10.0), 4) AS judge_usd_total FROM documents JOIN labels USING (doc_id)""")
def answer_costs(spark, sf_dir):
    return _answer_summary(spark, sf_dir)["cost"]


@query("""WITH u AS (SELECT event_type, CAST(floor(abs(value)) AS BIGINT) AS t, event_id FROM events)
SELECT event_type, count(*)::BIGINT AS calls, sum(t)::BIGINT AS input_tokens, sum(t % 3)::BIGINT AS cached_input_tokens, sum(CASE WHEN event_id % 2 = 0 THEN t % 2 ELSE 0 END)::BIGINT AS cache_write_tokens, sum(t % 5)::BIGINT AS output_tokens, sum(t % 4)::BIGINT AS reasoning_tokens, round(sum(t / 1000.0), 3) AS cost_usd FROM u GROUP BY 1""")
def usage_by_type(spark, sf_dir):
    """Usage objects of two kinds of API, read and added up."""
    t = F.floor(F.abs("value")).cast("long")
    n = lambda k: (t % k).alias("x")
    one = F.to_json(F.struct(t.alias("input_tokens"), (t % 5).alias("output_tokens"), F.struct(n(3).alias("cached_tokens"), n(2).alias("cache_write_tokens")).alias("input_tokens_details"), F.struct(n(4).alias("reasoning_tokens")).alias("output_tokens_details")))
    other = F.to_json(F.struct(t.alias("prompt_tokens"), (t % 5).alias("completion_tokens"), F.struct(n(3).alias("cached_tokens")).alias("prompt_tokens_details"), F.struct(n(4).alias("reasoning_tokens")).alias("completion_tokens_details")))
    rows = table(spark, sf_dir, "events").select("event_type", ledger.usage_of(F.when(F.col("event_id") % 2 == 0, one).otherwise(other)).alias("u"), (t / F.lit(1000.0)).alias("cost_usd"))
    return summaries.usage_totals(rows.select("event_type", "u.*", "cost_usd"), ["event_type"]).withColumn("cost_usd", F.round("cost_usd", 3))


@query("""WITH p AS (SELECT doc_id, quality, toxic, doc_id % 2 AS h, doc_id % 3 AS k FROM labels WHERE doc_id % 5 > 0 AND doc_id % 7 > 0)
SELECT 'faithful' AS metric, count(*) AS n, round(avg(CASE WHEN (quality = 1) = (h = 1) THEN 1 ELSE 0 END), 4) AS agreement FROM p WHERE quality IS NOT NULL UNION ALL
SELECT 'citations_ok', count(*), round(avg(CASE WHEN (toxic = 1) = (k = 0) THEN 1 ELSE 0 END), 4) FROM p WHERE toxic IS NOT NULL AND k <> 1 UNION ALL
SELECT 'correctness', count(*), round(avg(CASE WHEN h = k THEN 1 ELSE 0 END), 4) FROM p UNION ALL SELECT 'correctness_binary', count(*), round(avg(CASE WHEN (h = 1) = (k = 1) THEN 1 ELSE 0 END), 4) FROM p""")
def judge_agreement(spark, sf_dir):
    at = F.col("doc_id")
    word = lambda c: F.when(c == 0, "wrong").when(c == 1, "correct").otherwise("partly")
    rows = table(spark, sf_dir, "labels")
    human = rows.where("doc_id % 5 > 0").select(at.alias("id"), (F.col("quality") == 1).alias("faithful"), (F.col("toxic") == 1).alias("citations_ok"), word(at % 2).alias("correctness"), F.lit(None).cast("string").alias("relevancy"))
    judged = rows.where("doc_id % 7 > 0").select(at.alias("id"), (at % 2).cast("double").alias("faithfulness"), F.when(at % 3 == 1, None).when(at % 3 == 0, 1.0).otherwise(0.5).alias("citation_precision"), word(at % 3).alias("correctness"), F.lit("relevant").alias("relevancy"))
    return summaries.agreement(human, judged)


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)""")
def unscored_samples(spark, sf_dir):
    return summaries.resume(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id").select("doc_id")


@query("""WITH i AS (SELECT doc_id, 't' || (doc_id % 4) AS type, lang, source, doc_id % 3 > 0 AS a, doc_id % 5 = 0 AS r, doc_id % 2 = 0 AS c FROM documents)
SELECT 'total' AS what, 'all' AS value, count(*) AS n FROM i UNION ALL SELECT 'type', type, count(*) FROM i GROUP BY 2 UNION ALL SELECT 'language', lang, count(*) FROM i GROUP BY 2 UNION ALL SELECT 'tag', source, count(*) FROM i GROUP BY 2
UNION ALL SELECT 'answerable', 'yes', count(*) FROM i WHERE a UNION ALL SELECT 'reviewed', 'yes', count(*) FROM i WHERE r UNION ALL SELECT 'cross_lingual', 'yes', count(*) FROM i WHERE a AND c""")
def gold_set_report(spark, sf_dir):
    at = F.col("doc_id")
    items = table(spark, sf_dir, "documents").select(at.alias("qid"), F.concat(F.lit("t"), (at % 4).cast("string")).alias("type"), F.col("lang").alias("language"), F.array("source").alias("tags"), F.when(at % 3 > 0, F.array(F.lit("s"))).alias("gold_sources"), (at % 5 == 0).alias("reviewed"))
    return summaries.validation_report(items, items.select("qid", (F.col("qid") % 2 == 0).alias("cross_lingual")))


@query("""SELECT round((n * (3000 * 2.0 + 500 * 8.0 + 60 * 0.1) + f * (400 * 0.4 + 100 * 1.6)) / 1e6, 9) AS answers, round(7 * (5000 * 1.0 + 3000 * 4.0) / 1e6, 9) AS judge FROM (SELECT count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS f FROM documents)""")
def run_estimate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, F.array("lang")).alias("history"))
    found = summaries.estimate_cost(rows, {"answer": (2.0, 8.0), "rewrite": (0.4, 1.6), "embedding": (0.1, 0.0), "judge": (1.0, 4.0)}, 7)
    return found.select(F.round("answers", 9).alias("answers"), F.round("judge", 9).alias("judge"))


@query("""WITH g AS (SELECT toxic, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality <> 1) AS bad FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1), x AS (SELECT *, n * 30 / sum(n) OVER ()::DOUBLE AS e FROM g),
f AS (SELECT *, floor(e) AS fl, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, toxic) AS place FROM x), q AS (SELECT *, CAST(fl + CASE WHEN place <= 30 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)
SELECT toxic, quota AS n, CASE WHEN good < quota // 2 THEN good WHEN bad < quota - quota // 2 THEN least(good, quota - bad) ELSE quota // 2 END AS good FROM q""")
def calibration_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").withColumn("good", F.col("quality") == 1)
    return summaries.interleaved_sample(rows, "toxic", "good", 30, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("good").alias("good"))


@query("""SELECT item_id, v AS variant, CAST(((i - (row_number() OVER (PARTITION BY v ORDER BY item_id) - 1)) % 3 + 3) % 3 AS INT) AS turn FROM benchmark, (VALUES ('a', 0), ('b', 1), ('c', 2)) AS x(v, i)""")
def rotated_variants(spark, sf_dir):
    return answers.rotating_order(table(spark, sf_dir, "benchmark").select("item_id"), ["a", "b", "c"], ["item_id"]).select("item_id", "variant", F.col("turn").cast("int").alias("turn"))


# Ledger -------------------------------------------------------------------------------------------------------


def _calls(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select(F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"), F.lit("p").alias("provider"), F.col("event_type").alias("model"), F.col("value").alias("cost_usd"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 10).alias("output_tokens"))


@query("""SELECT round(sum(CASE WHEN CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) THEN value ELSE 0 END), 2) AS today, round(sum(value), 2) AS total FROM events""")
def ledger_spent(spark, sf_dir):
    rows = _calls(spark, sf_dir)
    last = rows.agg(F.max("day").cast("string")).first()[0]  # the caller's clock
    return ledger.spent(rows, last).select(F.round("today", 2).alias("today"), F.round("total", 2).alias("total"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), u AS (SELECT event_type AS model, count(*) AS calls, sum(event_id % 100 + event_id % 10)::BIGINT AS tokens FROM events, m WHERE ts >= date_trunc('day', now) GROUP BY 1)
SELECT model, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, CASE WHEN model <> 'view' THEN 1000 - coalesce(calls, 0) END AS calls_left, CASE WHEN model <> 'click' THEN 5000 - coalesce(tokens, 0) END AS tokens_left FROM (SELECT DISTINCT event_type AS model FROM events) LEFT JOIN u USING (model)""")
def quota_left(spark, sf_dir):
    rows = _calls(spark, sf_dir)
    profiles = rows.select("provider", "model").distinct().withColumns({"zone": F.lit("UTC"), "calls_per_day": F.when(F.col("model") != "view", 1000), "tokens_per_day": F.when(F.col("model") != "click", 5000)})
    now = F.lit(rows.agg(F.max("ts")).first()[0])
    return ledger.quota(rows, profiles, now).select("model", "calls", "tokens", "calls_left", "tokens_left")


_FOLD = """WITH RECURSIVE e AS (SELECT event_id, {key} AS k, value, row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS rn FROM events),
r AS (SELECT event_id, k, rn, value <= {limit} AS admitted, CASE WHEN value <= {limit} THEN value ELSE 0 END AS spent FROM e WHERE rn = 1
  UNION ALL SELECT e.event_id, e.k, e.rn, r.spent + e.value <= {limit}, CASE WHEN r.spent + e.value <= {limit} THEN r.spent + e.value ELSE r.spent END FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1)
SELECT event_id, admitted FROM r"""


@query(_FOLD.format(key="event_type", limit="1000.0"))
def budget_admission(spark, sf_dir):
    return ledger.admit(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "event_id", "value", 1000.0).select("event_id", "admitted")


@query(_FOLD.format(key="1", limit="3000.0"))
def reserved_in_all(spark, sf_dir):
    """The total limit alone, as no type's own limit is reached."""
    return ledger.admit(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "event_id", "value", 1e12, 3000.0).select("event_id", "admitted")


# Ingest and indexes -------------------------------------------------------------------------------------------

_HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '\s+', ' ', 'g'), '(?s)<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '<h1>', chr(10) || '# ', 'g')"""
_UNESCAPED = "{}"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("#39", "''"), ("amp", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '&{_name};', '{_char}')"


_PAGE_LINES = rf"""s AS (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace({_HTML}, '</h1>|</?p>|<br ?/?>|</?div[^>]*>|</?article>|</?body>|</?html[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10))) AS l, generate_subscripts(string_split(regexp_replace(regexp_replace({_HTML}, '</h1>|</?p>|<br ?/?>|</?div[^>]*>|</?article>|</?body>|</?html[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)), 1) AS i FROM pages),
t AS (SELECT page_id, i, trim(regexp_replace({_UNESCAPED.format("l")}, '\s+', ' ', 'g')) AS l FROM s)"""


@query(f"""WITH {_PAGE_LINES} SELECT page_id, CAST(count(*) AS INT) AS lines, sha256(string_agg(l, chr(10) ORDER BY i)) AS hash FROM t WHERE l <> '' GROUP BY 1""")
def html_to_lines(spark, sf_dir):
    return _page_lines(spark, sf_dir).select("page_id", F.size("lines").alias("lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("hash"))


def _page_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(chunking.html_lines, "page_id long, lines array<string>")


@query(f"""WITH {_PAGE_LINES}, u AS (SELECT page_id, i, l, sum(CASE WHEN starts_with(l, '# ') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS sec FROM t WHERE l <> ''),
c AS (SELECT page_id, sec, max(CASE WHEN starts_with(l, '# ') THEN substr(l, 3) END) AS head, string_agg(CASE WHEN NOT starts_with(l, '# ') THEN l END, chr(10) ORDER BY i) AS body FROM u GROUP BY 1, 2), x AS (SELECT page_id, sec, coalesce(head, '') AS heading_path, CASE WHEN head IS NULL THEN body ELSE head || chr(10) || body END AS text FROM c WHERE body IS NOT NULL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY sec) - 1 AS INT) AS chunk_index, page_id || ':' || lpad(CAST(row_number() OVER (PARTITION BY page_id ORDER BY sec) - 1 AS VARCHAR), 4, '0') AS chunk_id, heading_path, sha256(text) AS hash, CAST(len(regexp_extract_all(text, '[^ \\n]+')) AS INT) AS token_count FROM x""")
def page_chunks(spark, sf_dir):
    """Sections of web pages under their headings, each a chunk."""
    paragraphs = _page_lines(spark, sf_dir).select("page_id", F.posexplode("lines").alias("par", "text"))
    chunks = chunking.chunk_generic(paragraphs, "page_id", max_tokens=1_000_000_000, overlap=0.0)
    return chunks.select("page_id", "chunk_index", "chunk_id", "heading_path", F.sha2("text", 256).alias("hash"), "token_count")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), m AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '## ' WHEN 1 THEN '| ' WHEN 2 THEN '- ' WHEN 3 THEN '(12) ' WHEN 4 THEN '“đ. ' WHEN 5 THEN '12' ELSE '' END || l AS l FROM l)
SELECT doc_id, count(*) AS n FROM m WHERE doc_id % 7 < 5 OR regexp_matches(l, '^(#{1,6}\s|\||[-•*+]\s|[“"]?\(?([0-9]+|[a-zđ])[.)]\s)') GROUP BY doc_id""")
def block_starts(spark, sf_dir):
    at = F.col("doc_id") % 7
    mark = F.when(at == 0, "## ").when(at == 1, "| ").when(at == 2, "- ").when(at == 3, "(12) ").when(at == 4, "“đ. ").when(at == 5, "12").otherwise("")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).withColumn("l", F.concat(mark, "l"))
    return rows.where(X.starts_block("l")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, sha256(lang || ' (' || source || ') | a > b' || chr(10) || substr(text, 1, 50)) AS embedded, sha256('u:' || source || ':' || sha256(text)) AS point, array_to_string(string_split(text, chr(10))[1:500], chr(10)) = text AS whole, 'office fix – x’y' AS mended FROM documents""")
def text_forms(spark, sf_dir):
    broken = X.fix_replacement_chars(X.expand_ligatures(F.lit("oﬃce ﬁx � x�y�")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(X.embedding_text(F.col("lang"), F.col("source"), F.lit("a > b"), F.substring("text", 1, 50)), 256).alias("embedded"), X.point_id(F.lit("u"), "source", X.content_hash("text")).alias("point"),
        (X.language_sample(F.split("text", "\n")) == F.col("text")).alias("whole"), broken.alias("mended"),
    )


@query(r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[0-9]+(?:[.,][0-9]+)+|[\p{L}\p{N}_]+')) AS word FROM documents) SELECT lang, word, count(*) AS n FROM w GROUP BY ALL""")
def vocabulary(spark, sf_dir):
    rows = X.tokenised(table(spark, sf_dir, "documents"), "text", "lang").select("lang", F.explode_outer("words").alias("word")).where(F.col("word").isNotNull())
    return rows.groupBy("lang", "word").agg(F.count("*").alias("n"))


@query("""SELECT source AS doc_id, 'generic' AS structure, count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN lang END) AS articles, count(*) AS chunks, round(avg(n_chars), 4) AS mean_tokens, max(n_chars) AS max_tokens, count(*) AS pages, count(*) FILTER (doc_id % 4 = 0) AS ocr_pages FROM documents GROUP BY 1""")
def ingest_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    chunks = rows.select(F.col("source").alias("doc_id"), F.lit("generic").alias("structure"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("article"), F.col("n_chars").alias("token_count"))
    return ingest.ingest_summary(chunks, rows.select(F.col("source").alias("doc_id"), (F.col("doc_id") % 4 == 0).alias("needs_ocr")))


@query("""WITH c AS (SELECT source || '-' || lang AS doc_id, doc_id AS place, text FROM documents) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INT) AS chunk_index, doc_id || ':' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS VARCHAR), 4, '0') AS chunk_id, sha256(text) AS content_hash FROM c""")
def chunk_identity(spark, sf_dir):
    from pyspark.sql import Window

    from lodestream.operators import legal

    rows = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "lang").alias("doc_id"), F.col("doc_id").alias("at"), "text")
    rows = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1)
    return legal.with_identity(rows).select("doc_id", "chunk_index", "chunk_id", "content_hash")


@query("""SELECT doc_id, lang FROM documents WHERE source = 'src4' AND doc_id % 3 = 0""")
def user_documents(spark, sf_dir):
    """One user's rows, the fields that were asked for, of ids that must be there."""
    rows = table(spark, sf_dir, "documents").where("source = 'src4'")
    ids = [r[0] for r in rows.where("doc_id % 3 = 0").select("doc_id").collect()]  # the ids that a caller names
    return summaries.choose_ids(rows, "doc_id", ids).select("doc_id", "lang")


@query("""WITH d AS (SELECT source AS doc, text, sha256(text) AS h FROM documents WHERE doc_id % 50 = 7) SELECT count(DISTINCT (doc, h)) AS points, count(DISTINCT h) AS texts FROM d""")
def embedded_points(spark, sf_dir):
    """Distinct points of documents and texts, each text embedded once."""
    rows = table(spark, sf_dir, "documents").where("doc_id % 50 = 7").select(F.col("source").alias("doc"), "text", X.content_hash("text").alias("hash"))
    points = rows.select(X.point_id(F.lit("u"), "doc", "hash").alias("point"), "hash").distinct()
    texts = index.cache_misses(rows.select("hash", "text"), rows.select("hash").limit(0), ["hash"])
    made = index.embed(texts, index.hashing_embedder(16))
    return points.agg(F.count("*").alias("points")).crossJoin(made.where(F.size("vector") == 16).agg(F.count("*").alias("texts")))  # a row each
