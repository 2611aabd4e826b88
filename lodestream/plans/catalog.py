"""Named queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import chunking, cleanup, evaluation, gold, index, ledger, legal, providers, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Sparse retrieval ---------------------------------------------------------------------------------------------

_UNI = r"'[0-9]+(?:[.,][0-9]+)+|[\p{L}\p{N}_]+'"
_ALL = r"'[0-9]+(?:[.,][0-9]+)+|[\p{L}\p{N}_]+|[.,;:!?()\[\]{}“”\"…\n]'"


_PAIRS = r"""list_concat(u, list_transform(list_filter(list_zip(e[: len(e) - 1], e[2:]), lambda x: regexp_matches(x[1], '^[\p{L}\p{N}_]') AND regexp_matches(x[2], '^[\p{L}\p{N}_]')), lambda x: x[1] || ' ' || x[2])) AS t"""
_SPLIT = f"regexp_extract_all(lower(nfc_normalize(text)), {_UNI}) AS u, regexp_extract_all(lower(nfc_normalize(text)), {_ALL}) AS e"
_POSTED = f"""
d AS (SELECT doc_id, lang, source, len(u) AS dl, {_PAIRS} FROM (SELECT *, {_SPLIT} FROM documents)),
p AS (SELECT doc_id, lang, source, dl, term, count(*) AS tf FROM (SELECT doc_id, lang, source, dl, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS qid, unnest(t) AS term FROM (SELECT item_id, {_PAIRS} FROM (SELECT item_id, {_SPLIT} FROM benchmark))),
s AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (
  SELECT qid, doc_id AS id, sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 215.0))) AS score
  FROM p JOIN q USING (term) JOIN s USING (term) GROUP BY ALL)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = retrieval.bm25_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scores.withColumn("score", F.round("score", 6))


@query(f"""WITH {_POSTED}, r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rk FROM bm)
SELECT qid, id, round(score, 4) AS score, CAST(rk AS INT) AS rk FROM r WHERE rk <= 10""")
def bm25_topk(spark, sf_dir):
    return retrieval.top_k(_bm25(spark, sf_dir), 10).select("qid", "id", F.round("score", 4).alias("score"), "rk")


@query(f"""WITH {_POSTED} SELECT doc_id AS id, count(*) AS n_terms, sum(tf)::BIGINT AS tokens, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 215.0))), 4) AS weight FROM p GROUP BY doc_id""")
def bm25_tf_weights(spark, sf_dir):
    p = retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.groupBy("id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("tokens"), F.round(F.sum(retrieval.tf_weight(F.col("tf"), F.col("dl"))), 4).alias("weight"))


@query(f"""WITH {_POSTED}, n AS (SELECT source, count(*) AS n, round(avg(dl), 4) AS avgdl FROM d GROUP BY source)
SELECT source, term, df, n, avgdl, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf
FROM (SELECT source, term, count(*) AS df FROM p GROUP BY ALL) JOIN n USING (source)""")
def tenant_scoped_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    p = retrieval.postings(docs, "doc_id", "text", "source")
    n = docs.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.size(X.unigrams("text"))), 4).alias("avgdl"))
    df = p.groupBy("source", "term").agg(F.count("*").alias("df"))
    return df.join(n, "source").select("source", "term", "df", "n", "avgdl", F.round(retrieval.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"""WITH {_POSTED} SELECT doc_id, term, tf AS n FROM p WHERE contains(term, ' ')""")
def bigram_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.bigrams("text")).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


# Dense retrieval and fusion -----------------------------------------------------------------------------------


def _dense(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The best ``k`` rows, at least, of every query: the vectors whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.dense_scores(vectors, vectors.where("vec_id % 20 = 0"), k)


_DENSE = """dn AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)"""


@query(f"""WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM dn)
SELECT qid, id, score, CAST(rk AS INT) AS rk FROM r WHERE rk <= 10""")
def dense_topk_cosine(spark, sf_dir):
    return retrieval.top_k(_dense(spark, sf_dir), 10).select("qid", "id", "score", "rk")


def _rrf(wd: float, ws: float) -> str:
    return f"""WITH {_POSTED}, {_DENSE},
b1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM dn),
b2 AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rk FROM bm),
f AS (SELECT qid, id, round(sum(part), 12) AS score FROM (SELECT qid, id, 1 / (2 + rk / {wd} - 1) AS part FROM b1 WHERE rk <= 50 UNION ALL SELECT qid, id, 1 / (2 + rk / {ws} - 1) FROM b2 WHERE rk <= 50) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM f)
SELECT qid, id, round(score, 9) AS score, CAST(rk AS INT) AS rk FROM r WHERE rk <= 10"""


def _hybrid(spark, sf_dir, wd: float, ws: float) -> DataFrame:
    return retrieval.fuse([(_dense(spark, sf_dir, 50), wd), (_bm25(spark, sf_dir), ws)]).select("qid", "id", F.round("score", 9).alias("score"), "rk")


@query(_rrf(2.0, 1.0))
def rrf_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir, 2.0, 1.0)


@query(_rrf(1.0, 1.0))
def rrf_equal_weights(spark, sf_dir):
    return _hybrid(spark, sf_dir, 3.0, 3.0)


@query(SQL["dense_topk_cosine"])
def rrf_zero_weight_branch(spark, sf_dir):
    return _hybrid(spark, sf_dir, 2.0, 0.0)


@query(f"""WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM dn)
SELECT qid, id, CAST(rk AS INT) AS rk, CAST(CASE rk WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE CASE WHEN rk < 7 THEN rk + 1 ELSE rk END END AS INT) AS new_rk FROM r WHERE rk <= 10""")
def rerank_apply(spark, sf_dir):
    hits = retrieval.top_k(_dense(spark, sf_dir), 10).select("qid", "id", "rk")
    picks = F.explode(F.array(*[F.struct(F.lit(p).alias("pick"), F.lit(i).alias("pos")) for i, p in enumerate((7, 3, 7, 99))]))
    chosen = hits.select("qid").distinct().select("qid", picks.alias("c")).select("qid", "c.pick", "c.pos")
    return retrieval.apply_ranking(hits, chosen).select("qid", "id", "rk", "new_rk")


# Evaluation ---------------------------------------------------------------------------------------------------

_GOLD = f"""g AS (SELECT item_id AS qid, 0 AS source, replace(substr(text, 1, 40), chr(10), ' ') AS quote FROM benchmark),
rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rk FROM bm),
fs AS (SELECT g.qid, min(CASE WHEN contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(g.quote, '\\s+', ' ', 'g'))) THEN rk END) AS rk
  FROM g LEFT JOIN (SELECT * FROM rk WHERE rk <= 50) r USING (qid) LEFT JOIN documents d ON d.doc_id = r.id GROUP BY g.qid)"""


def _ranks(spark, sf_dir) -> DataFrame:
    docs, gold = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = retrieval.top_k(_bm25(spark, sf_dir), 50).select("qid", "id", "rk")
    page = F.lit(None).cast("int")
    texts = docs.select(F.col("doc_id").alias("id"), F.lit("corpus").alias("doc_id"), page.alias("page"), page.alias("page_end"), "text")
    sources = gold.select(F.col("item_id").alias("qid"), F.lit(0).alias("source"), F.lit("corpus").alias("doc_id"), page.alias("page"), F.substring("text", 1, 40).alias("quote"))
    return evaluation.source_ranks(ranked, texts, sources)


@query(f"WITH {_POSTED}, {_GOLD} SELECT qid, CAST(rk AS INT) AS rk FROM fs")
def gold_covers_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir).select("qid", "rk")


@query(f"""WITH {_POSTED}, {_GOLD} SELECT qid, CASE WHEN rk <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_5, CASE WHEN rk <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_5,
 CASE WHEN rk <= 5 THEN round(1.0 / rk, 6) ELSE 0.0 END::DOUBLE AS mrr_5, CASE WHEN rk <= 5 THEN round(1 / log2(rk + 1), 6) ELSE 0.0 END::DOUBLE AS ndcg_5 FROM fs""")
def retrieval_metrics(spark, sf_dir):
    m = evaluation.question_metrics(_ranks(spark, sf_dir), (5,))
    return m.select("qid", *(F.round(c, 6).alias(c) for c in m.columns if c != "qid"))


@query(f"""WITH {_POSTED}, {_GOLD} SELECT CASE WHEN rk IS NULL THEN 'none' WHEN rk <= 1 THEN '1' WHEN rk <= 5 THEN '2-5' WHEN rk <= 10 THEN '6-10' WHEN rk <= 20 THEN '11-20' ELSE '21-50' END AS bucket, count(*) AS n FROM fs GROUP BY 1""")
def rank_histogram(spark, sf_dir):
    return _ranks(spark, sf_dir).groupBy(evaluation.rank_histogram(F.col("rk")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT 'all' AS dimension, 'all' AS value, count(*) AS n, round(avg(n_chars), 4) AS mean, sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END)::BIGINT AS long FROM documents
UNION ALL SELECT 'lang', lang, count(*), round(avg(n_chars), 4), sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END)::BIGINT FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*), round(avg(n_chars), 4), sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END)::BIGINT FROM documents GROUP BY source""")
def metrics_by_dimension(spark, sf_dir):
    return evaluation.by_dimensions(table(spark, sf_dir, "documents"), ["lang", "source"], F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.count_if(F.col("n_chars") > 2000).alias("long"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 1) AS p50, round(quantile_cont(value, 0.95), 1) AS p95, round(avg(value), 1) AS mean, round(max(value), 1) AS max FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*evaluation.latency_stats("value"))


@query("""SELECT CASE WHEN quality = toxic THEN 1 ELSE 0 END AS agree, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM labels GROUP BY 1""")
def agreement_rate(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.groupBy((F.col("quality") == F.col("toxic")).cast("int").alias("agree")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("rate"))


@query("""WITH c AS (SELECT doc_id, list(DISTINCT turn) AS x FROM (SELECT conv_id AS doc_id, turn, role FROM conversations) GROUP BY 1),
s AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS u, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) AS sup, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS prec FROM conversations GROUP BY 1)
SELECT conv_id, round(u / n, 6) AS faithfulness, round((SELECT count(*) FROM conversations t WHERE t.conv_id = s.conv_id AND turn % 3 = 0) / (2.0 * n), 6) AS citation_precision, round(sup / n, 6) AS citation_recall FROM s""")
def judge_scores(spark, sf_dir):
    claim = F.struct(F.array(F.lit(1), F.lit(2)).alias("cited"), (F.col("role") == "user").alias("supported"), F.when(F.col("turn") % 3 == 0, F.array(F.lit(2), F.lit(9))).otherwise(F.array(F.lit(9))).alias("supporting_cited"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(claim).alias("claims"))
    return rows.select("conv_id", *evaluation.judgment_scores(F.col("claims"))).select("conv_id", *(F.round(c, 6).alias(c) for c in ("faithfulness", "citation_precision", "citation_recall")))


@query("""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), x AS (SELECT *, n * 50 / sum(n) OVER ()::DOUBLE AS e FROM g),
f AS (SELECT *, floor(e) AS fl, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, source) AS place FROM x)
SELECT source, n, CAST(fl + CASE WHEN place <= 50 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")
def largest_remainder_sample(spark, sf_dir):
    return evaluation.largest_remainder(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), "n", 50, "source")


@query("""WITH x AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS place, greatest(1, floor(count(*) OVER (PARTITION BY role) / 20)) AS step FROM conversations)
SELECT conv_id, turn, role FROM x WHERE place % step = 0 AND place / step < 20""")
def stratified_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("o", F.struct("conv_id", "turn"))
    return evaluation.every_kth(rows, "role", "o", 20).select("conv_id", "turn", "role")


# Text ---------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|[\p{Cf}\p{Co}\x{80}-\x{9f}]', '', 'g'), '[\p{Z}\t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_hash FROM documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.clean_text("text"), 256).alias("clean_hash"))


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_dup_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(X.content_hash("text").alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query(f"""WITH x AS (SELECT lang, lower(substr(text, 1, 20000)) AS s FROM documents), y AS (SELECT lang, length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) AS a, length(regexp_replace(s, '[^{X.VIETNAMESE}]', '', 'g')) AS v FROM x)
SELECT lang, CASE WHEN a > 0 AND v / greatest(a, 1) > 0.05 THEN 'vi' ELSE 'en' END AS detected, count(*) AS n FROM y GROUP BY ALL""")
def lang_confusion(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", X.detect_language("text").alias("detected")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS INT) AS tokens FROM documents""")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count("text").alias("tokens"))


@query(r"""WITH s AS (SELECT DISTINCT id, k, array_to_string(w[i : i + 6], ' ') AS g FROM (SELECT id, k, w, unnest(range(1, len(w) - 5)) AS i FROM (
  SELECT doc_id AS id, 'd' AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents UNION ALL SELECT item_id, 'b', regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') FROM benchmark) WHERE len(w) >= 7))
SELECT b.id AS item_id, d.id AS doc_id, count(*) AS n FROM s b JOIN s d USING (g) WHERE b.k = 'b' AND d.k = 'd' GROUP BY ALL""")
def contamination_shingles(spark, sf_dir):
    found = index.shared_shingles(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return found.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), "n")


@query(r"""WITH l AS (SELECT source AS doc, doc_id AS page, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS l FROM documents),
e AS (SELECT DISTINCT doc, page, regexp_replace(trim(x), '[0-9]+', '#', 'g') AS line_key FROM (SELECT doc, page, unnest(list_concat(l[1:3], l[greatest(len(l) - 2, 1):len(l)])) AS x FROM l WHERE len(l) > 0))
SELECT doc, line_key, count(*) AS n_pages FROM e GROUP BY ALL HAVING count(*) >= 3""")
def running_lines(spark, sf_dir):
    return index.running_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text", share=0.0)


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || chr(10) || text AS standalone FROM conversations""")
def concat_followups(spark, sf_dir):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before), F.lit("\n"), F.col("text")).alias("standalone"))


def _paragraphs(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return chunking.reflow(lines)


@query(r"""WITH l AS (SELECT doc_id, i AS pos, l[i] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
w AS (SELECT doc_id, list_sort(list(length(t))) AS s FROM l GROUP BY doc_id),
b AS (SELECT doc_id, pos, t, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS p, s[CAST(floor(0.9 * (len(s) - 1)) AS INT) + 1] * 0.7 AS wide FROM l JOIN w USING (doc_id)),
j AS (SELECT *, p IS NOT NULL AND NOT regexp_matches(t, '^(#{1,6}\s|\||[-•*+]\s|[“"]?\(?([0-9]+|[a-zđ])[.)]\s)') AND NOT regexp_matches(p, '^\|') AND (regexp_matches(t, '^\p{Ll}')
  OR (length(p) >= wide AND NOT regexp_matches(p, '[.;:!?…][”"’)\]]*$') AND NOT regexp_matches(p, '^#{1,6}\s'))) AS joins FROM b),
g AS (SELECT doc_id, t, pos, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS par FROM j)
SELECT doc_id, CAST(par AS BIGINT) AS par, sha256(string_agg(t, ' ' ORDER BY pos)) AS hash, CAST(count(*) AS INT) AS lines FROM g GROUP BY doc_id, par""")
def reflow_paragraphs(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("doc_id", F.col("par").cast("long").alias("par"), X.content_hash("text").alias("hash"), "lines")


@query()
def chunk_generic(spark, sf_dir):
    return chunking.chunk_generic(_paragraphs(spark, sf_dir), max_tokens=100)


@query()
def chunk_stats(spark, sf_dir):
    return chunk_generic(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.avg("token_count").alias("mean_tokens"), F.max("token_count").alias("max_tokens"))


# Ledger -------------------------------------------------------------------------------------------------------

_PRICES = [("signup", 0.4, 1.6, 0.1, None), ("purchase", 2.0, 8.0, 0.5, 2.5), ("error", 0.1, 0.4, None, None), ("view", 0.15, 0.6, 0.075, None), ("click", 0.25, 2.0, 0.025, None)]
_PRICES_SQL = ", ".join(f"('{a}', {b}, {c}, {d or 'NULL'}, {e or 'NULL'})" for a, b, c, d, e in _PRICES)


@query(f"""SELECT event_type, round(sum(((t - t // 4 - t // 10) * input + (t // 4) * coalesce(cached_input, input) + (t // 10) * coalesce(cache_write, input) + (t // 2) * output) / 1000000), 6) AS cost
FROM (SELECT event_type, CAST(floor(abs(value) * 100) AS BIGINT) AS t FROM events) JOIN (VALUES {_PRICES_SQL}) AS p(event_type, input, output, cached_input, cache_write) USING (event_type) GROUP BY event_type""")
def price_cost(spark, sf_dir):
    prices = spark.createDataFrame(_PRICES, "event_type string, input double, output double, cached_input double, cache_write double")
    rows = table(spark, sf_dir, "events").select("event_type", F.floor(F.abs("value") * 100).cast("long").alias("t")).join(F.broadcast(prices), "event_type")
    cost = ledger.price_cost(F.col("t"), F.expr("t div 4"), F.expr("t div 10"), F.expr("t div 2"))
    return rows.groupBy("event_type").agg(F.round(F.sum(cost), 6).alias("cost"))


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS calls, round(sum(value), 2) AS spent FROM events GROUP BY ALL""")
def ledger_daily_spend(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", ledger.local_day(F.col("ts")).alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("spent"))


@query("""SELECT CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day, count(*) AS calls, round(sum(value), 2) AS spent FROM events GROUP BY ALL""")
def pacific_day_spend(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(ledger.local_day(F.col("ts"), "America/Los_Angeles").alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("spent"))


@query("""SELECT event_id, count(*) OVER w AS calls, round(sum(value) OVER w, 3) AS used FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""")
def sliding_60s_usage(spark, sf_dir):
    return ledger.sliding_usage(table(spark, sf_dir, "events"), "event_type", "ts", "value").select("event_id", "calls", F.round("used", 3).alias("used"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS running FROM events""")
def budget_running_total(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return ledger.running_total(rows, ["event_type", "day"], ["ts", "event_id"], "value").select("event_id", F.round("running", 3).alias("running"))


# Index maintenance --------------------------------------------------------------------------------------------


@query("""SELECT source, count(*) AS n FROM documents GROUP BY source""")
def facet_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT source, sha256(text) AS key FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL), n AS (SELECT source, sha256(text) AS key FROM documents WHERE doc_id % 2 = 0 AND source < 'src15' GROUP BY ALL)
SELECT source, sum(stale)::BIGINT AS stale, sum(live)::BIGINT AS live FROM (
  SELECT source, 1 AS stale, 0 AS live FROM o WHERE source IN (SELECT source FROM n) AND (source, key) NOT IN (SELECT (source, key) FROM n)
  UNION ALL SELECT source, 0, 1 FROM n UNION ALL SELECT source, 0, 1 FROM o WHERE source NOT IN (SELECT source FROM n)) GROUP BY source""")
def upsert_stale_delete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("key", X.content_hash("text")).select("doc_id", "source", "key")
    old = docs.where("doc_id % 3 <> 0").select("source", "key").distinct()
    live, stale = index.upsert(old, docs.where("doc_id % 2 = 0 AND source < 'src15'").select("source", "key"), "source", "key")
    return live.select("source", F.lit(0).alias("stale"), F.lit(1).alias("live")).union(stale.select("source", F.lit(1), F.lit(0))).groupBy("source").agg(F.sum("stale").alias("stale"), F.sum("live").alias("live"))


@query("""SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""")
def cache_misses(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", X.content_hash("text").alias("hash"))
    return index.cache_misses(hashed.select("hash"), hashed.where("doc_id % 2 = 0").select("hash"), ["hash"])


# Gold sets ----------------------------------------------------------------------------------------------------

_NORMAL = "trim(regexp_replace(replace({}, chr(173), ''), '\\s+', ' ', 'g'))"


def _quotes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Benchmark items, whole, as quotes from one collection of all documents (its pages), and the pages."""
    pages = table(spark, sf_dir, "documents").select(F.lit("corpus").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("qid"), F.lit(0).alias("source"), F.lit("corpus").alias("doc_id"), F.col("item_id").alias("page"), F.col("text").alias("quote")), pages


@query(f"""WITH q AS (SELECT item_id AS qid, item_id AS page, {_NORMAL.format("text")} AS quote FROM benchmark),
h AS (SELECT qid, any_value(q.page) AS page, list_sort(list(DISTINCT d.doc_id) FILTER (d.doc_id IS NOT NULL)) AS f FROM q LEFT JOIN documents d ON contains({_NORMAL.format("d.text")}, q.quote) GROUP BY qid)
SELECT qid, page, coalesce(array_to_string(f, ','), '') AS found, CASE WHEN list_contains(f, page) THEN 'ok' WHEN len(f) = 1 THEN 'other_page' WHEN len(f) > 1 THEN 'many_pages' ELSE 'nowhere' END AS outcome FROM h""")
def quote_outcomes(spark, sf_dir):
    return gold.quote_places(*_quotes(spark, sf_dir)).select("qid", "page", F.array_join(F.col("found").cast("array<string>"), ",").alias("found"), "outcome")


@query(f"""WITH q AS (SELECT item_id AS qid, item_id AS page, {_NORMAL.format("text")} AS quote FROM benchmark),
h AS (SELECT qid, any_value(q.page) AS page, list(DISTINCT d.doc_id) FILTER (d.doc_id IS NOT NULL) AS f FROM q LEFT JOIN documents d ON contains({_NORMAL.format("d.text")}, q.quote) GROUP BY qid)
SELECT qid, CASE WHEN len(f) = 1 AND NOT list_contains(f, page) THEN f[1] ELSE page END AS page FROM h""")
def fixed_pages(spark, sf_dir):
    sources, pages = _quotes(spark, sf_dir)
    return gold.fix_pages(sources, gold.quote_places(sources, pages)).select("qid", "page")


_MANIFEST = [(f"src{i}", f"{i}/20", [f"Điều {i}", f"Article {2 * i + 1}"]) for i in range(0, 20, 2)]


@query(f"""WITH m AS (SELECT doc_id, unnest(a) AS article FROM (VALUES {", ".join(f"('{d}', {a})" for d, _, a in _MANIFEST)}) AS v(doc_id, a)), n AS (SELECT DISTINCT doc_id, regexp_extract(article, '[0-9]+') AS n FROM m)
SELECT d.doc_id, 'Article ' || (d.doc_id % 40) AS article, n.n IS NOT NULL AS amended FROM documents d LEFT JOIN n ON n.doc_id = d.source AND n.n = CAST(d.doc_id % 40 AS VARCHAR)""")
def amended_chunks(spark, sf_dir):
    manifest = spark.createDataFrame(_MANIFEST, "doc_id string, number string, amended_articles array<string>")
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk"), F.concat(F.lit("Article "), (F.col("doc_id") % 40).cast("string")).alias("article"))
    return gold.mark_amended(chunks, manifest).select(F.col("chunk").alias("doc_id"), "article", "amended")


@query("""WITH g AS (SELECT conv_id, role, turn % 3 AS a, list_sort(list(DISTINCT turn + 1)) AS ns FROM conversations WHERE turn % 2 = 0 GROUP BY ALL)
SELECT conv_id, ns[1] AS n, 'Article ' || a || ' of the ' || role || CASE WHEN role = 'user' THEN ' (1/20)' ELSE '' END || ' has been amended by x, y. Citation [' || array_to_string(ns, '][') || '] shows the original text, which may be outdated.' AS warning FROM g""")
def amendment_warnings(spark, sf_dir):
    cited = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("n"), F.col("role").alias("doc_id"), F.concat(F.lit("Article "), (F.col("turn") % 3).cast("string")).alias("article"),
        F.col("role").alias("title"), F.when(F.col("role") == "user", "1/20").alias("number"), (F.col("turn") % 2 == 0).alias("amended"), F.array(F.lit("x"), F.lit("y")).alias("amended_by"),
    )
    return gold.amendment_warnings(cited).withColumnRenamed("qid", "conv_id")


@query("""WITH i AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'numeric' WHEN 2 THEN 'multi_hop' ELSE 'multi_turn' END AS k, doc_id % 3 AS n, lang = 'en' AS h, doc_id % 5 = 0 AS twice FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN k = 'unanswerable' AND n > 0 THEN 'unanswerable_with_sources' END, CASE WHEN k <> 'unanswerable' AND n = 0 THEN 'answerable_without_sources' END,
  CASE WHEN k = 'multi_hop' AND n < 2 THEN 'multi_hop_under_two_sources' END, CASE WHEN (k = 'multi_turn') <> h THEN 'history_and_type_differ' END, CASE WHEN twice THEN 'repeated_tags' END) AS errors FROM i""")
def gold_item_errors(spark, sf_dir):
    at = F.col("doc_id") % 4
    kind = F.when(at == 0, "unanswerable").when(at == 1, "numeric").when(at == 2, "multi_hop").otherwise("multi_turn")
    sources = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    history = F.when(F.col("lang") == "en", F.array("lang"))
    tags = F.when(F.col("doc_id") % 5 == 0, F.array("source", "lang", "source")).otherwise(F.array("source", "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(gold.item_errors(kind, sources, history, tags), ",").alias("errors"))


@query("""WITH w(type, low, high) AS (VALUES ('view', 0.3, 0.4), ('click', 0.1, 0.25), ('refund', 0.1, 0.2)), c AS (SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1)
SELECT type, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM events), 6) AS share, coalesce(n, 0) / (SELECT count(*) FROM events) BETWEEN low AND high AS ok FROM w LEFT JOIN c USING (type)""")
def type_shares(spark, sf_dir):
    found = gold.share_check(table(spark, sf_dir, "events"), "event_type", {"view": (0.3, 0.4), "click": (0.1, 0.25), "refund": (0.1, 0.2)})
    return found.withColumn("share", F.round("share", 6))


@query("""SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1""")
def duplicate_ids(spark, sf_dir):
    return gold.duplicate_ids(table(spark, sf_dir, "conversations"), "conv_id")


@query(f"""WITH {_POSTED}, {_GOLD}
SELECT qid, round(avg(CASE WHEN contains({_NORMAL.format("d.text")}, {_NORMAL.format("g.quote")}) THEN 1.0 ELSE 0.0 END), 6) AS precision FROM g JOIN (SELECT * FROM rk WHERE rk <= 10) r USING (qid) JOIN documents d ON d.doc_id = r.id GROUP BY qid""")
def context_precision(spark, sf_dir):
    page = F.lit(None).cast("int")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("corpus").alias("doc_id"), page.alias("page"), page.alias("page_end"), "text")
    sources = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.lit("corpus").alias("doc_id"), page.alias("page"), F.substring("text", 1, 40).alias("quote"))
    ranked = retrieval.top_k(_bm25(spark, sf_dir), 10).select("qid", "id", "rk")
    return evaluation.context_precision(ranked, texts, sources, 10).withColumn("precision", F.round("precision", 6))


@query("""WITH x AS (SELECT lang, quality = 1 AS a, toxic = 1 OR doc_id % 7 = 0 AS r, doc_id % 2 = 0 AS c FROM documents JOIN labels USING (doc_id)),
y AS (SELECT 'all' AS dimension, 'all' AS value, a, r, c FROM x UNION ALL SELECT 'lang', lang, a, r, c FROM x)
SELECT dimension, value, count(*) AS n, count(*) FILTER (a) AS answerable, round(count(*) FILTER (NOT a AND r) / nullif(count(*) FILTER (NOT a), 0), 6) AS correct_refusal, round(count(*) FILTER (a AND r) / nullif(count(*) FILTER (a), 0), 6) AS false_refusal, count(*) FILTER (a AND r AND c) AS false_refusal_with_gold FROM y GROUP BY ALL""")
def answer_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    wanted = evaluation.answer_quality(F.col("quality") == 1, (F.col("toxic") == 1) | (F.col("doc_id") % 7 == 0), F.col("doc_id") % 2 == 0)
    return evaluation.by_dimensions(rows, ["lang"], *wanted).withColumns({c: F.round(c, 6) for c in ("correct_refusal", "false_refusal")})


# Page lines, legal texts, calls -------------------------------------------------------------------------------


@query("""SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_offset FROM documents""")
def page_offsets(spark, sf_dir):
    return cleanup.continue_pages(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars").select("source", "doc_id", "page_offset")


@query(r"""WITH l AS (SELECT source, doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS l FROM documents),
k AS (SELECT DISTINCT source, doc_id, regexp_replace(trim(x), '[0-9]+', '#', 'g') AS k FROM (SELECT source, doc_id, unnest(list_concat(l[1:3], l[greatest(len(l) - 2, 1):len(l)])) AS x FROM l WHERE len(l) > 0)),
t AS (SELECT source, count(*) AS n FROM l WHERE len(l) > 0 GROUP BY 1), r AS (SELECT source, list(k) AS ks FROM (SELECT k.source, k.k FROM k JOIN t USING (source) GROUP BY k.source, k.k, t.n HAVING count(*) >= greatest(3, ceil(t.n * 0.02))) GROUP BY 1)
SELECT doc_id, CAST(len(s) AS INT) AS lines, sha256(array_to_string(s, chr(10))) AS hash FROM (SELECT doc_id, list_filter(l, lambda x, i: NOT ((i <= 3 OR i > len(l) - 3) AND list_contains(coalesce(ks, []), regexp_replace(trim(x), '[0-9]+', '#', 'g')))) AS s FROM l LEFT JOIN r USING (source))""")
def stripped_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    keys = index.running_lines(docs, "source", "doc_id", "text", share=0.02)  # at most 2 * 3 / 0.02 for a source
    running = keys.groupBy(F.col("doc").alias("source")).agg(F.collect_list("line_key").alias("running"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    rows = docs.withColumn("lines", lines).join(running, "source", "left").withColumn("kept", cleanup.strip_furniture(F.col("lines"), F.col("running")))
    return rows.select("doc_id", F.size("kept").alias("lines"), F.sha2(F.array_join("kept", "\n"), 256).alias("hash"))


def _lines(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.withColumn("page", (F.col("pos") / 40).cast("int") + 1)


@query()
def dehyphenated_lines(spark, sf_dir):
    return cleanup.dehyphenate(_lines(spark, sf_dir))


@query()
def legal_chunks(spark, sf_dir):
    """Each document as a law: every fifth line begins an article."""
    article = F.concat(F.lit("Article "), (F.col("pos") / 5 + 1).cast("int").cast("string"), F.lit(". Of this"))
    lines = _lines(spark, sf_dir).withColumn("parts", F.when(F.col("pos") % 5 == 0, F.array(article, F.col("text"))).otherwise(F.array("text")))
    rows = lines.select("doc_id", "page", "pos", F.posexplode("parts").alias("at", "text")).select("doc_id", (F.col("pos") * 2 + F.col("at")).alias("pos"), "text", "page")
    return legal.chunk_documents(rows, "en", 100)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 60.0 * (event_id % 3) + 2.5 WHEN 1 THEN 7.0 WHEN 2 THEN 3.0 END::DOUBLE AS wait, event_id % 4 = 3 AS daily,
  CASE WHEN event_type IN ('error', 'view') THEN 0.0 ELSE value END AS charged, CAST(floor((event_id % 1000) * 1.1) AS BIGINT) + 50 AS counted, CASE WHEN event_type = 'view' THEN 'm' ELSE 'm@' || event_type END AS price_key FROM events""")
def failed_calls(spark, sf_dir):
    at = F.col("event_id") % 4
    said = F.concat(F.lit("try again in "), (F.col("event_id") % 3).cast("string"), F.lit("m2.5s"))
    message = F.when(at == 0, said).when(at == 1, '{"retryDelay": "7s"}').when(at == 2, "x").otherwise("requests per day")
    status = F.when(F.col("event_type").isin("error", "view"), 404).otherwise(503)
    tier = F.when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", providers.advised_wait(message, F.when(at == 2, "3")).alias("wait"), providers.is_daily_quota(message).alias("daily"),
        ledger.cost_on_error(status, F.col("value")).alias("charged"), ledger.counted_input(F.col("event_id") % 1000).alias("counted"), ledger.price_key(F.lit("m"), tier).alias("price_key"),
    )


@query("""SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer, count(*) AS deltas FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def assembled_answers(spark, sf_dir):
    """Deltas of a stream to whole answers."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("d"))
    return rows.select("conv_id", F.array_join("d.text", "").alias("answer"), F.size("d").cast("long").alias("deltas"))
