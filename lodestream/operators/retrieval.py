"""Sparse and dense retrieval, rank fusion, re-ranking: DataFrame plans over long tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import terms, tokenised

K1, B, AVG_DOC_LEN = 1.2, 0.75, 215.0
RRF_K = 2
#: Vectors that are held at once, of the rows and of the queries.
BLOCK = 512


def term_rows(docs: DataFrame, id_col: str, text_col: str, *keys: str) -> DataFrame:
    """``(keys, id, dl, term)``: a row for each word and bigram of each text; dl counts words."""
    rows = tokenised(docs, text_col, *keys, F.col(id_col).alias("id")).select(*keys, "id", F.size("words").alias("dl"), F.concat("words", "pairs").alias("t"))
    # outer, as the inner form would filter on the size of the terms, and make them twice
    return rows.select(*keys, "id", "dl", F.explode_outer("t").alias("term")).where(F.col("term").isNotNull())


def postings(docs: DataFrame, id_col: str, text_col: str, *keys: str) -> DataFrame:
    """``(keys, id, term, tf, dl)``; dl counts words, tf words and bigrams."""
    return term_rows(docs, id_col, text_col, *keys).groupBy(*keys, "id", "dl", "term").agg(F.count("*").alias("tf"))


def tf_weight(tf: Column, dl: Column, avg: float = AVG_DOC_LEN) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avg)))


def query_terms(queries: DataFrame, id_col: str, text_col: str, *keys: str) -> DataFrame:
    """``(keys, qid, term)``: each distinct term of a query weighs 1."""
    return queries.select(*keys, F.col(id_col).alias("qid"), F.explode_outer(F.array_distinct(terms(text_col))).alias("term")).where(F.col("term").isNotNull())


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Ranks by score, ties by id. The filter on the rank lets Spark prune groups before it shuffles."""
    return scores.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id")))).where(F.col("rk") <= k)


def corpus_stats(posted: DataFrame, *keys: str) -> DataFrame:
    """``(keys, term, df, cf)``: how many texts have a term, and how often it occurs in all."""
    return posted.groupBy(*keys, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", tenant: str | None = None) -> DataFrame:
    """``(qid, id, score)``. Terms that no query has are dropped before anything is shuffled.

    With ``tenant``, a column of both tables, a query meets the texts of its tenant only, and counts of texts and terms
    are the tenant's own. Texts are read and split once: the counts of terms are taken from the shuffled postings (both
    uses need the same columns of them, so Spark reuses the exchange).
    """
    keys = [tenant] if tenant else []
    wanted = query_terms(queries, query_id, query_text, *keys)
    found = term_rows(docs, id_col, text_col, *keys).join(wanted.select(*keys, "term").distinct(), [*keys, "term"], "left_semi")
    posted = found.groupBy(*keys, "term", "id", "dl").agg(F.count("*").alias("tf"))
    stats = corpus_stats(posted, *keys).where("cf >= df")
    if tenant:
        stats = stats.join(docs.groupBy(tenant).agg(F.count("*").alias("n")), tenant)
    else:
        stats = stats.withColumn("n", docs.agg(F.count("*")).scalar())
    hits = posted.join(stats.select(*keys, "term", idf(F.col("n"), F.col("df")).alias("idf")), [*keys, "term"]).join(wanted, [*keys, "term"])
    return hits.groupBy("qid", "id").agg(F.sum(F.col("idf") * tf_weight(F.col("tf"), F.col("dl"))).alias("score"))


def read_postings(posted: DataFrame, queries: DataFrame, sizes: DataFrame, query_id: str = "item_id", query_text: str = "text", tenant: str = "user_id", buckets: int = 64) -> DataFrame:
    """``(qid, id, score)`` from a stored index (see ``index.write_postings``): only the buckets of the queries' terms are read.

    posted: tenant, bucket, term, id, dl, tf; sizes: tenant, n (texts of the tenant).
    """
    wanted = query_terms(queries, query_id, query_text, tenant).withColumn("bucket", term_bucket("term", buckets))
    found = posted.join(wanted.select(tenant, "bucket", "term").distinct(), [tenant, "bucket", "term"], "left_semi")
    stats = corpus_stats(found, tenant).where("cf >= df").join(sizes, tenant)
    hits = found.join(stats.select(tenant, "term", idf(F.col("n"), F.col("df")).alias("idf")), [tenant, "term"]).join(wanted.drop("bucket"), [tenant, "term"])
    return hits.groupBy("qid", "id").agg(F.sum(F.col("idf") * tf_weight(F.col("tf"), F.col("dl"))).alias("score"))


def term_bucket(term: str, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _blocks(vectors: DataFrame, id_col: str, vector: str, tenant: str | None = None) -> DataFrame:
    """``tenant, ids, v``: rows of at most ``BLOCK`` ids of one tenant and their vectors, scaled to length 1, one after the
    other. All vectors have one length. A vector of length 0 becomes nulls (not a number)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for owner in pc.unique(batch.column(0)):
                same = pc.equal(whole["tenant"], owner) if owner.is_valid else pc.is_null(whole["tenant"])
                rows = whole.filter(same).combine_chunks()
                for at in range(0, rows.num_rows, BLOCK):
                    part = rows.slice(at, BLOCK).combine_chunks().to_batches()[0]
                    v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        v = v / np.sqrt((v * v).sum(1))[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array([owner.as_py()], pa.string()), pa.array([part.column(1).to_numpy()], pa.list_(pa.int64())), pa.array([v.ravel()], pa.list_(pa.float64()))], names=["tenant", "ids", "v"])

    owner = F.col(tenant).cast("string") if tenant else F.lit("")
    rows = vectors.select(owner.alias("tenant"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(pack, "tenant string, ids array<long>, v array<double>")


def dense_scores(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", digits: int = 6, tenant: str | None = None) -> DataFrame:
    """``(qid, id, score)``: cosines, rounded, of query vectors with all rows; for :func:`top_k` with ``k`` or less.

    Blocks of rows meet blocks of queries of the same ``tenant`` (a column of both tables; null tenants meet nothing), or
    all blocks, in a join that Spark streams (a side under its broadcast limit is sent whole). Vectors are scaled to length
    1 once, so a pair of blocks is one product of matrices. Of each pair of blocks the best ``k`` rows of each query go on,
    ties by id. A vector of length 0 scores null, which ranks last; null ids and vectors are not searched.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, v, qids, q = (np.asarray(batch.column(c)[r].values) for c in range(4))
                v, q = v.reshape(len(ids), -1), q.reshape(len(qids), -1)
                found = q @ v.T
                found = np.copysign(np.floor(np.abs(found) * 10**digits + 0.5) / 10**digits, found) + 0.0  # half up, as round()
                order = np.lexsort((np.broadcast_to(ids, found.shape), -found), axis=1)[:, :k]
                scores = np.take_along_axis(found, order, axis=1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, order.shape[1])), pa.array(ids[order].ravel()), pa.array(scores, mask=np.isnan(scores))], names=["qid", "id", "score"])

    asked = _blocks(queries, id_col, vector, tenant).select("tenant", F.col("ids").alias("qids"), F.col("v").alias("q"))
    rows = _blocks(vectors, id_col, vector, tenant)
    met = rows.join(asked, "tenant") if tenant else rows.crossJoin(asked.drop("tenant"))
    return met.select("ids", "v", "qids", "q").mapInArrow(score, "qid long, id long, score double")


def in_tenant(hits: DataFrame, chunks: DataFrame, queries: DataFrame, tenant: str = "user_id", id_col: str = "id", query_id: str = "qid") -> DataFrame:
    """The hits ``(qid, id, ...)`` whose text is the query's tenant's: the same filter again around a fused search."""
    owned = hits.join(chunks.select(F.col(id_col).alias("id"), F.col(tenant).alias("_owner")), "id").join(queries.select(F.col(query_id).alias("qid"), F.col(tenant).alias("_asker")), "qid")
    return owned.where(F.col("_owner") == F.col("_asker")).select(*hits.columns)


def branches(plans: DataFrame, kinds: tuple[str, ...] = ("dense", "sparse")) -> DataFrame:
    """``qid, branch, kind, text, weight``: a search of each kind for each query text of a plan (qid, queries)."""
    rows = plans.select("qid", F.posexplode_outer("queries").alias("_at", "q")).where(F.col("q").isNotNull())
    kind = F.explode(F.array(*map(F.lit, kinds))).alias("kind")
    rows = rows.select("qid", "_at", F.col("q.text").alias("text"), F.col("q.weight").alias("weight"), kind)
    return rows.select("qid", F.concat_ws("-", "kind", "_at").alias("branch"), "kind", "text", "weight")


def fuse_branches(scored: DataFrame, weights: DataFrame, k: int = RRF_K, prefetch: int = 50, limit: int = 10) -> DataFrame:
    """Weighted reciprocal rank fusion of any number of branches: scored (qid, branch, id, score), weights (qid, branch,
    weight). Branches of weight 0 or less are left out; equal weights of a query count as 1."""
    used = weights.where("weight > 0")
    same = used.groupBy("qid").agg((F.min("weight") == F.max("weight")).alias("_same"))
    used = used.join(same, "qid").select("qid", "branch", F.when(F.col("_same"), 1.0).otherwise(F.col("weight")).alias("_w"))
    ranked = top_k(scored.join(used, ["qid", "branch"]), max(prefetch, limit), ("qid", "branch"))
    total = ranked.groupBy("qid", "id").agg(F.round(F.sum(1 / (k + F.col("rk") / F.col("_w") - 1)), 12).alias("score"))
    return top_k(total, limit)


def fuse(branches: list[tuple[DataFrame, float]], k: int = RRF_K, prefetch: int = 50, limit: int = 10) -> DataFrame:
    """Weighted reciprocal rank fusion of ``(qid, id, score)`` branches.

    Branches of weight 0 or less are left out. One branch is not fused: its scores stay as they are. Equal weights count
    as 1.
    """
    used = [(df, w) for df, w in branches if w > 0]
    if not used:
        raise ValueError("no branch has a positive weight")
    if len(used) == 1:
        return top_k(used[0][0], limit).select("qid", "id", "score", "rk")
    if len({w for _, w in used}) == 1:
        used = [(df, 1.0) for df, _ in used]
    parts = [top_k(df, max(prefetch, limit)).select("qid", "id", (1 / (k + F.col("rk") / F.lit(w) - 1)).alias("part")) for df, w in used]
    total = reduce(DataFrame.unionByName, parts).groupBy("qid", "id").agg(F.sum("part").alias("score"))
    return top_k(total.withColumn("score", F.round("score", 12)), limit)


def apply_ranking(hits: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen ranks (``qid, pick, pos``) first, each once and only if they exist; the others keep their order."""
    valid = chosen.groupBy(F.col("qid").alias("_q"), F.col("pick").alias("_pick")).agg(F.min("pos").alias("pos"))
    rows = hits.join(valid, (F.col("qid") == F.col("_q")) & (F.col("rk") == F.col("_pick")), "left").drop("_q", "_pick")
    order = Window.partitionBy("qid").orderBy(F.col("pos").asc_nulls_last(), "rk")
    return rows.withColumn("new_rk", F.row_number().over(order)).drop("pos")


def rerank(hits: DataFrame, chosen: DataFrame, candidates: int = 50, limit: int = 10) -> DataFrame:
    """Hits ``(qid, id, rk)`` with ``new_rk``: of the first ``candidates`` the chosen ones first, then the others in order;
    what stands behind them keeps its place. At most ``limit`` choices count, and a query with fewer than two candidates
    keeps its order. chosen: qid, pick (a rank), pos."""
    counted = hits.groupBy("qid").agg(F.count("*").alias("_n")).where("_n > 1").select("qid")
    picks = chosen.where(F.col("pos") < limit).where(F.col("pick").between(1, candidates)).join(counted, "qid", "left_semi")
    return apply_ranking(hits, picks)
