"""Index maintenance: upserts with stale deletion, content-addressed cache, duplicates, corpus statistics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestream.functions import text as X
from lodestream.operators import chunking, retrieval


class SignatureMismatch(ValueError):
    """An index was made under another configuration."""


def check_signature(made: dict, wanted: dict) -> None:
    if wrong := {k for k in made.keys() | wanted.keys() if made.get(k) != wanted.get(k)}:
        raise SignatureMismatch(f"the index differs in {', '.join(sorted(wrong))}")


def upsert(old: DataFrame, new: DataFrame, doc: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The index after the documents of ``new`` were written again, and the stale rows that this removes."""
    touched = new.select(doc).distinct()
    stale = old.join(touched, doc, "left_semi").join(new.select(doc, key), [doc, key], "left_anti")
    return old.join(touched, doc, "left_anti").unionByName(new.dropDuplicates([doc, key])), stale


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti")


def merge_cache(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"))
    return both.withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_new", "_at")


def shingles(rows: DataFrame, id_col: str, text_col: str, words: int = 7) -> DataFrame:
    """``id, shingle`` of lower-cased words, as often as they occur."""
    w = F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    base = rows.select(F.col(id_col).alias("id"), w.alias("w"))
    start = F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1)))
    made = F.when(F.size("w") >= words, F.transform(start, lambda i: F.array_join(F.slice("w", i, words), " ")))
    return base.select("id", F.explode_outer(made).alias("shingle")).where(F.col("shingle").isNotNull())


def shared_shingles(docs: DataFrame, items: DataFrame, id_col: str, item_col: str, text_col: str = "text", words: int = 7) -> DataFrame:
    """``item, doc, n``: how many distinct shingles of an item a document has. Shingles of documents that no item has are
    dropped before anything is shuffled, if the items are few enough for Spark to send them."""
    wanted = shingles(items, item_col, text_col, words).distinct().withColumnRenamed("id", "item")
    met = shingles(docs, id_col, text_col, words).withColumnRenamed("id", "doc").join(wanted, "shingle")
    return met.distinct().groupBy("item", "doc").agg(F.count("*").alias("n"))


def running_lines(pages: DataFrame, doc: str, page: str, text: str, edge: int = 3, least: int = 3, share: float = 0.5) -> DataFrame:
    """Digit-masked first and last lines that stand on many pages of a document: ``doc, line_key, n_pages``."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    rows = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), lines.alias("l")).where(F.size("l") > 0)
    edges = F.array_distinct(F.concat(F.slice("l", 1, edge), F.slice("l", F.greatest(F.size("l") - edge + 1, F.lit(1)), edge)))
    keys = rows.select("doc", "page", F.explode(F.transform(edges, lambda x: F.regexp_replace(F.trim(x), "[0-9]+", "#"))).alias("line_key")).distinct()
    counts = keys.groupBy("doc", "line_key").agg(F.count("*").alias("n_pages"))
    total = rows.groupBy("doc").agg(F.count("*").alias("n"))
    return counts.join(total, "doc").where(F.col("n_pages") >= F.greatest(F.lit(least), F.ceil(F.col("n") * share))).select("doc", "line_key", "n_pages")


# A stored index -------------------------------------------------------------------------------------------------


def create(spark: SparkSession, path: str, signature: dict) -> None:
    """An empty index under ``path``, or the one that is there if its signature is the same. Chunks are stored by user_id,
    postings by user_id and term bucket, the signature beside them."""
    if (made := _signature(spark, path)) is not None:
        check_signature(made, signature)
        return
    spark.createDataFrame([(json.dumps(signature, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/signature")


def _signature(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(spark.read.text(f"{path}/signature").first()[0])
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def load_index(spark: SparkSession, path: str, signature: dict, fields: list[str], user: str | None = None, doc: str | None = None) -> DataFrame:
    """The stored chunks' ``fields``, of one user and document if named: only that user's folder is read."""
    check_signature(_signature(spark, path) or {}, signature)
    rows = spark.read.parquet(f"{path}/chunks")
    rows = rows if user is None else rows.where(F.col("user_id") == user)
    return (rows if doc is None else rows.where(F.col("doc_id") == doc)).select(*fields)


def index_document(stored: DataFrame | None, chunks: DataFrame, cache: DataFrame, make: Callable, user: str, signature: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The user's chunks after one document was indexed again, the cache with what was embedded for it, and a report
    (chunks, embedded, removed).

    chunks: doc_id (just one), title, so_hieu, heading_path, text, content_hash and further columns. Points are named by
    user, document and content, so chunks that didn't change keep their point; points that the document no longer has go.
    """
    docs = [r[0] for r in chunks.select("doc_id").distinct().limit(2).collect()]
    if len(docs) != 1:
        raise ValueError("chunks of just one document are indexed at a time")
    text = X.embedding_text(F.coalesce("title", F.lit("")), F.col("so_hieu"), F.coalesce("heading_path", F.lit("")), F.col("text"))
    rows = chunks.withColumns({"user_id": F.lit(user), "point_id": X.point_id(F.lit(user), "doc_id", "content_hash"), "embedded": text}).dropDuplicates(["point_id"])
    rows = rows.withColumn("hash", X.content_hash("embedded"))
    missing = cache_misses(rows.select("hash", F.col("embedded").alias("text"), F.lit(signature).alias("signature")), cache, ["signature", "hash"])
    new = embed(missing, make).drop("text")
    merged = merge_cache(cache, new, ["signature", "hash"])
    made = rows.join(merged.where(F.col("signature") == signature).select("hash", "vector"), "hash").drop("embedded")
    if stored is None:
        live, removed = made, made.limit(0)
    else:
        live, removed = upsert(stored, made.select(*stored.columns), "doc_id", "point_id")
    report = rows.agg(F.count("*").alias("chunks")).crossJoin(missing.agg(F.count("*").alias("embedded"))).crossJoin(removed.agg(F.count("*").alias("removed")))  # a row each
    return live, merged, report


def embed(texts: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], most: int = 64, most_tokens: int = 200_000) -> DataFrame:
    """Adds ``vector`` to rows with a ``text``, in batches of a bounded number of texts and words. ``make`` builds the
    client on the executor; it returns vectors in the order of its texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", vector array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for batch in batches:
            values = batch.column(batch.schema.names.index("text")).to_pylist()
            vectors: list = []
            for part in chunking.make_batches([chunking.word_count(v) for v in values], most, most_tokens):
                vectors += client([values[i] for i in part])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return texts.mapInArrow(run, schema)


def embed_queries(queries: DataFrame, make: Callable, text: str = "text") -> DataFrame:
    """Adds ``vector`` to queries. They are never cached; an empty one is an error."""
    checked = F.when(F.trim(text) != "", F.col(text)).otherwise(F.raise_error(F.lit("a query is empty")).cast("string"))
    return embed(queries.withColumn("text", checked), make)


def hashing_embedder(dimensions: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A deterministic embedder without a model: signed counts of words in hashed places, scaled to length 1."""

    def make() -> Callable[[list[str]], list[list[float]]]:
        def run(texts: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                v = np.zeros(dimensions)
                for word in text.lower().split():
                    h = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
                    v[h % dimensions] += 1 if h >> 63 else -1
                out.append((v / max(1e-12, float(np.sqrt(v @ v)))).tolist())
            return out

        return run

    return make


@F.arrow_udf(LongType())
def _term_index(terms: pa.Array) -> pa.Array:
    return pa.array([None if t is None else int.from_bytes(blake2b(t.encode(), digest_size=4).digest(), "little") for t in terms.to_pylist()], pa.int64())


def term_index(term: Column | str) -> Column:
    """A term's place in a sparse vector: its 4-byte BLAKE2b digest, little-endian. Terms that collide add up."""
    return _term_index(F.col(term) if isinstance(term, str) else term)


def sparse_vectors(posted: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """``by, indices, values`` of postings (by, term): places ascending, weights of colliding terms added."""
    placed = posted.select(*by, term_index("term").alias("i"), weight.alias("w")).groupBy(*by, "i").agg(F.sum("w").alias("w"))
    rows = placed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("v"))
    return rows.select(*by, F.transform("v", lambda x: x["i"]).alias("indices"), F.transform("v", lambda x: x["w"]).alias("values"))


def write_postings(chunks: DataFrame, path: str, id_col: str, text_col: str, tenant: str = "user_id", buckets: int = 64) -> None:
    """Postings of all texts by tenant and term bucket, and each tenant's number of texts: see ``retrieval.read_postings``."""
    posted = retrieval.postings(chunks, id_col, text_col, tenant).withColumn("bucket", retrieval.term_bucket("term", buckets))
    posted.repartition(tenant, "bucket").write.mode("overwrite").partitionBy(tenant, "bucket").parquet(f"{path}/postings")
    chunks.groupBy(tenant).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")
