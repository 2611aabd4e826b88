"""The corpus pipeline: quality classifier, line dedup, near duplicates, decontamination, packing.

Each stage takes the documents that its predecessor kept and returns documents (the last: packed pieces):

1. ``quality``: documents whose quality score is under the classifier's cut go.
2. ``lines``: lines that match an earlier line go. ``n_chars`` follows the text. A document that had words and has none
   left goes, as all it said is said elsewhere.
3. ``near_duplicates``: of each group of near-duplicate documents (shingles of five words, Jaccard index 0.8 or more) the one
   with the smallest id stays. ``op7_ngram_jaccard`` has its own setting, three words and 0.9.
4. ``benchmark``: documents in which a benchmark window occurs go.
5. ``pack``: the rest is tokenised and packed into sequences.

Between stages the documents are written as Parquet in the shared folder and read again, so a lost executor costs a part
of one stage. Nulls, empty texts and tables, repeated rows and further columns are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import decontaminate, jaccard_join, line_dedup, packing, quality_classifier
from lodestream.llm.shared import load, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, load(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).rlike(line_dedup.WORD), F.lit(False))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"), said("text").alias("had_words"))
    left = line_dedup.dedup_lines(rows).where(~F.col("had_words") | said("text"))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*(F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark").select("item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]

#: The fitted classifier and the fitted packing are not expressible in SQL. ``tests/test_pipeline.py`` holds ``lines``,
#: ``near_duplicates`` and, by the ids of the result, ``run`` from ``lines`` on against brute force, and ``quality`` against
#: the classifier's own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"after-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
