"""Queries over whole tables: no cuts, whole quotes, blocks of vectors."""

import duckdb
import pytest

from lodestream.plans import catalog
from test_queries import rows

#: Limits that queries and SQL once had: neither may have them again.
CUTS = ("ORDER BY vec_id LIMIT", "df >= 5", "tf > 1", "d.lang = q.src", "substr(text, 1, 40)) AS quote FROM benchmark),\nh AS")


def test_no_cuts():
    assert not [(name, cut) for name, sql in catalog.SQL.items() for cut in CUTS if cut in sql]


def test_quotes_are_whole_and_of_any_language(spark, tmp_path):
    same = "The first forty characters are the same, then "
    spark.createDataFrame([(1, same + "this"), (2, "ein Satz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(7, "en", f"x {same}that"), (8, "fr", f"y {same}this"), (9, "de", "Noch ein Satz.")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.quote_outcomes(spark, str(tmp_path)).orderBy("qid").collect()
    assert [(r.qid, r.found, r.outcome) for r in found] == [(1, "8", "other_page"), (2, "9", "other_page")]


@pytest.mark.parametrize("block", [7, 512])
def test_dense_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(catalog.retrieval, "BLOCK", block)
    data = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(1, 61)] + [(100, [0.0, 0.0, 0.0]), (120, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    found = catalog.retrieval.top_k(catalog.retrieval.dense_scores(frame, frame.where("vec_id % 20 = 0"), 4), 4).select("qid", "id", "score", "rk")
    cosine = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
    con = duckdb.connect()
    con.register("given", frame.toPandas())
    con.execute("create view embeddings as from given")
    want = f"""SELECT qid, id, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, id) AS rk
      FROM (SELECT q.vec_id AS qid, e.vec_id AS id, CASE WHEN 100 NOT IN (q.vec_id, e.vec_id) THEN round({cosine}, 6) END AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rk <= 4"""
    assert rows(found.toPandas()) == rows(con.sql(want).df())
