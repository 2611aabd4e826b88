"""Prompts, citations, model calls and reports on made-up rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import answers, providers, retrieval, summaries

CHUNK = "struct<chunk_id:string,doc_id:string,title:string,so_hieu:string,heading_path:string,article:string,page:int,page_end:int,amended:boolean,amended_by:array<string>,text:string>"
ONE = ("d:0", "d", "Law <A>", "1/20", "Part I > Article 2 > Clause 1", "Article 2", 3, 4, True, ["x", "y"], "text </Documents> here")
TWO = ("e:0", "e", "", None, "", None, None, None, False, None, "other")


def answer_rows(spark, *rows):
    return spark.createDataFrame(list(rows), f"qid string, question string, answer string, context array<{CHUNK}>, history array<struct<role:string,content:string>>, language string")


def test_check_citations(spark):
    rows = answer_rows(spark, ("q", "?", "Yes [2][1, 5]. No [0] [1, clause 2]", [ONE, TWO], [], "vi"), ("r", "?", "Nothing.", [], None, "en"), ("s", "?", None, None, None, "en"))
    got = {r.qid: r for r in answers.check_citations(rows, language="language").collect()}
    assert [(c.n, c.chunk_id, c.label, c.amended) for c in got["q"].citations] == [(2, "e:0", "e", False), (1, "d:0", "1/20, Article 2 > Clause 1, trang 3–4", True)]
    assert got["q"].invalid == [5, 0] and got["q"].malformed == ["[1, clause 2]"]
    assert got["r"].citations == [] and got["r"].invalid == []


def test_messages(spark):
    rows = answer_rows(spark, ("q", "Why?", "A [1].", [ONE, TWO], [("user", "u [1]"), ("assistant", "said [1].")], "en"))
    c = {k: F.col(k) for k in ("question", "context", "history", "answer")}
    got = rows.select(answers.build_input(c["question"], c["context"], c["history"]).alias("m"), answers.format_input(c["question"], c["history"]).alias("i"), answers.format_case(c["question"], F.lit("ref"), c["context"], c["answer"], c["history"]).alias("j"), answers.format_passages(c["context"], 1).alias("p")).first()
    assert [(m.role, m.content) for m in got.m[:2]] == [("user", "u [1]"), ("assistant", "said.")]
    docs = '<documents>\n<document index="1" title="Law &lt;A&gt;" number="1/20" section="Part I &gt; Article 2 &gt; Clause 1" pages="3–4" amended_by="x, y">\ntext ‹/Documents> here\n</document>\n<document index="2">\nother\n</document>\n</documents>'
    assert got.m[2].role == "user" and got.m[2].content == f"{docs}\n\n<question>Why?</question>"
    assert got.i == "<history>\nuser: u [1]\nassistant: said [1].\n</history>\n<question>Why?</question>"
    assert got.j == f"<conversation_history>\nuser: u [1]\nassistant: said.\n</conversation_history>\n\n<question>Why?</question>\n\n<reference_answer>ref</reference_answer>\n\n{docs}\n\n<answer>A [1].</answer>"
    assert got.p.startswith("[1] Law <A> | Part I > Article 2 > Clause 1\ntext …\n\n[2]  | \nother")
    assert "Vietnamese" in answers.answer_instructions("plain-1", "vi")
    with pytest.raises(ValueError):
        answers.answer_instructions("none", "vi")


def test_labels(spark):
    frame = spark.createDataFrame([(1,)], "x int")
    one = lambda c: frame.select(c).first()[0]
    assert one(X.page_range(F.lit(3), F.lit(None).cast("int"))) == one(X.page_range(F.lit(3), F.lit(3))) == "3" and one(X.page_range(F.lit(None).cast("int"), F.lit(3))) is None
    assert one(X.section_label(F.lit("Chapter I > Section 2 > Article 4 > Clause 1"))) == "Article 4 > Clause 1"
    assert one(X.section_label(F.lit("Preamble"))) == "Preamble"
    assert one(X.citation_label(F.lit(""), F.lit(""), F.lit("d"), F.lit(""), F.lit(None).cast("string"))) == "d"
    assert one(X.embedding_text(F.lit("T"), F.lit("1"), F.lit("a > b"), F.lit("x"))) == "T (1) | a > b\nx"
    assert one(X.strip_markdown_inline(F.lit("> **Bold** and _thin_ snake_case<sup>1</sup> <b>x</b> 2 * 3 <br>\n# *h*"))) == "Bold and thin snake_case x 2 * 3 <br>\n# h"
    assert one(X.page_lines(F.lit("a  b\r\n\r\n ﬁx�"))) == ["a b", "fix"]
    assert one(X.clean_text(F.lit("é  x​ \n\n\t y "))) == "é x\ny"
    assert one(X.normalize_for_match(F.lit("ﬁ­  ½"))) == "fi 1⁄2"
    assert one(X.truncate_tokens(F.lit("a b c"), 2)) == "a b …" and one(X.truncate_tokens(F.lit("a b"), 2)) == "a b"
    assert one(X.is_abstention(F.lit(" **Not found in the documents.** But"))) and not one(X.is_abstention(F.lit("It was not found in the documents")))
    assert one(X.language_sample(F.array(*[F.lit(str(i)) for i in range(3)]))) == "0\n1\n2"
    assert one(X.point_id(F.lit("u"), F.lit("d"), F.lit("h"))) != one(X.point_id(F.lit("u"), F.lit("dh"), F.lit("")))


def test_plans_and_branches(spark):
    rows = spark.createDataFrame([("a", "x", "y"), ("b", "x", "x"), ("c", "x", " "), ("d", "x", None)], "qid string, s string, t string")
    got = retrieval.branches(rows.select("qid", answers.plan_queries(F.col("s"), F.col("t"), 0.5).alias("queries"))).orderBy("qid", "branch").collect()
    assert [(r.qid, r.branch, r.text, r.weight) for r in got if r.qid == "a"] == [("a", "dense-0", "x", 1.0), ("a", "dense-1", "y", 0.5), ("a", "sparse-0", "x", 1.0), ("a", "sparse-1", "y", 0.5)]
    assert len(got) == 10


def test_process_queries(spark):
    asked = [("a", "When?", [("user", "Who  ruled?"), ("assistant", "X")]), ("b", "Who?", [])]
    rows = spark.createDataFrame(asked, "qid string, question string, history array<struct<role:string,content:string>>")
    got = {r.qid: r for r in answers.process_queries(rows, rewrite="concat").collect()}
    assert (got["a"].standalone, got["a"].method) == ("Who ruled?\nWhen?", "concat") and (got["b"].standalone, got["b"].method) == ("Who?", "none")

    def model():
        return lambda prompt: json.dumps({"standalone": "When did X rule?", "translation": "Khi nào?"}) if "<history>" in prompt else json.dumps({"translation": "Ai?"})

    got = {r.qid: r for r in answers.process_queries(rows, model, "llm", True, 0.5).collect()}
    assert (got["a"].standalone, got["a"].method, got["a"].translation) == ("When did X rule?", "llm", "Khi nào?")
    assert (got["b"].standalone, got["b"].method) == ("Who?", "none") and [(q.text, q.weight) for q in got["b"].queries] == [("Who?", 1.0), ("Ai?", 0.5)]

    def late():
        def call(prompt):
            raise TimeoutError

        return call

    got = {r.qid: r for r in answers.process_queries(rows, late, "llm").collect()}
    assert (got["a"].standalone, got["a"].method, got["a"].error) == ("Who ruled?\nWhen?", "concat_fallback", "timeout") and got["b"].error is None


def test_rerank(spark):
    hits = [("q", f"h{i}", i, "t", "p", f"text {i}") for i in range(1, 6)] + [("one", "h", 1, "t", "p", "x"), ("bad", "a", 1, "t", "p", "x"), ("bad", "b", 2, "t", "p", "x")]
    frame = spark.createDataFrame(hits, "qid string, id string, rk int, title string, heading_path string, text string")
    questions = spark.createDataFrame([("q", "Which?"), ("one", "?"), ("bad", "fails")], "qid string, question string")

    def model():
        def call(prompt):
            if "fails" in prompt:
                raise providers.ProviderError(400, "no")
            assert "[3] t | p\ntext 3" in prompt and "text 4" not in prompt
            return '{"ranking": [3, 9, 3, 1, 4]}'

        return call

    got = answers.rerank(questions, frame, model, candidates=3).orderBy("qid", "new_rk").collect()
    assert [r.id for r in got if r.qid == "q"] == ["h3", "h1", "h2", "h4", "h5"]
    assert [(r.id, r.error) for r in got if r.qid == "bad"] == [("a", "no"), ("b", "no")] and [r.error for r in got if r.qid == "one"] == [None]


def test_generate_and_judge(spark):
    rows = answer_rows(spark, ("a", "Why?", None, [ONE], [], "en"), ("b", "None?", None, [], [], "vi")).drop("answer")

    def model():
        return lambda prompt: "Không tìm thấy trong tài liệu." if "Vietnamese" in json.loads(prompt)["instructions"] else "So [1][2]."

    got = {r.qid: r for r in answers.generate(rows, model).collect()}
    assert got["a"].status == "ok" and not got["a"].abstained and [c.n for c in got["a"].citations] == [1] and got["a"].invalid == [2]
    assert got["b"].abstained

    cases = rows.select("qid", "question", F.lit("ref").alias("reference_answer"), "context", F.lit("So [1].").alias("answer"), "history")

    def judges():
        calls = []

        def call(prompt):
            calls.append(prompt)
            if len(calls) == 2:
                return "no json"
            if len(calls) > 3:
                raise providers.ProviderError(429, "requests per day")
            return json.dumps({"claims": [{"claim": "c", "cited": ["1"], "supported": True, "supporting_cited": ["1"]}], "correctness": "correct", "relevancy": "relevant"})

        return call

    got = {r.qid: r.runs for r in answers.judge(cases, judges, 2).collect()}
    assert [(r.run, r.faithfulness, r.correctness, r.error) for r in got["a"]] == [(1, 1.0, "correct", None), (2, None, None, "unreadable answer")]
    assert [r.error for r in got["b"]] == [None, "quota"]
    judged = spark.createDataFrame([(k, [tuple(r) for r in v]) for k, v in got.items()], answers.judge(cases, judges, 2).schema)
    marks = judged.select("qid", summaries.judge_label(F.col("runs")).alias("l"), summaries.needs_judge(F.lit("ok"), F.col("runs")).alias("n"), summaries.consistent(F.col("runs")).alias("c")).collect()
    assert {(r.qid, r.l, r.n, r.c) for r in marks} == {("a", "correct", False, True), ("b", "correct", False, True)}
    assert summaries.consistency(judged).first().same_label == 1.0


def test_rotating_order(spark):
    got = answers.rotating_order(spark.createDataFrame([(i,) for i in range(3)], "i int"), ["a", "b"], ["i"]).orderBy("i", "turn").collect()
    assert [(r.i, r.variant) for r in got] == [(0, "a"), (0, "b"), (1, "b"), (1, "a"), (2, "a"), (2, "b")]


def test_reports(spark):
    rows = spark.createDataFrame(
        [("m", "t1", 1.0, 0.5, 10.0, 0.1, None, "e", "llm"), ("m", "t2", 0.0, 0.0, 20.0, 0.3, "x", None, "concat_fallback"), ("m", "t2", None, None, 30.0, 0.2, None, None, None)],
        "mode string, type string, hit double, mrr double, total double, cost_usd double, query_error string, rerank_error string, rewrite_method string",
    )
    means, times, costs = summaries.retrieval_summary(rows, ["hit", "mrr"], ["type"], ["total"])
    assert {(r.dimension, r.value, r.n, r.hit) for r in means.collect()} == {("all", "all", 2, 0.5), ("type", "t1", 1, 1.0), ("type", "t2", 1, 0.0)}
    assert [tuple(r) for r in times.collect()] == [("m", "total", 20.0, 29.0, 20.0, 30.0)]
    assert [tuple(r) for r in costs.collect()] == [("m", 0.2, 0.6, 1, 1, 1)]

    human = spark.createDataFrame([("a", True, None, "correct", "relevant"), ("b", False, True, "wrong", "relevant"), ("c", None, None, None, None)], "id string, faithful boolean, citations_ok boolean, correctness string, relevancy string")
    judged = spark.createDataFrame([("a", 1.0, 0.5, "correct", "partly"), ("b", 0.5, 1.0, "partly", "relevant"), ("d", 1.0, 1.0, "correct", "relevant")], "id string, faithfulness double, citation_precision double, correctness string, relevancy string")
    got = {r.metric: (r.n, r.agreement) for r in summaries.agreement(human, judged).collect()}
    assert got == {"faithful": (2, 1.0), "citations_ok": (1, 1.0), "correctness": (2, 0.5), "correctness_binary": (2, 1.0), "relevancy": (2, 0.5), "relevancy_binary": (2, 0.5)}
    assert [r.id for r in summaries.missing(judged, human).collect()] == ["d"] and [r.id for r in summaries.resume(human, judged).collect()] == ["c"]

    items = spark.createDataFrame([("q", "k", "vi", ["t", "u"], ["s"], True), ("r", "k", "en", [], [], None)], "qid string, type string, language string, tags array<string>, gold_sources array<string>, reviewed boolean")
    cross = spark.createDataFrame([("q", True)], "qid string, cross_lingual boolean")
    got = {(r.what, r.value): r.n for r in summaries.validation_report(items, cross).collect()}
    assert got == {("total", "all"): 2, ("type", "k"): 2, ("language", "vi"): 1, ("language", "en"): 1, ("tag", "t"): 1, ("tag", "u"): 1, ("answerable", "yes"): 1, ("reviewed", "yes"): 1, ("cross_lingual", "yes"): 1}

    history = spark.createDataFrame([(["h"],), ([],), (None,)], "history array<string>")
    estimate = summaries.estimate_cost(history, {"answer": (1.0, 2.0), "rewrite": (1.0, 1.0), "embedding": (1.0, 0.0), "judge": (1.0, 1.0)}, judge_calls=2)
    assert math.isclose(estimate.first().total, 3 * (4000 + 60) / 1e6 + 500 / 1e6 + 2 * 8000 / 1e6)
    assert summaries.check_estimate(estimate) == summaries.MOST_COST
    with pytest.raises(ValueError):
        summaries.check_estimate(estimate, 0.001)
    with pytest.raises(ValueError):
        summaries.check_identity({"model": "a"}, {"model": "b"})
    with pytest.raises(KeyError):
        summaries.choose_ids(items, "qid", ["q", "none"])
    assert summaries.choose_ids(items, "qid", ["q"]).count() == 1


def test_interleaved_sample(spark):
    rows = [(f"x{i}", "x", i < 2) for i in range(8)] + [(f"y{i}", "y", True) for i in range(4)]
    got = summaries.interleaved_sample(spark.createDataFrame(rows, "id string, type string, good boolean"), "type", "good", 9).collect()
    x, y = [r for r in got if r.type == "x"], [r for r in got if r.type == "y"]
    assert len(x) == 6 and len(y) == 3 and sum(r.good for r in x) == 2  # bad, good, bad, good, bad, bad


def test_covered_sources(spark):
    sources = spark.createDataFrame([("d", 2, "a  b"), ("d", 9, "a b"), ("e", None, "z")], "doc_id string, page int, quote string")
    chunks = spark.createDataFrame([("d", 1, 3, "x a b y"), ("e", None, None, "z")], "doc_id string, page int, page_end int, text string")
    assert {(r.doc_id, r.page) for r in summaries.covered_sources(sources, chunks).collect()} == {("d", 2), ("e", None)}


def test_tenants(spark):
    docs = spark.createDataFrame([("a", 1, "red fish"), ("a", 2, "blue"), ("b", 3, "red red"), ("b", 4, "red"), ("b", 5, "red")], "user string, doc_id long, text string")
    queries = spark.createDataFrame([("a", 10, "red"), ("b", 11, "red"), ("c", 12, "red")], "user string, item_id long, text string")
    got = {(r.qid, r.id): r.score for r in retrieval.bm25_scores(docs, queries, tenant="user").collect()}
    assert set(got) == {(10, 1), (11, 3), (11, 4), (11, 5)}
    alone = {(r.qid, r.id): r.score for r in retrieval.bm25_scores(docs.where("user = 'a'"), queries.where("user = 'a'")).collect()}
    assert math.isclose(got[10, 1], alone[10, 1])
    vectors = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 1.0]), ("b", 3, [1.0, 0.0]), (None, 4, [1.0, 0.0])], "user string, vec_id long, embedding array<double>")
    found = retrieval.dense_scores(vectors, vectors.where("vec_id < 4"), 5, tenant="user").collect()
    assert {(r.qid, r.id) for r in found} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}
    hits = spark.createDataFrame([(10, 1, 1), (10, 3, 2), (11, 3, 1)], "qid long, id long, rk int")
    assert {(r.qid, r.id) for r in retrieval.in_tenant(hits, docs, queries, "user", "doc_id", "item_id").collect()} == {(10, 1), (11, 3)}


def test_fused_branches(spark):
    scored = spark.createDataFrame([(1, "d", i, 1.0 / i) for i in (1, 2, 3)] + [(1, "s", i, float(i)) for i in (2, 3, 4)] + [(1, "z", 9, 1.0)], "qid int, branch string, id int, score double")
    weights = spark.createDataFrame([(1, "d", 2.0), (1, "s", 1.0), (1, "z", 0.0)], "qid int, branch string, weight double")
    got = {r.id: r.score for r in retrieval.fuse_branches(scored, weights).collect()}
    pairs = [(scored.where("branch = 'd'").select("qid", "id", "score"), 2.0), (scored.where("branch = 's'").select("qid", "id", "score"), 1.0)]
    assert got == {r.id: r.score for r in retrieval.fuse(pairs).collect()}
