import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestream.operators import cleanup, gold, legal, providers
from lodestream.sources import config


def lines_of(spark, texts, doc="d", pages=None):
    rows = [(doc, i, t, pages[i] if pages else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, pos int, text string, page int")


def chunks(spark, texts, pages=None, language="en", **sizes):
    found = legal.chunk_legal(legal.legal_paragraphs(lines_of(spark, texts, pages=pages)), language, **sizes)
    return found.orderBy("chunk_index").collect()


def test_numerals_and_chain():
    assert [legal.numeral(x) for x in ("12", "IV", "XC", "thứ nhất")] == [12, 4, 90, None]
    keys = [(1, ""), (290, ""), (2, ""), (2, "a"), (1, ""), (4, ""), (9, "")]
    assert legal.article_chain(keys) == [0, 2, 3, 5]
    assert legal.article_chain([]) == [] and legal.article_chain([(5, "")]) == [0]


def test_chain_equals_brute_force():
    import random

    def slow(keys):
        best, before = [1] * len(keys), [-1] * len(keys)
        for j, b in enumerate(keys):
            options = [(best[i], i) for i, a in enumerate(keys[:j]) if a < b and b[0] - a[0] <= 3]
            if options:
                length, before[j] = max(options)
                best[j] = length + 1
        end = best.index(max(best)) if keys else -1
        out = []
        while end >= 0:
            out.append(end)
            end = before[end]
        return out[::-1]

    draw = random.Random(3)
    for _ in range(300):
        keys = [(draw.randint(1, 9), draw.choice(["", "", "a"])) for _ in range(draw.randint(0, 14))]
        assert legal.article_chain(keys) == slow(keys)


LAW = ["LAW ON MARKETS", "CHAPTER I", "GENERAL RULES", "Article 1. Scope", "This law rules markets.", "Article 290 of the treaty applies.", "CHAPTER II", "Article 2. Stalls", "“Article 3. Old text", "that was replaced.”", "Section 2 of this law applies.", "Article 3. End", "It ends."]


def test_structure(spark):
    found = chunks(spark, LAW)
    assert [(r.heading_path, r.article) for r in found] == [("Preamble", None), ("Chapter I > Article 1", "Article 1"), ("Chapter II > Article 2", "Article 2"), ("Chapter II > Article 3", "Article 3")]
    assert "GENERAL RULES" not in " ".join(r.text for r in found) and "Old text" in found[2].text and "Article 290" in found[1].text
    assert found[1].chunk_id == "d:0001" and len(found[1].content_hash) == 64


def test_vietnamese(spark):
    found = chunks(spark, ["Chương I", "QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", "Nội dung một.", "Mục 1. CHUNG", "Điều 2. Đối tượng", "Nội dung hai.", "Điều 2a. Thêm", "Nội dung."], language="vi")
    assert [r.heading_path for r in found] == ["Chương I > Điều 1", "Chương I > Mục 1 > Điều 2", "Chương I > Mục 1 > Điều 2a"]


def test_long_article_by_clauses_and_points(spark):
    body = ["1. " + "w " * 8, "2. " + "w " * 8, "3. Lead of three:", "a) " + "x " * 14, "b) " + "y " * 14]
    found = chunks(spark, ["Article 1. T", *(x.strip() + "." for x in body), "Article 2. U", "Article 3. V"], max_tokens=30, overlap=0)
    assert [r.heading_path for r in found[:3]] == ["Article 1 > Clause 1–2", "Article 1 > Clause 3 > Point a", "Article 1 > Clause 3 > Point b"]
    assert all(r.token_count <= 30 and r.text.startswith("Article 1. T") for r in found[:3]) and "Lead of three" in found[2].text


def test_long_article_by_length(spark):
    sentences = [f"s{i} a b c d." for i in range(12)]
    found = chunks(spark, ["Article 1. T", " ".join(sentences), "Article 2. U", "Article 3. V"], max_tokens=20, overlap=0)
    text = " ".join(r.text for r in found)
    assert all(text.count(s) == 1 for s in sentences) and all(r.token_count <= 20 for r in found)


def test_appendix_forms_open_on_new_pages(spark):
    texts = ["Article 1. A", "Article 2. B", "Article 3. C", "Appendix I", "List.", "Form No. 01", "Table.", "Form No. 02", "Body."]
    found = chunks(spark, texts, pages=[1, 1, 1, 2, 2, 2, 2, 3, 3])
    assert [(r.heading_path, r.article, r.page) for r in found[3:]] == [("Appendix I", None, 2), ("Appendix I > Form No. 02", None, 3)]


def test_route(spark):
    other = lines_of(spark, ["# A", "one two.", "Article 1. X", "Article 2. Y"], doc="e")
    found = legal.chunk_documents(lines_of(spark, LAW).unionByName(other), "en").collect()
    assert {r.doc_id: r.article is not None for r in found if r.chunk_index == 1 or r.doc_id == "e"} == {"d": True, "e": False}


def test_empty(spark):
    assert legal.chunk_documents(lines_of(spark, ["x"]).limit(0)).count() == 0


def test_furniture(spark):
    def strip(lines, running=()):
        frame = spark.createDataFrame([(lines, list(running))], "l array<string>, r array<string>")
        return frame.select(cleanup.strip_furniture(F.col("l"), F.col("r")).alias("x")).first().x

    assert strip(["old", "(Tiếp theo Công báo số 1 + 2)", "Page 3", "a", "b", "c", "d", "Page 3", "z"], ["Page #"]) == ["a", "b", "c", "d", "z"]
    assert strip(["Ký bởi: Cổng", "phủ", "Email: a@b", "Cơ quan: x", "short", "Email: real"]) == ["short", "Email: real"]
    assert strip(["phủ", "CÔNG BÁO/Số 1/Ngày 01-02-2020", "x" * 40, "(Xem tiếp Công báo số 4)"]) == ["phủ", "x" * 40]
    assert strip([]) == [] and strip(["1", "2", "3", "Page 9", "4", "5", "6"], ["Page #"])[3] == "Page 9"


def test_dehyphenate(spark):
    def join(texts):
        frame = cleanup.dehyphenate(lines_of(spark, texts))
        assert frame.columns == ["doc_id", "pos", "text", "page"]
        return [r.text for r in frame.orderBy("pos").collect()]

    assert join(["a par-", "ticular case", "particular"]) == ["a particular", "case", "particular"]
    assert join(["a fixed-", "term job", "fixed-term"]) == ["a fixed-term", "job", "fixed-term"]
    assert join(["x-", "Ray"]) == ["x-", "Ray"]
    assert join(["a-", "b"] + ["line"] * 300) == ["a-b", ""] + ["line"] * 300
    assert join(["par-", "ticu-", "lar"]) == ["particu", "-", "lar"]
    assert join([]) == []


PAGES = [("d", 1, "Điều 1. A\nfirst words of one"), ("d", 2, "goes on here\nĐiều 2. B\nsecond words of two"), ("d", 3, "first words of one")]


def test_gold(spark):
    pages = spark.createDataFrame(PAGES, "doc_id string, page int, text string")
    rows = [("q1", 0, "d", 2, "words of  two"), ("q2", 0, "d", 1, "second words"), ("q3", 0, "d", 2, "first words"), ("q4", 0, "d", 2, "no such"), ("q5", 0, "d", 2, "goes on")]
    sources = spark.createDataFrame(rows, "qid string, source int, doc_id string, page int, quote string")
    places = gold.quote_places(sources, pages)
    assert {r.qid: (r.outcome, r.found) for r in places.collect()} == {"q1": ("ok", [2]), "q2": ("other_page", [2]), "q3": ("many_pages", [1, 3]), "q4": ("nowhere", []), "q5": ("ok", [2])}
    fixed = gold.fix_pages(sources, places)
    assert {r.qid: r.page for r in fixed.collect()} == {"q1": 2, "q2": 2, "q3": 2, "q4": 2, "q5": 2} and fixed.columns == sources.columns
    assert {r.qid: r.article for r in gold.article_at(sources.where("qid IN ('q1', 'q5')"), pages).collect()} == {"q1": 2, "q5": 1}
    manifest = spark.createDataFrame([("d", "1/20", ["Điều 2"], [], "vi"), ("e", "2/21", [], ["1/20"], "en")], "doc_id string, number string, amended_articles array<string>, amends array<string>, language string")
    assert [r.qid for r in gold.amended_quotes(sources.where("qid IN ('q1', 'q5')"), pages, manifest).collect()] == ["q1"]
    citing = sources.where("qid = 'q1'").unionByName(spark.createDataFrame([("q1", 1, "e", 1, "x")], sources.schema))
    assert gold.amended_quotes(citing, pages, manifest).count() == 0
    items = spark.createDataFrame([("q1", "vi"), ("q2", "en")], "qid string, language string")
    assert {r.qid: r.cross_lingual for r in gold.cross_lingual(items, sources, manifest).collect()} == {"q1": False, "q2": True}
    marked = gold.mark_amended(spark.createDataFrame([("d", "Điều 2"), ("d", "Điều 1"), ("d", None)], "doc_id string, article string"), manifest)
    assert sorted((r.article or "", r.amended) for r in marked.collect()) == [("", False), ("Điều 1", False), ("Điều 2", True)]


def test_item_errors(spark):
    rows = [("unanswerable", ["a"], [], []), ("numeric", [], ["h"], []), ("multi_hop", ["a", "a"], [], ["t", "t"]), ("multi_turn", ["a"], ["h"], None)]
    frame = spark.createDataFrame(rows, "k string, s array<string>, h array<string>, t array<string>")
    found = [r.e for r in frame.select(gold.item_errors(*map(F.col, "ksht")).alias("e")).collect()]
    assert found == [["unanswerable_with_sources"], ["answerable_without_sources", "history_and_type_differ"], ["multi_hop_under_two_sources", "repeated_tags"], []]


def test_warnings(spark):
    rows = [("q", 2, "d", "Article 2", "Law", "1/20", True, ["2/21"]), ("q", 1, "d", "Article 2", "Law", "1/20", True, ["2/21"]), ("q", 3, "d", None, "Act", None, False, [])]
    found = gold.amendment_warnings(spark.createDataFrame(rows, "qid string, n int, doc_id string, article string, title string, number string, amended boolean, amended_by array<string>"))
    assert [r.warning for r in found.collect()] == ["Article 2 of the Law (1/20) has been amended by 2/21. Citation [1][2] shows the original text, which may be outdated."]


def test_settings(tmp_path):
    path = tmp_path / "a.toml"
    path.write_text('config_version = "1"\n[index]\nk = 5\n')
    assert config.read_settings(str(path), ["index.k=7", 'config_version="2"']) == {"config_version": "2", "index": {"k": 7}}
    with pytest.raises(ValueError):
        config.read_settings(str(path), ["index.k=7"])
    with pytest.raises(KeyError):
        config.read_settings(str(path), ["index.no=7"])


def test_gold_files(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"id": "a", "type": "numeric", "tags": ["x"]}\n{"id": \n')
    rows = config.read_gold(spark, str(path)).collect()
    assert [(r.id, r.tags, r.reviewed, r.error is not None) for r in rows] == [("a", ["x"], False, False), (None, [], False, True)]
    config.write_gold(config.read_gold(spark, str(path)).where("id = 'a'"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"id":"a","type":"numeric","tags":["x"],"reviewed":false}']


def test_providers(spark):
    def make():
        def answer(text):
            if text == "bad":
                raise providers.ProviderError(400, "no")
            if text == "day":
                raise providers.ProviderError(429, "requests per day")
            return text.upper()

        return answer

    rows = spark.createDataFrame(pd.DataFrame({"t": ["a", "bad", "b", "day", "c"]})).coalesce(1)
    assert [(r.answer, r.status) for r in providers.call(rows, "t", make).collect()] == [("A", "ok"), (None, "failed"), ("B", "ok"), (None, "quota"), (None, "quota")]
    said = spark.createDataFrame([("try again in 1m2.5s", None), ('"retryDelay": "7s"', None), ("x", "3"), ("x", None)], "m string, h string")
    assert [r.w for r in said.select(providers.advised_wait(F.col("m"), F.col("h")).alias("w")).collect()] == [62.5, 7.0, 3.0, None]
    judged = spark.createDataFrame([('{"claims": [{"claim": "c", "cited": [1, 2, 1], "supported": true, "supporting_cited": [2, 5]}]} ', )], "a string")
    (claim,) = judged.select(providers.claims(F.col("a")).alias("c")).first().c
    assert (claim.cited, claim.supported, claim.supporting_cited) == ([1, 2], True, [2])
    assert providers.first_object('ok: {"a": 1} more') == {"a": 1}
