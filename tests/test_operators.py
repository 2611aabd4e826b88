import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import chunking, index, ledger
from lodestream.sources import documents


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column("t").alias("x")).first().x


@pytest.mark.parametrize(
    "text, cited",
    [("a [2] b [1, 2]", [2, 1]), ("[1-3]", [1, 2, 3]), ("[1–3]", [1, 2, 3]), ("[1-2000]", [1, 2000]), ("[1, clause 2]", [1]), ("[...] [a]", []), ("[1-3-5]", [1, 5])],
)
def test_citations(spark, text, cited):
    assert one(spark, X.parse_citations, text) == cited


def test_text(spark):
    assert one(spark, X.clean_text, " a\t b\r\n\r\n c​ ") == "a b\nc"
    assert one(spark, X.expand_ligatures, "ﬁ ½") == "fi ½"
    assert one(spark, X.fix_replacement_chars, "a � b it�s �") == "a – b it’s "
    assert one(spark, X.bigrams, "Law 45/2019 now, go on 20.000.000") == ["law 45", "45 2019", "2019 now", "go on", "on 20.000.000"]
    assert one(spark, X.is_abstention, "**Not found in the  documents.** Sorry") is True
    assert one(spark, X.detect_language, "Điều này được quy định") == "vi"
    assert one(spark, X.section_label, "Part I > Article 3 > 1") == "Article 3 > 1"


def test_batches_and_packing():
    assert chunking.make_batches([1] * 5, 2, 10) == [[0, 1], [2, 3], [4]]
    assert chunking.make_batches([20, 1], 2, 10) == [[0], [1]]
    assert chunking.make_batches([], 2, 10) == []
    groups = chunking.pack_blocks([8] * 10, 40, 10)
    assert sorted({i for g in groups for i in g}) == list(range(10))
    assert all(sum([8] * len(g)) + len(g) - 1 <= 40 for g in groups)
    assert all(len(x.split()) <= 4 for x in chunking.split_text("one two three four five. six. seven eight", 4))


def test_generic_chunks(spark):
    rows = [("d", 0, "# A"), ("d", 1, "one two"), ("d", 2, "## B"), ("d", 3, "three four five")]
    found = chunking.chunk_generic(spark.createDataFrame(rows, "doc_id string, par int, text string"), max_tokens=8).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.heading_path, r.text) for r in found] == [("d:0000", "A", "A\none two"), ("d:0001", "A > B", "B\nthree four five")]


def test_readers(spark, tmp_path):
    assert documents.html_to_lines("<nav>x</nav><h2>T</h2><p>a\n b<br>c</p><table><tr><td>1</td><td>2</td></tr></table>") == ["## T", "a b", "c", "| 1 | 2 |"]
    assert documents.decode("é".encode("utf-16")) == "é" and documents.decode(b"\xef\xbb\xbfa") == "a"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>t</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.txt").write_text("x\n\ny")
    (tmp_path / "c.doc").write_bytes(b"?")
    rows = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].lines == ["## H", "t"] and rows["b.txt"].lines == ["x", "y"] and rows["c.doc"].error


def test_ledger_and_index(spark):
    rows = spark.createDataFrame([(1, "a", 6.0), (2, "a", 6.0), (3, "a", 4.0)], "i int, k string, x double")
    assert [r.admitted for r in ledger.admit(rows, "k", "i", "x", 10.0).orderBy("i").collect()] == [True, False, True]
    old = spark.createDataFrame([("d", "1"), ("d", "2"), ("e", "3")], "doc string, key string")
    live, stale = index.upsert(old, spark.createDataFrame([("d", "2"), ("d", "4")], "doc string, key string"), "doc", "key")
    assert sorted(tuple(r) for r in live.collect()) == [("d", "2"), ("d", "4"), ("e", "3")] and stale.collect()[0].key == "1"
    with pytest.raises(index.SignatureMismatch):
        index.check_signature({"a": 1}, {"a": 2})
    merged = index.merge_cache(old.withColumn("v", F.lit(1)), old.where("key = '1'").withColumn("v", F.lit(2)), ["doc", "key"])
    assert {r.key: r.v for r in merged.collect()} == {"1": 2, "2": 1, "3": 1}
