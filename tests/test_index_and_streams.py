"""Stored indexes, ledgers, files, page ingest and streams."""

import datetime
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestream.operators import index, ingest, ledger, retrieval
from lodestream.sources import config, documents
from lodestream.streaming import usage

CHUNKS = "doc_id string, title string, so_hieu string, heading_path string, text string, content_hash string"


def chunks_of(spark, doc, *texts):
    return spark.createDataFrame([(doc, "T", None, "", t, hashlib.sha256(t.encode()).hexdigest()) for t in texts], CHUNKS)


def test_index_document(spark):
    cache = spark.createDataFrame([], "signature string, hash string, vector array<double>")
    make = index.hashing_embedder(8)
    live, cache, report = index.index_document(None, chunks_of(spark, "d", "a", "b", "b"), cache, make, "u", "v1")
    assert tuple(report.first()) == (2, 2, 0) and cache.count() == 2
    live, cache, report = index.index_document(live, chunks_of(spark, "d", "b", "c"), cache, make, "u", "v1")
    assert tuple(report.first()) == (2, 1, 1) and {r.text for r in live.collect()} == {"b", "c"} and cache.count() == 3
    live, cache, report = index.index_document(live, chunks_of(spark, "e", "b"), cache, make, "u", "v2")
    assert tuple(report.first()) == (1, 1, 0) and live.count() == 3
    with pytest.raises(ValueError):
        index.index_document(live, chunks_of(spark, "d", "x").union(chunks_of(spark, "e", "x")), cache, make, "u", "v1")
    assert len({r.point_id for r in live.collect()}) == 3


def test_stored_index(spark, tmp_path):
    path = str(tmp_path / "i")
    index.create(spark, path, {"model": "m", "size": 8})
    index.create(spark, path, {"size": 8, "model": "m"})
    with pytest.raises(index.SignatureMismatch):
        index.create(spark, path, {"model": "n", "size": 8})
    rows = spark.createDataFrame([("u", "d", "x"), ("u", "e", "y"), ("w", "d", "z")], "user_id string, doc_id string, text string")
    rows.write.partitionBy("user_id").parquet(f"{path}/chunks")
    got = index.load_index(spark, path, {"model": "m", "size": 8}, ["text"], "u", "d")
    assert [r.text for r in got.collect()] == ["x"] and "PartitionFilters: [isnotnull(user_id" in got._jdf.queryExecution().toString()
    with pytest.raises(index.SignatureMismatch):
        index.load_index(spark, path, {"model": "n"}, ["text"])


def test_stored_postings(spark, tmp_path):
    docs = spark.createDataFrame([("u", i, t) for i, t in enumerate(["red fish", "blue red", "red", "x y z"])] + [("w", 9, "red")], "user_id string, doc_id long, text string")
    queries = spark.createDataFrame([("u", 1, "red blue"), ("w", 2, "red")], "user_id string, item_id long, text string")
    index.write_postings(docs, str(tmp_path), "doc_id", "text", buckets=4)
    posted, sizes = spark.read.parquet(f"{tmp_path}/postings"), spark.read.parquet(f"{tmp_path}/sizes")
    got = {(r.qid, r.id): round(r.score, 9) for r in retrieval.read_postings(posted, queries, sizes, buckets=4).collect()}
    assert got == {(r.qid, r.id): round(r.score, 9) for r in retrieval.bm25_scores(docs, queries, tenant="user_id").collect()}


def test_embedding(spark):
    texts = spark.createDataFrame([(i, f"word{i} a b") for i in range(150)], "i int, text string").repartition(2)
    got = index.embed(texts, index.hashing_embedder(16), most=7).collect()
    alone = index.hashing_embedder(16)()
    assert len(got) == 150 and all(r.vector == alone([r.text])[0] for r in got)
    assert index.embed_queries(spark.createDataFrame([("q",)], "text string"), index.hashing_embedder(4)).count() == 1
    with pytest.raises(Exception, match="a query is empty"):
        index.embed_queries(spark.createDataFrame([(" ",)], "text string"), index.hashing_embedder(4)).collect()
    v = index.sparse_vectors(spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "id int, term string, tf int"), ["id"], F.col("tf").cast("double")).first()
    place = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "little")
    assert list(zip(v.indices, v["values"])) == sorted([(place("a"), 1.0), (place("b"), 2.0)])


def test_ledger(spark, tmp_path):
    day = datetime.date(2026, 10, 7)
    at = lambda h: datetime.datetime(2026, 10, 7, h)
    spark.createDataFrame([(day, "m", 0.5)], "day date, model string, cost_usd double").write.parquet(f"{tmp_path}/l")
    ledger.settle(spark.createDataFrame([(day, at(6), "p", "m", 0.25, 10, 5), (datetime.date(2026, 10, 6), at(8), "p", "m", 1.0, 1, 1), (day, at(9), "p", "n", None, None, None)], "day date, ts timestamp, provider string, model string, cost_usd double, input_tokens long, output_tokens long"), f"{tmp_path}/l")
    rows = ledger.read_ledger(spark, f"{tmp_path}/l")
    assert {(r.provider, r.input_tokens) for r in rows.collect() if r.ts is None} == {("openai", 0)}
    assert tuple(ledger.spent(rows, "2026-10-07").first()) == (0.75, 1.75)
    assert {tuple(r) for r in ledger.usage_since(rows, F.lit("2026-10-07 07:00:00").cast("timestamp")).collect()} == {("p", "m", 1, 2), ("p", "n", 1, 0)}
    profiles = spark.createDataFrame([("p", "m", "America/Los_Angeles", 5, 20), ("p", "n", "UTC", 0, 7), ("q", "m", "UTC", 3, None)], "provider string, model string, zone string, calls_per_day long, tokens_per_day long")
    now = F.lit("2026-10-07 12:00:00").cast("timestamp")  # the Pacific day begins at 07:00 UTC
    got = {(r.provider, r.model): (r.calls, r.tokens, r.calls_left, r.tokens_left) for r in ledger.quota(rows, profiles, now).collect()}
    assert got == {("p", "m"): (1, 2, 4, 18), ("p", "n"): (1, 0, None, 7), ("q", "m"): (0, 0, 3, None)}
    fits = spark.createDataFrame([(1, 5, 6), (0, None, 1), (None, 5, 5), (None, None, 9)], "c long, t long, n long").select(ledger.fits_quota(F.col("c"), F.col("t"), F.col("n")).alias("f")).collect()
    assert [r.f for r in fits] == [False, False, True, True]


def test_usage(spark):
    texts = ['{"input_tokens": 9, "output_tokens": 4, "input_tokens_details": {"cached_tokens": 3, "cache_write_tokens": 2}, "output_tokens_details": {"reasoning_tokens": 1}}', '{"prompt_tokens": 5, "completion_tokens": 6, "prompt_tokens_details": {"cached_tokens": 1}, "completion_tokens_details": null}', None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(ledger.usage_of(F.col("t")).alias("u")).collect()
    assert [tuple(r.u) for r in got] == [(1, 9, 3, 2, 4, 1), (1, 5, 1, 0, 6, 0), (1, 0, 0, 0, 0, 0)]


def test_admission(spark):
    import random

    draw = random.Random(4)
    rows = [(i, draw.choice("ab"), float(draw.randint(1, 9)) if draw.random() > 0.1 else None) for i in range(400)]
    for total in (None, 700.0):
        spent, every, want = {}, 0.0, {}
        for i, k, x in rows:
            want[i] = spent.get(k, 0.0) + (x or 0) <= 500 and (total is None or every + (x or 0) <= total)
            if want[i]:
                spent[k] = spent.get(k, 0.0) + (x or 0)
                every += x or 0
        frame = spark.createDataFrame(rows, "i int, k string, x double").repartition(3)
        assert {r.i: r.admitted for r in ledger.admit(frame, "k", "i", "x", 500.0, total).collect()} == want and not all(want.values())


def test_sliding_usage(spark):
    import random

    draw = random.Random(6)
    events = [(i, draw.choice("ab"), datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=draw.randint(0, 9000)), float(i % 7)) for i in range(300)]
    frame = spark.createDataFrame(events, "i int, k string, ts timestamp, x double")
    want = {}
    for i, k, t, _ in events:
        near = [e[3] for e in events if e[1] == k and t - datetime.timedelta(seconds=60) < e[2] <= t]
        want[i] = (len(near), sum(near))
    assert {r.i: (r.calls, r.used) for r in ledger.sliding_usage(frame, "k", "ts", "x").collect()} == want


def test_budgeted():
    class Refused(Exception):
        status = 400

    def client(request):
        if request == "refused":
            raise Refused
        if request == "broken":
            raise OSError
        return request.upper(), 0.2

    paid = ledger.Budgeted(client, lambda r: 0.5, day_limit=1.5, limit=9.0)
    assert paid("a") == "A" and paid.settled == [0.2]
    for bad in ("refused", "broken"):
        with pytest.raises((Refused, OSError)):
            paid(bad)
    assert paid.settled == [0.2, 0.0, 0.5] and paid.pending == 0
    assert list(paid.stream("s", lambda r: iter([("x", None), ("y", 0.1)]))) == ["x", "y"] and paid.settled[-1] == 0.1
    assert list(paid.stream("s", lambda r: iter([("x", None)]))) == ["x"] and paid.settled[-1] == 0.5
    with pytest.raises(ledger.BudgetExceeded):
        paid("b")
    with pytest.raises(ledger.BudgetExceeded, match="in all"):
        ledger.Budgeted(client, lambda r: 0.5, 9.0, limit=0.6, total_spent=0.2)("a")


def test_gold_files(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "a", "question": "q?", "type": "numeric", "language": "en", "gold_sources": [{"doc_id": "d", "page": 2, "quote": "x"}], "tags": ["t"]}\n\n{bad\n', encoding="utf-8")
    items = config.read_gold(spark, str(tmp_path / "g.jsonl"))
    got = {r.line: r for r in items.collect()}
    assert got[1].id == "a" and got[1].error is None and got[1].reviewed is False and got[3].error == "line 3: {bad"
    good = items.where("error IS NULL")
    text = config.render_review(good).first().text
    assert "- [ ] Reviewed" in text and "- `d` p. 2: “x”" in text and text.startswith("## a · numeric · en · t")
    for edit, want in ((lambda t: t.replace("[ ]", "[x]"), (True, [])), (lambda t: t.replace("[ ]", "[x]") + "mend it\n", (False, [("a", "mend it")])), (lambda t: "", (False, []))):
        decisions = config.parse_review(spark.createDataFrame([("intro\n" + edit(text),)], "text string"))
        items2, mend = config.apply_review(good, decisions)
        assert (items2.first().reviewed, [tuple(r) for r in mend.collect()]) == want
    config.write_gold(items2, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0].endswith('"reviewed":false}')


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    digest = hashlib.sha256(b"%PDF-1").hexdigest()
    wanted = spark.createDataFrame([("a.pdf", "u:a", digest), ("b.pdf", "u:b", "00"), ("c.pdf", "u:c", None), ("d.pdf", "u:d", digest)], "filename string, url string, sha256 string")
    states = {r.filename: r.state for r in config.check_files(wanted, config.file_digests(spark, str(tmp_path / "*.pdf"))).collect()}
    assert states == {"a.pdf": "current", "b.pdf": "missing", "c.pdf": "missing", "d.pdf": "missing"}

    def opener():
        return {"u:a": b"%PDF-1", "u:b": b"%PDF-2", "u:d": b"<html>"}.__getitem__

    got = {r.filename: (r.content is not None, (r.error or "")[:6]) for r in config.fetch_files(wanted, opener).collect()}
    assert got == {"a.pdf": (True, ""), "b.pdf": (False, "sha256"), "c.pdf": (False, "'u:c'"), "d.pdf": (False, "no PDF")}
    path = config.write_result(wanted, str(tmp_path), "v1", "retrieval", "2026-01-02", 2, partial=True)
    assert path.endswith("/2026-01-02_v1_retrieval-2_partial.json") and spark.read.json(path).count() == 4
    with pytest.raises(ValueError):
        config.write_result(wanted, str(tmp_path), "v1", "retrieval", "2026-01-02", dirty=True)
    config.write_jsonl(wanted, str(tmp_path / "j"))
    assert config.read_jsonl(spark, str(tmp_path / "j"), "filename string").count() == 4


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="berschrift2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("0")}{cell("0")}</w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="berschrift2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    html = b"<html><head><title>T</title></head><body><header>Kept</header><nav>no</nav><p>x&nbsp;&nbsp; y</p><table><tr><td>1</td><td>2</td></tr></table><footer>f</footer></body></html>"
    law = "".join(f"Article {i}. T\nText {i} ﬁx.\n\n" for i in (1, 2, 3))
    for name, data in (("a.html", html), ("b.docx", docx()), ("c.txt", law.encode()), ("d.doc", b"x"), ("e", b"x"), ("f.docx", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.html"].lines == ["Kept", "x y", "| 1 | 2 |"] and got["b.docx"].lines == ["## Head", "| a | 0 | 0 |"]
    assert got["c.txt"].lines[:2] == ["Article 1. T", "Text 1 fix."] and got["c.txt"].structure == "legal" and got["a.html"].structure == "generic"
    assert ".docx" in got["d.doc"].error and got["e"].error and got["f.docx"].error and got["f.docx"].lines is None


def test_pages(spark, tmp_path):
    def open_pdf():
        def read(data):
            if data == b"bad":
                raise ValueError("broken file")
            return [(t, None, t == "") for t in data.decode().split("\x0c")]

        return read

    page = lambda n, *ls: "\n".join(["My Gazette", *ls, f"Page {n}"])
    first = "\x0c".join([page(1, "Article 1. Scope", "This law is a par-"), page(2, "ticular law.", "particular"), page(3, "x"), ""])
    second = "\x0c".join([page(9, "Article 2. Stalls", "Text."), page(10, "Article 3. End", "It ends.")])
    files = spark.createDataFrame([("d", "1.pdf", first.encode()), ("d", "2.pdf", second.encode()), ("e", "1.pdf", b"bad")], "doc_id string, file string, content binary")
    pages = documents.read_pdf_pages(files, open_pdf)
    assert [(r.doc_id, r.error) for r in pages.where("error IS NOT NULL").collect()] == [("e", "broken file")]
    pages = pages.where("error IS NULL")
    flagged = ingest.recognised_pages(pages)
    assert [(r.doc_id, r.file, r.page) for r in flagged.where("needs_ocr").collect()] == [("d", "1.pdf", 4)]
    read = ingest.recognised_pages(pages, lambda: lambda row: f"seen {row['file']} {row['page']}")
    assert read.where("needs_ocr").count() == 0
    lines = ingest.printed_lines(read)
    got = [(r.text, r.page) for r in lines.orderBy("pos").collect()]
    assert ("This law is a particular", 1) in got and ("law.", 2) in got and ("seen 1.pdf 4", 4) in got and ("Article 2. Stalls", 5) in got and ("It ends.", 6) in got
    assert not [t for t, p in got if p <= 3 and ("Gazette" in t or t.startswith("Page"))]
    manifest = spark.createDataFrame([("d", "Law", "1/20", "law", "in force", ["x"], ["Article 2"])], "doc_id string, title string, so_hieu string, kind string, status string, amended_by array<string>, amended_articles array<string>")
    chunks = ingest.chunked(lines, manifest)
    rows = {r.article: r for r in chunks.collect()}
    assert rows["Article 2"].page == 5 and rows["Article 2"].amended and not rows["Article 1"].amended and rows["Article 1"].title == "Law" and rows["Article 1"].language == "en"
    summary = ingest.ingest_summary(chunks, flagged).first()
    assert (summary.articles, summary.pages, summary.ocr_pages, summary.structure) == (3, 6, 1, "legal")
    ingest.write_chunks(chunks, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).where("doc_id = 'd'").count() == len(rows)

    marked = spark.createDataFrame([("g", "1.pdf", 1, "plain text", "# Head\n\n**Bold** text", False)], "doc_id string, file string, page int, text string, markdown string, has_images boolean")
    assert [r.text for r in ingest.document_lines(ingest.recognised_pages(marked)).orderBy("pos").collect()] == ["# Head", "Bold text"]


def run_stream(spark, tmp_path, name, schema, batches, build):
    """Rows that a query gives over files that arrive one by one."""
    source = tmp_path / name
    source.mkdir()
    out = []
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = stream.writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode("append").start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
    finally:
        query.stop()
    return out


def at(seconds):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=seconds)


def test_windowed_usage(spark, tmp_path):
    schema = "k string, ts timestamp, x double"
    batches = [[("a", at(10), 1.0), ("a", at(70), 2.0)], [("a", at(20), 4.0)], [("a", at(400), 1.0)], [("a", at(30), 8.0)], [("a", at(900), 1.0)]]
    got = run_stream(spark, tmp_path, "w", schema, batches, lambda s: usage.windowed_usage(s, "k", "ts", "x", "1 minute", "2 minutes"))
    found = {(r.start, r.calls, r.used) for r in got}
    assert (at(0), 2, 5.0) in found and (at(60), 1, 2.0) in found  # the late event at 20 counts, the one at 30 doesn't


def test_rate_admission(spark, tmp_path):
    schema = "k string, ts timestamp, x double"
    batches = [[("a", at(30), 6.0), ("a", at(0), 5.0), ("a", at(10), 5.0), ("b", at(5), 50.0)], [("a", at(61), 4.0), ("a", at(59), 1.0)], [("a", at(500), 9.0)]]
    got = run_stream(spark, tmp_path, "r", schema, batches, lambda s: usage.rate_admission(s, "k", "ts", "x", 10.0))
    judged = {(r.key, r.at // 1_000_000 - int(at(0).replace(tzinfo=datetime.UTC).timestamp())): r.admitted for r in got}
    assert judged == {("a", 0): True, ("a", 10): True, ("a", 30): False, ("b", 5): True, ("a", 59): False, ("a", 61): True, ("a", 500): True}


def test_settled_streams(spark, tmp_path):
    schema = "call_id string, kind string, ts timestamp, reserved double, cost double"
    batches = [
        [("a", "delta", at(0), 0.5, None), ("b", "delta", at(1), 0.7, None)],
        [("a", "end", at(5), None, 0.2), ("c", "end", at(5), 0.9, None)],
        [("d", "delta", at(1000), 0.1, None)],
        [("d", "delta", at(1001), 0.1, None)],
    ]
    got = run_stream(spark, tmp_path, "s", schema, batches, usage.settle_streams)
    assert sorted(tuple(r) for r in got) == [("a", 0.2, True), ("b", 0.7, False), ("c", 0.9, True)]


def test_replaced_documents(spark, tmp_path):
    write = usage.replace_documents(str(tmp_path / "ix"), "doc", 4)
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "doc string, n int")
    write(first, 0)
    write(spark.createDataFrame([("a", 9)], "doc string, n int"), 1)
    write(spark.createDataFrame([("a", 9)], "doc string, n int"), 1)  # run again
    write(first.limit(0), 2)
    assert {(r.doc, r.n) for r in spark.read.parquet(str(tmp_path / "ix")).collect()} == {("a", 9), ("b", 3)}
