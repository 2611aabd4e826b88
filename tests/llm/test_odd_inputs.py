"""Very long texts, nulls everywhere, clashing names and empty tables, through every operator and every stage."""

import random
import zlib

import pytest

import corpus_pipeline
from lodestream.llm import chat, decontaminate, jaccard_join, language_id, line_dedup, packing, pfor, quality_classifier, quality_rules, toxicity

#: Names that operators use for columns of their own.
CLASHING = "uid grp local row lines kept th at open id key node print n keys text_hash _key _wordless piece start length sequence_id offset score held_out".split()


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(5000)]
    return "\n".join(" ".join(rng.choices(words, k=60)) for _ in range(7000))  # about 2.7 MB


@pytest.fixture(scope="module")
def docs(spark, long_text):
    words = long_text.split()
    texts = [long_text, "x" * 200_000, None, "", " \n\t\n ", " ".join(words[:300]), " ".join(words[:300]), None]
    rows = [(i if i < 7 else None, t, None, None, None, *[i] * len(CLASHING)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` long" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1), (5, 1, 0), (None, None, None), (6, None, 1)], "doc_id long, quality int, toxic int")


def test_operators(spark, docs, labels, long_text):
    bench = spark.createDataFrame([(1, " ".join(long_text.split()[-40:-25])), (None, None), (2, "")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert found[0].n_words == len(long_text.split()) and sum(s.end - s.start for s in found[0].spans) == 15 and not found[5].spans
    pieces = packing.pack_documents(docs).collect()
    assert {r.doc_id for r in pieces} == {0, 1, 2, 3, 4, 5, 6, None} and max(r.piece for r in pieces if r.doc_id == 0) > 300
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r for r in kept.collect()}
    assert texts[2].text is None and texts[4].text == " \n\t\n " and len(texts[0].text) <= len(long_text) and texts[0]["uid"] == 0 and texts[6].text == ""
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert rules[0].n_words == len(long_text.split()) and rules[1].base_failed and len(rules) == 8
    for op in (quality_classifier.classify, toxicity.classify):
        assert len(op(docs, labels).collect()) == 8
    good = quality_classifier.keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() <= 8
    langs = language_id.identify(docs).collect()
    assert {r.lang_pred for r in langs} == {"und"} and len(langs) == 8
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs).collect()}
    assert groups[6] == groups[5] == (298, 5) and groups[1] == (1, 1) and groups[3] == (0, 3)
    one = jaccard_join.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5]
    read = {r.doc_id: r for r in pfor.read_segments(pfor.write_segments(docs)).collect()}
    assert len(read) == 8 and read[3].n_tokens == 1 and read[0].ids_crc32 != zlib.crc32(b"")


def test_long_conversation(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(20_000)]
    turns += [(2, i, r, t) for _, i, r, t in turns[:9_999]] + [(3, 0, None, None)]
    got = {r.conv_id: r for r in chat.chat_format(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 3} and got[1].n_turns == 20_000 and got[1].rendered.count("<|im_start|>") == 20_000


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == docs.columns, name
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {0, 1, 2, 3, 4, 5, 6, None}, name
        assert name == "quality" or out.count() > 0, name


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    """A block limit of one byte gives the same results, for documents that are dropped as well."""
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k{i} l m n") for i in range(20)] + [(None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"b c d e f g h i j k{i}") for i in range(0, 20, 3)] + [(99, None)], "item_id long, text string")
    whole = sorted(map(repr, decontaminate.contamination(docs, bench).collect()))
    kept = sorted(map(repr, decontaminate.drop_contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    assert sorted(map(repr, decontaminate.contamination(docs, bench).collect())) == whole
    assert sorted(map(repr, decontaminate.drop_contaminated(docs, bench).collect())) == kept and len(kept) == 14
