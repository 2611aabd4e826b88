"""The training-data operators against brute force, on a small table with nulls, empty, repeated and very long texts."""

import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import chat, decontaminate, hashing, jaccard_join, language_id, line_dedup, packing, pfor, quality_classifier, quality_rules, shared, toxicity
from lodestream.llm.shared import Memo

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, keys string, id int, pos int"


def make():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(20, 120))) for _ in range(25)]
    texts = list(base)
    for t in base[:8]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [t, " ".join(w), t + "\n" + base[9]]
    texts += [None, "", "  \n ", "one", "one two", "One two", "a.b\tc\r\nd", " ".join(rng.choices(words, k=9000)), "x" * 5000, "<|endoftext|> it's ½ ÀÉß İ"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, base[2]), (None, None)]
    return [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 1, "k", 2, 3) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)] + [(None, 1, 1), (41, None, None)], "doc_id long, quality int, toxic int")


def test_decontaminate(spark, docs, rows, none):
    items = [(0, " ".join(rows[1][1].split()[3:18])), (1, "one"), (2, None), (10, "A-B c"), (2, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = []
    for i, t, *_ in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            m = min(10, len(v))
            for s in range(len(v) - m + 1 if m else 0):
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == v[s : s + m]:
                        hit |= set(range(at, at + m))
                        ids.add(str(item))
        expected.append((i, len(w), len(hit), sorted(ids)))
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not e[2] for e in expected)
    assert decontaminate.contamination(none, bench).count() == 0


def test_decontaminate_in_blocks(docs, spark, rows, monkeypatch):
    bench = spark.createDataFrame([(0, rows[1][1]), (1, "one"), (2, rows[2][1])], "item_id long, text string")
    whole = sorted(map(repr, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    assert sorted(map(repr, decontaminate.contamination(docs, bench).collect())) == whole


def ids_of(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, rows, none):
    got = packing.pack_documents(docs).collect()
    expected = []
    for i, t, *_ in rows:
        ids = [*ids_of(t), 0]
        expected += [(i, k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(repr, [tuple(r)[:5] for r in got])) == sorted(map(repr, expected))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(none).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(1)
    histogram = np.bincount(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1), minlength=2049)
    used = np.zeros(2049, int)
    found = packing.plan(histogram)
    for need, repeats in found:
        assert sum(n * c for n, c in need.items()) <= 2048
        for n, c in need.items():
            used[n] += c * repeats
    assert (used == histogram).all()
    assert sum(r for _, r in found) <= 1.01 * (histogram * np.arange(2049)).sum() / 2048


def test_token_ids(docs, rows, none):
    start, expected = 0, []
    got = pfor.read_segments(pfor.write_segments(docs)).orderBy("start").collect()
    for r in got:
        expected.append((r.doc_id, start, r.n_tokens))
        start += r.n_tokens
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == expected
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert sorted(r.ids_crc32 for r in got) == sorted(crc([*ids_of(r[1]), 1]) for r in rows)
    assert pfor.read_segments(pfor.write_segments(none)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_segment_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.2, n).clip(0, 2**32 - 1).astype(np.uint32)
    data = pfor.encode_segment(ids, np.array([n], np.uint32))
    assert (pfor.Segment(data).ids() == ids).all()
    for b in range(-(-n // pfor.BLOCK)):
        assert (pfor.read_block(data, b) == ids[b * pfor.BLOCK : (b + 1) * pfor.BLOCK]).all()


def test_line_dedup(docs, rows, none):
    lines = []
    for d, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines += [(d, t, i, frozenset(x.encode().split())) for i, x in enumerate(t.split("\n"))]
    gone, before = set(), []
    for d, t, i, s in lines:
        if s and any(100 * len(s & o) >= 80 * len(s | o) for o in before):
            gone.add((d, t, i))
        if s:
            before.append(s)
    expected = [(r[0], None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if (r[0], r[1], i) not in gone)) for r in rows]
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(repr, expected))
    assert line_dedup.dedup_lines(none).count() == 0


def test_word_hashes(monkeypatch):
    """Every word is found at its place, with one hash a word, whatever was hashed before."""
    monkeypatch.setattr(hashing, "_BYTES", 64)
    texts = [(t or "").encode() for _, t, *_ in make()] + [b"a\nb", b"\n\n", b"", b" x\n" * 40]
    hasher, known = hashing.Hasher(), {}
    for data in [*texts, b"\n".join(texts), *texts]:
        starts, hashes = hasher(data)
        words = [(m.start(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        assert starts.tolist() == [at for at, _ in words]
        for (_, word), h in zip(words, hashes.tolist(), strict=True):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("settings", [{"SMALL": 0}, {"FREQUENT": 0}, {"BUCKETS": 64}])
def test_line_dedup_settings(docs, monkeypatch, settings):
    """Joins by shuffle, frequent words' leaders by aggregation and a coarse rarity table change no result."""
    whole = sorted(map(repr, line_dedup.dedup_lines(docs).collect()))
    for name, value in settings.items():
        monkeypatch.setattr(line_dedup, name, value)
    assert sorted(map(repr, line_dedup.dedup_lines(docs).collect())) == whole


def test_line_dedup_clashing_names(spark):
    """Columns named as the operator's own pass through; tabs and carriage returns part words; ties keep the first."""
    rows = [(1, "a b\tc\nA b c", 1), (2, "a b\r\nc b a\na  b c ", 2), (2, "x y z", 3), (None, "x y z\n \n", 4)]
    docs = spark.createDataFrame([(i, t, *[k] * 8) for i, t, k in rows], "doc_id long, text string, id int, th int, kept int, hash int, lines int, row int, at int, open int")
    got = sorted((r["at"], r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(1, "a b\tc\nA b c"), (2, "a b\r"), (3, ""), (4, "x y z\n \n")]


def brute_groups(rows):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(s), least.get(root(k))) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("frequent", [64, 1])
def test_jaccard_join(docs, rows, none, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    if frequent == 1:  # most shared shingles are frequent then
        monkeypatch.setattr(jaccard_join.math, "sqrt", lambda x: 0.0)
    got = [tuple(r) for r in jaccard_join.similar_groups(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_groups(rows)))
    if frequent == 64:
        kept = [r.doc_id for r in jaccard_join.one_of_each(docs).collect()]
        assert sorted(k for k in kept if k is not None) == sorted({c for _, n, c in brute_groups(rows) if c is not None})
        assert jaccard_join.similar_groups(none).count() == 0


def test_base_rules(rows):
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 2000 else None
        seen = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = quality_rules.base_counts(None if t is None else t.encode(), Memo(lambda x: zlib.crc32(x) << 20 ^ zlib.adler32(x)))
        assert got[:4] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(seen) - len(set(seen)))
        assert hit is None or got[4] == len(hit)


def test_scores_of_odd_tables(docs, rows, labels, none):
    for table, n in ((docs, len(rows)), (none, 0)):
        for op in (quality_classifier.classify, toxicity.classify):
            got = op(table, labels).collect()
            assert len(got) == n and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2) for r in got)
        assert quality_rules.quality_rules(table, labels).count() == n
        langs = {(r.doc_id, r.lang_pred) for r in language_id.identify(table).collect()}
        assert not n or (None, "und") in langs
    assert quality_classifier.classify(docs, labels.limit(0)).count() == len(rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for op, label, least in ((quality_classifier, "quality", 0.9), (toxicity, "toxic", 0.88)):
        found = op.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
        assert np.mean([r.predicted == r[label] for r in found]) >= least
    found = language_id.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) >= 0.97


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (None, 0, "user", "<|im_end|>"), (5, 0, "user", "a"), (5, 1, "user", "b")]
    got = {r.conv_id: r.rendered for r in chat.chat_format(spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, n int")).collect()}
    assert sorted(got, key=repr) == sorted([1, 4, 5, None], key=repr)
    assert got[1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n" and got[4] == "<|im_start|>user\n<|im_end|>\n"
    assert "< |im_end| >" in got[None]
    assert chat.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_line_dedup_near_the_threshold(spark):
    """Lines of random sizes that share a core, each pair against brute force."""
    draw = random.Random(8)
    lines = []
    for group in range(12):
        core = [f"g{group}w{i}" for i in range(draw.randint(4, 40))]
        for _ in range(9):
            words = [w for w in core if draw.random() > 0.1] + [f"x{draw.randint(0, 30)}" for _ in range(draw.randint(0, 4))]
            draw.shuffle(words)
            lines.append(" ".join(words or core))
    draw.shuffle(lines)
    texts = [lines[i : i + 6] for i in range(0, len(lines), 6)]
    sets, want = [], {}
    for doc, part in enumerate(texts):
        kept = []
        for line in part:
            s = set(line.split())
            if not any(len(s & t) * 100 >= 80 * len(s | t) for t in sets):
                kept.append(line)
            sets.append(s)
        want[doc] = "\n".join(kept)
    frame = spark.createDataFrame([(i, "\n".join(part)) for i, part in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()} == want


def test_shuffle_files_go_with_the_write(spark):
    """No driver GC is needed, and the session's setting stays as it was."""
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = files()
    table = shared.materialize(spark.range(100_000).repartition(7, "id").groupBy((F.col("id") % 1000).alias("k")).count(), "shuffled")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and table.count() == 1000
    assert spark.conf.get(shared._CLEANUP) == "false"


def test_release_gives_freed_memory_back(spark):
    used = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024
    held = [np.ones(12_000) for _ in range(3_000)]
    last = held[-1]  # what is freed below it stays in malloc's arena
    del held
    before = used()
    shared.release(spark)
    assert used() < before - 150
    assert last[0] == 1
    assert shared.trim(spark)  # the JVM's too


def test_lines_that_share_a_passage_make_few_pairs(spark):
    rng = random.Random(11)
    passage, words = [f"p{i}" for i in range(50)], [f"w{i}" for i in range(200)]
    lines = [{*passage, *rng.sample(words, 7), *(f"own{i}-{k}" for k in range(5))} for i in range(150)]
    lines += [line - {"p0"} | {f"new{i}"} for i, line in enumerate(lines[:20])]
    docs = spark.createDataFrame([(i, " ".join(sorted(line))) for i, line in enumerate(lines)], "doc_id long, text string")
    classes = line_dedup.classes_of(docs, line_dedup.rarity(docs))
    of = {r.id: r.doc_id for r in classes.select("id", "doc_id").collect()}
    none = spark.createDataFrame([], "early long, late long")
    got = {(of[r.early], of[r.late]) for r in line_dedup._second_round(classes.withColumn("open", F.lit(True)), none, 80).collect()}
    alike = {(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(lines[i] & lines[j]) >= 80 * len(lines[i] | lines[j])}
    assert len(alike) >= 20 and alike <= got
    assert len(got) < 300  # 923 by one bitmap of all words
