"""The stages of the corpus pipeline against brute force."""

import random

import corpus_pipeline


def groups(texts, words, percent):
    """The number of each text's group of near copies (null for texts without words)."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    group = [i if s else None for i, s in enumerate(sets)]
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    return group


def first_of_each(texts, words=5, percent=80):
    """Places of the texts that stay, given in order of their ids."""
    found, seen = groups(texts, words, percent), set()
    return [i for i, g in enumerate(found) if g is None or not (g in seen or seen.add(g))]


def near_copies():
    """Texts whose copies have one to twelve words changed, so that settings of 3 to 5 words and 0.8 to 0.9 differ."""
    rng = random.Random(7)
    texts = []
    for n in (12, 54, 104, 205, 610):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for changed in (1, 2, 4, 12):
            copy = list(base)
            for at in rng.sample(range(n), changed):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    return texts + [None, "", "one two", "One two"]


def test_near_duplicates_of_five_words(spark):
    texts = near_copies()
    assert first_of_each(texts) != first_of_each(texts, 3, 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == first_of_each(texts)


def test_one_row_of_each_group_whatever_its_id(spark):
    texts = near_copies()[:10]
    other, copy = texts[0], texts[5:7]
    given = [(1, copy[0]), (2, copy[1]), (2, other), (2, other), (3, "quite another text"), (3, "and one more"), (None, copy[1]), (None, "of no id"), (None, "of no id"), (None, "OF no id"), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    whole = [(i, t) for i, t in kept if (t or "").lower() != "of no id"]
    assert sorted(map(repr, whole)) == sorted(map(repr, [(1, copy[0]), (2, other), (3, "quite another text"), (3, "and one more"), (None, None), (4, ""), (4, "")]))
    assert len(kept) == len(whole) + 1


def test_lines_and_run(spark, monkeypatch, tmp_path):
    """``lines`` and, from there on, ``run()``."""
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(3000)}"
    texts = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(4)) for _ in range(30)]
    texts += [texts[3], texts[4] + "\nlast line of its own here", "", " \n ", "  "]
    item = " ".join(texts[6].split("\n")[0].split()[:11])
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame([(i, t, "en", "s", -1) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.load(spark, str(tmp_path), "documents")

    before, expected = [], {}
    for i, t in enumerate(texts):
        left = []
        for line in t.split("\n"):
            s = frozenset(line.split())
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in before):
                left.append(line)
            if s:
                before.append(s)
        if not t.split() or "\n".join(left).split():
            expected[i] = "\n".join(left)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert 30 not in got and 31 in got and 32 in got
    assert got == {i: (t, len(t)) for i, t in expected.items()}

    # run() with the fitted stage left out, so that every later stage is brute force's
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[1:])
    ids = list(expected)
    kept = [ids[k] for k in first_of_each([expected[i] for i in ids])]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i in kept if i != 6}


def test_quality(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} more of it " * 5, "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    quality_classifier = corpus_pipeline.quality_classifier
    score = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    kept = {r.doc_id for r in quality_classifier.keep_good(docs, labels).collect()}
    assert kept == {i for i, x in score.items() if x >= quality_classifier.CUT} and 0 < len(kept) < 40
