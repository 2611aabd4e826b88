"""The fitted operators against plain versions of their formulas."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import language_id, linear, quality_classifier, quality_rules, toxicity


def prose(rng, words, n):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def sample():
    """Texts of two vocabularies that overlap, and their classes."""
    rng = random.Random(3)
    common, good, bad = ([f"{k}{i}" for i in range(n)] for k, n in (("c", 60), ("g", 25), ("b", 25)))
    texts, y = [], []
    for i in range(120):
        y.append(i % 3 != 0)
        texts.append(prose(rng, common * 2 + (good if y[-1] else bad), rng.randint(5, 40)))
    texts += [None, "", "  "]
    return texts, np.array(y, np.int64)


def test_log_likelihood_ratio(spark, sample):
    """Ratio, threshold and verdict from counts of every 4-byte window of every text."""
    texts, y = sample
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)] + [(5, 1)], "doc_id long, quality int")
    bits = quality_rules.BUCKETS.bit_length() - 1

    def buckets(text):
        data = (text or "").encode()
        return [(int.from_bytes(data[i : i + 4], "little") * 2654435761 % 2**32) >> (32 - bits) for i in range(len(data) - 3)]

    trusted = {i for i, k in enumerate(y) if k}
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i, t in enumerate(texts):
        for b in buckets(t):
            raw[b] += 1
            target[b] += i in trusted
    smooth = quality_rules.SMOOTHING
    table = np.log((target + smooth) / (target.sum() + smooth * len(target))) - np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))
    score = [float(np.mean(table[buckets(t)])) if buckets(t) else 0.0 for t in texts]
    cut = float(np.quantile([score[i] for i in trusted | {5}], quality_rules.QUANTILE)) - quality_rules.MARGIN
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(score):
        assert math.isclose(got[i].score, s, abs_tol=1e-4)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= cut - 1e-9) or abs(s - cut) < 1e-4


@pytest.mark.parametrize("small", [quality_rules.SMALL, 0])
def test_all_trusted_documents_count(spark, monkeypatch, small):
    """More trusted documents than were once sampled: all are counted, broadcast or not."""
    monkeypatch.setattr(quality_rules, "SMALL", small)
    n = 12_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("aaaaaaa"), F.hex(F.xxhash64("id"))).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    # both sides have the same counts, so no text differs
    got = quality_rules.quality_rules(docs, labels)
    assert got.count() == n and got.where("abs(score) > 1e-9").count() == 0


@pytest.mark.parametrize("values", [[0.5], [0.25] * 999 + [-1.0], [i % 977 / 7 for i in range(5000)]])
@pytest.mark.parametrize("share", [0.0, 0.002, 0.37, 1.0])
def test_quantile(spark, values, share):
    scores = spark.createDataFrame([(float(x),) for x in values], "score double").repartition(3)
    assert quality_rules.quantile(scores, share) == float(np.quantile(values, share))


def objective(w, constant, x, sign, cost):
    return 0.5 * (w @ w + constant * constant) + float(np.sum(cost * np.maximum(0, 1 - sign * (x @ w + constant))))


def test_dual_coordinate_descent(sample):
    """Class ratios from plain counts; the hinge-loss objective against subgradient steps without end."""
    texts, y = sample
    hashes = linear.word_hashes()
    rows = [quality_classifier.features(t.encode(), hashes) for t in texts[: len(y)]]
    weights, constant, a, b = quality_classifier.fit(rows, y)
    learn = [i for i in range(len(y)) if i % 5 != 4]
    counts = np.ones((2, quality_classifier.BUCKETS))
    for i in learn:
        counts[y[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    used = np.unique(np.concatenate(rows))
    at = {int(k): j for j, k in enumerate(used)}
    x = np.zeros((len(y), len(used)))
    for i, r in enumerate(rows):
        x[i, [at[int(k)] for k in r]] = ratio[r] / len(r) ** 0.5
    sign = 2.0 * y[learn] - 1
    more = max(1.0, (sign > 0).sum() / (sign < 0).sum())
    cost = np.where(sign > 0, quality_classifier.COST, quality_classifier.COST * more)
    w = np.divide(weights[used], ratio[used], out=np.zeros(len(used)), where=ratio[used] != 0)
    found = objective(w, constant, x[learn], sign, cost)
    best, v, c = math.inf, np.zeros(len(used)), 0.0
    for step in range(1, 4001):
        wrong = cost * sign * (sign * (x[learn] @ v + c) < 1)
        v, c = v - (v - x[learn].T @ wrong) / step, c - (c - wrong.sum()) / step
        best = min(best, objective(v, c, x[learn], sign, cost))
    assert found <= 1.03 * best
    # scores of texts, from the weights alone
    model = type("Sent", (), {"value": (weights, constant, a, b)})
    score = quality_classifier.scorer(model)()
    for text, got in zip(texts, score([None if t is None else t.encode() for t in texts]), strict=True):
        f = quality_classifier.features((text or "").encode(), hashes)
        margin = sum(float(weights[k]) for k in f) / max(1, len(f)) ** 0.5 + constant
        assert math.isclose(got, 1 / (1 + math.exp(-(a * margin + b))), abs_tol=1e-6)


def test_ftrl_updates(sample):
    """Every coordinate's z, n and weight by the textbook update, in dictionaries."""
    texts, y = sample
    hashes = linear.word_hashes()
    rows = [toxicity.features(t.encode(), hashes) for t in texts[: len(y)]]
    there, weights, constant, _, _ = toxicity.fit(rows, y)
    z, n = {}, {}
    rng = np.random.default_rng(11)

    def weight(k, l1, l2):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(zk) <= l1 else -(zk - math.copysign(l1, zk)) / ((toxicity.BETA + math.sqrt(nk)) / toxicity.ALPHA + l2)

    for _ in range(toxicity.EPOCHS):
        for i in rng.permutation(len(y)):
            w = {int(k): weight(int(k), toxicity.L1, toxicity.L2) for k in rows[i]} | {"constant": weight("constant", 0.0, 0.0)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for k, value in w.items():
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA
                z[k] = z.get(k, 0.0) + g - sigma * value
                n[k] = n.get(k, 0.0) + g * g
    expected = {k: v for k in z if k != "constant" and (v := weight(k, toxicity.L1, toxicity.L2))}
    assert set(there.tolist()) == set(expected) and 0 < len(expected) < len(z) - 1
    assert all(math.isclose(v, expected[k], abs_tol=1e-9) for k, v in zip(there.tolist(), weights.tolist(), strict=True))
    assert math.isclose(constant, weight("constant", 0.0, 0.0), abs_tol=1e-9)


def test_language_scores(spark):
    """Log frequencies from plain counts, and backoff of unseen words, on a table that is learned from whole."""
    rng = random.Random(2)
    kinds = {"xx": "abcdefé", "yy": "defghiß"}
    rows = []
    for i in range(60):
        lang = "xx" if i % 2 else "yy"
        rows.append((i, " ".join("".join(rng.choices(kinds[lang], k=rng.randint(1, 7))) for _ in range(20)) + " 12 _A1", lang if i % 5 else None))
    rows += [(100, None, "xx"), (101, "12 .. ", "yy"), (102, "ZZZZ qqqq", "xx"), (103, "abćd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    taught = [(t, k) for i, t, k in rows if k and t is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    grams = lambda w, n: [w] if n == 0 else list(w) if n == 1 else [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    counts = [{} for _ in range(6)]
    for t, k in taught:
        for w in words(t):
            for n in range(6):
                for g in grams(w, n):
                    counts[n].setdefault(g, {"xx": 0.1, "yy": 0.1})[k] += 1
    totals = [{k: sum(c[k] for c in table.values()) for k in kinds} for table in counts]

    def evidence(w, k):
        for n in (0, 5, 4, 3, 2, 1):
            known = [math.log(counts[n][g][k] / totals[n][k]) for g in grams(w, n) if g in counts[n]]
            if known:
                return sum(known) / len(known)
        return 0.0

    for r in language_id.identify(docs).collect():
        w = words(next(t for i, t, _ in rows if i == r.doc_id))
        if not w:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = {k: sum(evidence(x, k) for x in w) for k in kinds}
        best = max(kinds, key=lambda k: (total[k], k == "xx"))
        assert r.lang_pred == best
        assert math.isclose(r.score, 1 / sum(math.exp(total[k] - total[best]) for k in kinds), abs_tol=1e-3)


def test_toxic_rows_found_and_others_left_alone(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hits = [r.toxic for r in found if r.predicted]
    assert sum(hits) >= 0.68 * sum(r.toxic for r in found) and sum(hits) >= 0.9 * len(hits)
