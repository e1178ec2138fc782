"""Non-negative positive-unlabelled learning: held-out accuracy, the risk by hand, defined cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.llm import toxicity as T

DOCS = "doc_id long, text string"
LABELS = "doc_id long, toxic int"


def rows_of(n=2400, seed=1):
    rnd = random.Random(seed)
    clean = ["".join(rnd.choice("abcdefghi") for _ in range(rnd.randrange(3, 8))) for _ in range(400)]
    bad = ["vilezor", "grubmuck", "skulltrok"]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randrange(10, 80))]
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", "s", "ish", "ly"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = rows_of()
    some = labels[: len(labels) // 2]
    extra = [(90_001, None), (90_002, ""), (90_003, "vilezor " * 300_000), (3, "again 3"), (None, "no id")]
    frame = spark.createDataFrame([(*r, 1, 0.5) for r in rows + extra], DOCS + ", toxic int, score double")
    model = T.learn(frame, spark.createDataFrame([*some, (None, 1), (5, None), (77_777, 1)], LABELS))
    out = {r.id: r.score for r in T.score_documents(frame, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 300
    assert np.mean([out[i] >= 0.5 for i, y in held if y]) > 0.9
    assert np.mean([out[i] < 0.5 for i, y in held if not y]) > 0.97
    assert out[90_001] == out[90_002] < 0.5 and out[90_003] > 0.5
    assert all(0 <= s <= 1 for s in out.values()) and T.score_documents(frame, model).count() == len(rows) + len(extra)


def test_held_out_labels_teach_nothing(spark):
    rows, labels = rows_of(900)
    frame = spark.createDataFrame(rows, DOCS)
    right = spark.createDataFrame(labels, LABELS)
    wrong = right.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.learn(frame, right), T.learn(frame, wrong)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.bias, b.bias)


def test_samples_are_bounded_by_texts(spark, monkeypatch):
    """Many rows with one id and copies of one text can't swell what is learned from."""
    monkeypatch.setattr(T, "TOXIC_DOCS", 50)
    monkeypatch.setattr(T, "ANY_DOCS", 100)
    seen = []
    monkeypatch.setattr(T, "train", lambda toxic, unlabelled, prior: seen.append((len(toxic), len(unlabelled), prior)))
    rows = [(1, f"text {i}") for i in range(3000)] + [(2, "same") for _ in range(3000)]
    T.learn(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], LABELS), prior=0.3)
    assert seen[0][1] <= 200 and seen[0][2] == 0.3


def test_without_toxic_examples(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    model = T.learn(frame, spark.createDataFrame([(1, 0)], LABELS))
    assert [r.score for r in T.score_documents(frame, model).collect()] == [0.0, 0.0]
    assert T.score_documents(frame.limit(0), model).count() == 0


def _risk(g_toxic, g_any, prior):
    def loss(z):
        return math.log1p(math.exp(-z))

    mean = lambda xs: sum(xs) / len(xs)
    clean = mean([loss(-g) for g in g_any]) - prior * mean([loss(-g) for g in g_toxic])
    return prior * mean([loss(g) for g in g_toxic]), clean


@pytest.mark.parametrize("shift", [4.0, -6.0])
def test_risk_step_is_the_derivative(shift):
    """By differences; below zero the step goes against the clean part alone."""
    rng = np.random.default_rng(2)
    g_toxic, g_any, prior, h = rng.normal(3, 1, 5), rng.normal(0, 1, 7) + shift, 0.4, 1e-6
    clean = _risk(g_toxic, g_any, prior)[1]
    assert (clean < 0) == (shift < 0)

    def value(a, b):
        toxic, rest = _risk(a, b, prior)
        return toxic + rest if clean >= 0 else -rest

    for got, which in zip(T.risk_step(g_toxic, g_any, prior), (0, 1), strict=True):
        for i in range(len(got)):
            up, down = [g_toxic.copy(), g_any.copy()], [g_toxic.copy(), g_any.copy()]
            up[which][i] += h
            down[which][i] -= h
            assert abs(got[i] - (value(*up) - value(*down)) / (2 * h)) < 1e-5


def test_scores_by_hand():
    """Features, sums and sigmoids in plain Python."""
    model = T.train([T.features([b"foul odd"])[1]] * 12, [T.features([t])[1] for t in (b"fine", b"good odd", b"foul") * 9], 0.3)
    texts = [b"Foul fine", b"", b"odd, odd\nfoul", "é foulest".encode()]
    want = []
    for t in texts:
        buckets = set(T.features([t])[1].tolist())
        members = [1 / (1 + math.exp(-(sum(float(model.weights[b, k]) for b in buckets) + model.bias[k]))) for k in range(T.MEMBERS)]
        want.append(sum(members) / len(members))
    assert np.allclose(model.score(texts), want)


def test_pieces_give_the_same_features(monkeypatch):
    texts = [b"alpha beta gamma " * 30, b"", b"x" * 500, "naïve Öl ".encode() * 20]
    whole = T.features(texts)
    monkeypatch.setattr(T, "TEXT_BYTES", 50)
    for a, b in zip(whole, T.features(texts), strict=True):
        assert np.array_equal(a, b)
