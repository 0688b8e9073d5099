"""Classifier chain: held-out accuracy, the fit itself, out-of-fold rows, edge cases."""

import random

import numpy as np
import pytest

from stockflow.llm import queries
from stockflow.llm import toxicity as T

BAD = ["grubble", "snerk", "vilthorn", "mucksel"]


def corpus(n, seed=1):
    """Two related labels: q (rude openings) and, mostly among those, t (bad words, inflected)."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 120))]
        q = rnd.random() < 0.3
        t = rnd.random() < (0.5 if q else 0.05)
        if q:
            words[0] = "Ugh!!"
        if t:
            for _ in range(rnd.randrange(1, 4)):
                words[rnd.randrange(1, len(words))] = rnd.choice(BAD) + rnd.choice(["", "s", "ing", ",", "eux"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(not q), int(t)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(1500)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS p_other", "1 AS fold")
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int")
    return d, known, labels, T.train(d, known)


def test_held_out_accuracy(fitted):
    d, _, labels, chain = fitted
    rows = {r.doc_id: r for r in T.score(d, chain, keep=["doc_id"]).select(
        "doc_id", *[T.is_in(chain, c).alias(c) for c in chain.names]).collect()}
    held = [x for x in labels if x[0] % 2 == 0]
    assert sum(rows[i].toxic == bool(t) for i, _, t in held) / len(held) > 0.97
    assert sum(rows[i].low_quality != bool(q) for i, q, _ in held) / len(held) > 0.97


def test_chain_feeds_earlier_probabilities(fitted):
    d, _, _, chain = fitted
    assert [len(x) for x in chain.earlier] == [0, 1] and chain.earlier[1][0] > 0.1
    text = "Ugh!! plain words follow"
    feats = T.features(np.frombuffer(text.encode(), np.uint8))
    p0 = T.sigmoid(chain.weights[0][feats].sum() + chain.bias[0])
    p1 = T.sigmoid(chain.weights[1][feats].sum() + chain.earlier[1][0] * p0 + chain.bias[1])
    spark = d.sparkSession
    got = T.score(spark.createDataFrame([(text,)], "text string"), chain, keep=[]).first()
    assert got.p_low_quality == pytest.approx(p0) and got.p_toxic == pytest.approx(p1)


def test_reruns_agree(fitted):
    d, known, _, chain = fitted
    again = T.train(d.repartition(7), known.repartition(3))
    assert again.thresholds == pytest.approx(chain.thresholds) and all(
        np.allclose(a, b) for a, b in zip(again.weights, chain.weights, strict=True))


def test_fit_finds_the_minimum():
    rnd = np.random.default_rng(0)
    x = (rnd.random((300, 12)) < 0.3).astype(float)
    dense = rnd.random((300, 1))
    y = (rnd.random(300) < T.sigmoid(x @ rnd.normal(size=12) + dense[:, 0])).astype(float)
    rows, cols = np.nonzero(x)
    w, d, b = T.fit(rows, cols, 300, 12, dense, y)
    r = T.sigmoid(x @ w + dense @ d + b) - y
    gradient = np.concatenate([x.T @ r + T.PENALTY * w, dense.T @ r + T.PENALTY * d, [r.sum()]])
    assert np.abs(gradient).max() < 0.2


def test_threshold():
    y = np.array([1, 1, 0, 1, 0, 0])
    assert T.best_threshold(np.array([0.9, 0.8, 0.3, 0.7, 0.2, 0.1]), y) == pytest.approx(0.5)
    assert T.best_threshold(np.zeros(3), np.zeros(3)) == 1.0
    assert T.best_threshold(np.array([0.5, 0.5]), np.array([1, 0])) == 0.25


def test_edge_rows(spark, tmp_path):
    docs, labels = corpus(200, 3)
    docs += [(None, None), (900, None), (901, ""), (902, "x" * 300000), docs[0], docs[0], (0, "another text of id 0")]
    labels += [(None, 1, 1), (901, None, None), (902, None, 0), labels[0], (0, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op6_toxicity_chain(spark, str(tmp_path)).collect()
    assert len(out) == len(docs) and all(0 <= r.p_toxic <= 1 and r.kept == (not r.toxic) for r in out)
    none = T.train(d, lab.limit(0))
    assert [r.p_toxic for r in T.score(d, none, keep=["doc_id"]).limit(3).collect()] == pytest.approx([0] * 3, abs=1e-6)
    assert T.score(d, none, keep=["doc_id"]).where(T.is_in(none, "toxic")).count() == 0
    one_class = T.train(d, lab.where("toxic = 0"), sample_rows=50)
    assert T.score(d, one_class, keep=["doc_id"]).where(T.is_in(one_class, "toxic")).count() == 0
    assert T.score(d.limit(0), none, keep=["doc_id", "text"]).count() == 0
    with pytest.raises(ValueError):
        T.score(d.selectExpr("*", "1 AS P_toxic"), none, keep=["P_toxic"])
