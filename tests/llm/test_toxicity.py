import math
import re

import numpy as np
from pyspark.sql import functions as F

from sumac.llm import toxicity as X
from sumac.llm.text import held_out, word_hashes


def test_features_are_words_and_beginnings():
    text = "Wörd wörd the THE1a naïve.stone stones"
    raw = np.frombuffer(text.encode(), np.uint8)
    _, bins = X.occurring(raw, np.array([0, len(raw)]))
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    words = {w for w in re.split(rb"[^a-z\x80-\xff]+", low) if w}
    keys = {(k, w[: k or None]) for w in words for k in X.BEGINNINGS if len(w) >= k}
    each = [X.occurring(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1] for w in words]
    assert len(bins) == len(keys) and set(np.concatenate(each)) == set(bins)


def test_risk_learns_the_confirmed_words_in_spite_of_toxic_unlabelled_text():
    rng = np.random.default_rng(0)
    common = np.arange(100)
    doc = lambda bad: np.unique(np.concatenate([rng.choice(common, 20), rng.choice([500_001, 500_002, 500_003], 2)] if bad else [rng.choice(common, 20)]))
    model = X.fit([doc(True) for _ in range(200)], [doc(rng.random() < 0.2) for _ in range(1500)], 0.2)
    assert set(model.bins) == {500_001, 500_002, 500_003}
    assert model.bias < 0 and all(model.bias + w > 0 for w in model.weights)


def test_risk_and_slopes_by_finite_differences():
    rng = np.random.default_rng(2)
    bins = np.array([5, 9, 70, 71, 200])
    docs = lambda n: [np.unique(rng.choice([3, 5, 9, 70, 71, 99, 200], rng.integers(1, 6))) for _ in range(n)]
    p, u, prior = docs(30), docs(80), 0.3
    x, z = (np.array([[b in d for b in bins] + [1] for d in side], float) for side in (p, u))
    sides = X.held(p, bins), X.held(u, bins)
    loss = lambda s, sign: np.log1p(np.exp(-sign * s)).mean()
    clean = lambda t: loss(z @ t, -1) - prior * loss(x @ t, -1)
    whole = lambda t: prior * loss(x @ t, 1) + clean(t)
    for _ in range(5):
        theta = rng.normal(size=len(bins) + 1)
        got = X.risks(theta, *sides, prior)
        assert math.isclose(got[0], clean(theta))
        for f, slope in ((whole, got[1]), (clean, got[2])):
            step = [np.where(np.arange(len(theta)) == k, 1e-5, 0) for k in range(len(theta))]
            assert np.allclose(slope, [(f(theta + h) - f(theta - h)) / 2e-5 for h in step], atol=1e-8)


def test_scores_against_each_feature(spark):
    """Brute force: the score of each document from its own words, one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = X.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    weight = dict(zip(model.bins.tolist(), model.weights.tolist(), strict=True))
    for r in X.score(docs, model, keep=["text"]).collect():
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode())
        words = {w for w in re.split(rb"[^a-z\x80-\xff]+", low) if w}
        keys = {(w[: k or None], k) for w in words for k in X.BEGINNINGS if len(w) >= k}
        bins = {int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), seed=k)[0] >> np.uint64(40)) % X.BINS for w, k in keys}
        z = model.bias + sum(weight.get(b, 0.0) for b in bins)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9) and r["predicted"] == (r["score"] >= 0.5)


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = X.score(docs, X.train(docs, labels), keep=["doc_id"]).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    bad, good = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert sum(bad) / len(bad) > 0.85 and sum(good) / len(good) < 0.06


def test_edges(spark):
    docs = spark.createDataFrame([(1, "vile", "a"), (1, "vile", "a"), (2, None, "b"), (None, "", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, 0), (3, None)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    got = X.score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    none = X.train(docs, labels.limit(0))
    assert all(math.isclose(r["score"], 1 / (1 + math.exp(2))) for r in X.score(docs, none).collect())
    assert X.score(docs.limit(0), model).count() == 0
