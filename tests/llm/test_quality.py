import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from sumac.llm import quality as Q
from sumac.llm.text import held_out

SF = "/root/testdata/sf0.01"


def test_score_is_the_sum_over_all_pairs(spark):
    rng = np.random.default_rng(4)
    d = Q.BINS + len(Q.STATS) + 2
    model = Q.Model(0.3, rng.normal(0, 0.3, d), rng.normal(0, 0.3, (d, Q.FACTORS)), rng.normal(0, 1, len(Q.STATS) + 2), np.ones(len(Q.STATS) + 2), ("size",))
    texts = ["", "one two two three", "ÀB cd | | !!", "z"]
    docs = spark.createDataFrame([(k, t, k or None) for k, t in enumerate(texts)], "doc_id long, text string, size long")
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, model).collect()}
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        _, b, x, stats = Q.features(raw, np.array([0, len(raw)]))
        meta = [math.log1p(k) if k else 0.0, 0.0 if k else 1.0]
        full = np.zeros(d)
        full[b] = x
        full[Q.BINS :] = np.clip(np.concatenate([stats[0], meta]) - model.mean, -4, 4) / 2
        z = model.w0 + full @ model.w
        for i, j in itertools.combinations(np.flatnonzero(full), 2):
            z += float(model.v[i] @ model.v[j]) * full[i] * full[j]
        assert math.isclose(got[k], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels, metadata=("n_chars",))
    rows = Q.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) / len(good) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good text here", 5.0), (1, "good text here", 5.0), (2, None, 1.0), (None, "", 2.0), (4, "| | |", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (4, 0), (4, 0), (2, None), (7, 1), (7, 0)], "doc_id long, quality int")
    model = Q.train(docs, labels, metadata=("absent",))
    got = Q.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = Q.train(docs, labels.limit(0))
    assert {r["score"] for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs.limit(0), model).count() == 0
