"""Long texts are worked on in stretches; what comes out doesn't depend on their length."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sumac.llm import bagminhash, bpe, debruijn, decontaminate, fingerprint, language_id, quality, secret_scan, text, toxicity

RNG = np.random.default_rng(11)
WORDS = ["the", "of", "é", "idiot", "x" * 40, "naïve", "漢字", "||", "SHOUT!!", *[f"w{k}" for k in range(3000)]]
LONG = " ".join(RNG.choice(WORDS, 60_000)) + " " + "y" * 30_000 + "\n" + "no-space" * 3_000


def arrays():
    raw = np.frombuffer(LONG.encode(), np.uint8)
    at = np.array([0, len(raw)])
    yield "words", text.word_hashes(raw, *text.word_spans(raw, at)[:2])
    yield "toxicity", toxicity.occurring(raw, at)[1]
    yield "quality", quality.features(raw, at)[3]
    yield "bags", bagminhash.bags(raw, at)[1]
    yield "windows", debruijn.Words(raw, at).windows()[1]
    yield "seeds", decontaminate.hashed_words(raw, at)[0]
    yield "pieces", bpe.pieces(raw, at)[0]
    model = language_id.Model(("a", "b"), ("the of w1 w2 w3 naïve", "é idiot w9 w8 w7 xx"))
    yield "language", language_id.Parser(model).costs(raw, at)[0]


def test_stretches_change_nothing(monkeypatch):
    whole = dict(arrays())
    mark = fingerprint.fingerprint(LONG.encode())
    for module in (text, bpe):
        monkeypatch.setattr(module, "BLOCK", 5_000)
    for name, got in arrays():
        assert np.array_equal(got, whole[name]), name
    zeros = fingerprint._zeros(np.frombuffer(LONG.encode(), np.uint8))
    monkeypatch.setattr(fingerprint, "BLOCK", 5_000)
    assert fingerprint.fingerprint(LONG.encode()).split(":")[0] == mark.split(":")[0]
    n = len(zeros)
    raw = np.frombuffer(LONG.encode(), np.uint8)
    again = np.concatenate([fingerprint._zeros(raw[max(0, k - 6) : k + 5_000])[min(k, 6) :] for k in range(0, n, 5_000)])
    assert np.array_equal(zeros, again)


@pytest.mark.parametrize("size", [1, 20])
def test_very_long_texts_pass(spark, size):
    """A text of many megabytes beside short ones, through each operator that reads texts."""
    big = " ".join(RNG.choice(WORDS, 150_000 * size))
    docs = spark.createDataFrame([(1, big), (2, "short"), (3, None)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = {r["doc_id"]: r for r in bpe.round_trip(docs, path, keep=["doc_id"]).collect()}
    assert coded[1]["decoded_sha256"] == hashlib.sha256(big.encode()).hexdigest()
    if size == 1:
        exact = Tokenizer.from_file(path).encode(big, add_special_tokens=False).ids
        assert coded[1]["ids_sha256"] == hashlib.sha256(np.array(exact, "<u4").tobytes()).hexdigest()
    assert fingerprint.edited_pairs(docs).count() == 3
    assert bagminhash.near_duplicates(docs, keep=["doc_id"]).count() == 3
    assert debruijn.removed(docs).agg({"n_words": "max"}).collect()[0][0] == 150_000 * size
    assert quality.score(docs, quality.train(docs, labels), keep=["doc_id"]).count() == 3
    assert toxicity.score(docs, toxicity.train(docs, labels), keep=["doc_id"]).count() == 3
    assert decontaminate.matches(docs, spark.createDataFrame([(1, big[:400])], "item_id long, text string"), keep=["doc_id"]).where("contaminated").count() == 1
    assert secret_scan.scan(docs, keep=["doc_id"]).count() == 3
