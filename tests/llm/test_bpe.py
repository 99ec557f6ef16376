import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sumac.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n", "a", "naïve café  über x　y", "x<|endoftext|>y <|endoftext|>", "<|endof text|>", "  lead", "trail  ",
    "漢字かな交じり文" * 300, "I'm you're 'tis 123 4567!!\t\ttabs\r\nline" * 50, "z" * 5000, "    word" * 200, "😀 emoji‍👩 " * 100, "word " * 3000,
]


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(rows, texts, exact):
    for k, text in enumerate(texts):
        ids = exact.encode(text or "", add_special_tokens=False).ids
        said = exact.decode(ids, skip_special_tokens=False)
        row = rows[k]
        assert row["n_tokens"] == len(ids), k
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), k
        assert row["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest(), k


def test_edge_texts(spark, exact):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH, keep=["doc_id"]).collect()}
    check(rows, TEXTS, exact)
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert all(got[k]["ids"] == exact.encode(t or "", add_special_tokens=False).ids and got[k]["decoded"] == (t or "") for k, t in enumerate(TEXTS))


def test_random_texts(spark, exact):
    rng = np.random.default_rng(5)
    letters = list("ab c\n 1.'é漢  <|>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 900))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check({r["doc_id"]: r for r in bpe.round_trip(docs, PATH).collect()}, texts, exact)


def test_whole_table(spark, sf, exact):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH, keep=["doc_id"]).collect()}
    order = sorted(texts)
    check([rows[k] for k in order], [texts[k] for k in order], exact)


def test_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert bpe.round_trip(docs, PATH).count() == 3
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_sure_splits_are_splits(exact):
    """Encoding what lies between sure splits on its own gives the encoding of the whole."""
    rng = np.random.default_rng(8)
    letters = list("ab c\n 1.'é漢。、 \t\u00a0\u3000—ß٣\u0301")
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.integers(1, 60)))
        raw = text.encode()
        cuts = [0, *bpe.sure_splits(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
        got = [k for i, j in zip(cuts[:-1], cuts[1:], strict=True) for k in exact.encode(raw[i:j].decode(), add_special_tokens=False).ids]
        assert got == exact.encode(text, add_special_tokens=False).ids, text


def test_pieces_are_reused(spark, exact):
    """A passage within different documents is encoded once, without white space too, and the results are those of the library."""
    rng = np.random.default_rng(6)
    passage = " ".join(f"word{x}" for x in rng.integers(0, 10**6, 800))
    signs = "".join("漢字仮名交文章例示"[x] if x < 9 else "。、"[x % 2] for x in rng.integers(0, 11, 4000))
    texts = [f"{k} {'x' * k} " + passage + f" end {k}" for k in range(5)] + [f"第{k}章" + signs + "終" * k for k in range(5)] + ["alone " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    check({r["doc_id"]: r for r in bpe.round_trip(docs, PATH, keep=["doc_id"]).collect()}, texts, exact)
    used = bpe.reuse(docs).collect()[0]
    assert used["total"] == sum(len(t.encode()) for t in texts) and used["shared"] > 0.6 * used["total"] and used["encoded"] < 0.25 * used["shared"]
