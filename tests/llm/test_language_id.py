import math
import re

import numpy as np
from pyspark.sql import functions as F

from sumac.llm import language_id as L
from sumac.llm.text import held_out


def phrases(symbols, text):
    """Greedy phrases by looking every prefix up in the text itself."""
    n = at = 0
    while at < len(symbols):
        k = at + 1
        while k < len(symbols) and symbols[at : k + 1] in text:
            k += 1
        n, at = n + 1, k
    return n


def plain(text):
    """Small letters, and one space for whatever stands between them; none in front."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return re.sub("(?:^\0+)|\0+", lambda m: " " if m.start() else "", "".join(c if c.isalpha() else "\0" for c in low))


def test_costs_against_direct_search():
    """Whole texts of many times a lane's length, in several scripts, against looking every phrase up."""
    rng = np.random.default_rng(3)
    some = lambda letters, n: "".join(rng.choice(list(letters), n))
    alphabets = ("abcd  .", "cdef  ,", "äéfg \n", "αβγδεζ  ", "абвгде  ", "".join(map(chr, range(0x4E00, 0x4F00))) + "。  ")
    texts = tuple(some(a, 700) for a in alphabets)
    parser = L.Parser(L.Model(tuple("uvwxyz"), texts))
    docs = ["", "...", "Ab cD. ef", "ä", " ΑΒ γ!", "漢字 ab", some("abcdefäéq .", 5000), some(alphabets[3] + alphabets[4], 3000), some(alphabets[5], 900), texts[0] * 5, "a" * 1500, (texts[5] + texts[3])[50:] * 2]
    docs += [some(alphabets[k % 6], int(n)) for k, n in enumerate(rng.integers(100, 400, 30))]
    raw = [d.encode() for d in docs]
    bits, letters = parser.costs(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for k, d in enumerate(docs):
        assert letters[k] == sum(c.isalpha() for c in d)
        for n, t in enumerate(texts):
            assert math.isclose(bits[k, n], phrases(plain(d), plain(t)) * math.log2(len(plain(t)))), (k, n)


def test_rare_letters_tell_scripts_apart(spark):
    """Languages of one script that differ in a few letters, beside others with far commoner ones."""
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), 4))
    common = {f"l{k}": "".join(map(chr, range(0x61 + 0, 0x7B))) for k in range(2)}
    scripts = common | {"zh": "这说国们为发", "ja": "這說國們為發", "el": "αβγδλμ", "ru": "абвгдл"}
    docs = [(k, " ".join(word(s) for _ in range(60)), n) for n, s in scripts.items() for k in range(8)]
    model = L.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), F.lit(True))
    asked = spark.createDataFrame([(n, " ".join(word(scripts[n]) for _ in range(10))) for n in ("zh", "ja", "el", "ru")], "lang string, text string")
    assert all(r["lang"] == r["lang_pred"] for r in L.identify(asked, model).collect())


def test_whole_texts_are_learned_from(spark):
    docs = spark.createDataFrame([(1, "x" * (L.LONGEST + 5), "a"), (2, "y" * (L.LONGEST + 5), "b"), (3, "short", "b"), (4, "z" * (L.LONGEST + 9), "a")], "doc_id long, text string, lang string")
    assert L.train(docs, F.lit(True)).texts == ("x" * (L.LONGEST + 5), "short")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs, ~held_out(F.col("doc_id")))
    got = L.identify(docs, model).where(held_out(F.col("doc_id"))).collect()
    right = [r["lang"] == r["lang_pred"] for r in got]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, "der die das und", "de", 1.0), (2, "the and of", "en", 2.0), (3, None, "en", 0.0), (4, "123 !", None, 0.0), (None, "the the", None, 0.0), (2, "the and of", "en", 2.0)],
        "doc_id long, text string, lang string, score double",
    )
    model = L.train(docs, F.lit(True))
    assert model.languages == ("de", "en")
    got = L.identify(docs, model).select("doc_id", "lang_pred", "score").collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "en"), (1, "de"), (2, "en"), (2, "en"), (3, "und"), (4, "und")]
    none = L.train(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0
    one = L.train(docs.where("lang = 'en'"), F.lit(True))
    assert {r["lang_pred"] for r in L.identify(docs, one).collect()} == {"en", "und"}
