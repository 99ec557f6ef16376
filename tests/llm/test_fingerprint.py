import hashlib

import numpy as np
import pytest

from sumac.llm import fingerprint as P


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(0, 70))) for _ in "12")
        assert P.distance(a, b) == levenshtein(a, b)


def test_properties():
    rng = np.random.default_rng(2)
    assert P.fingerprint(b"") == "0::" and P.likeness("0::", "0::") == 1
    for size in (1, 3, 60, 64, 65, 500, 20_000, 300_000):
        text = rng.integers(32, 127, size, dtype=np.uint8).tobytes()
        other = rng.integers(32, 127, size, dtype=np.uint8).tobytes()
        own = P.fingerprint(text)
        assert own == P.fingerprint(text) and all(len(s) <= P.LONGEST for s in own.split(":")[1:])
        assert P.likeness(own, own) == 1
        if size >= 60:
            cut = text[: size // 2] + other[: size - size // 2]
            assert P.likeness(own, P.fingerprint(cut)) > 0.35
            assert P.likeness(own, P.fingerprint(other)) == 0 if size > 100 else True
            assert P.likeness(own, P.fingerprint(b"inserted " + text)) > 0.5 or size < 100
    assert P.likeness(P.fingerprint(b"a" * 100_000), P.fingerprint(b"a" * 100_000)) == 1


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        own, ed = P.fingerprint(t.encode()), P.fingerprint(new.encode())
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), own, ed, P.likeness(own, ed), P.likeness(own, P.fingerprint(nxt.encode())))
    return out


@pytest.mark.parametrize("rows", [[(1, "abc")], [(5, None), (2, ""), (9, "é😀漢" * 50), (7, "x")]])
def test_small(spark, rows):
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, fingerprint string")
    got = {r[0]: tuple(r)[1:] for r in P.edited_pairs(docs).collect()}
    assert got == brute(rows)


def test_whole_table_over_many_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: tuple(r)[1:] for r in P.edited_pairs(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)


def test_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "aa"), (1, "aa"), (None, "b"), (None, None)], "doc_id long, text string")
    assert P.edited_pairs(docs).count() == 4
    assert P.edited_pairs(docs.limit(0)).count() == 0
    assert P.fingerprints(docs).count() == 4
    pairs = spark.createDataFrame([("0:AB:A", "0:AB:A"), (None, "0:A:A")], "a string, b string")
    assert [r["likeness"] for r in P.likenesses(pairs, "a", "b").orderBy("a").collect()] == [None, 1.0]
