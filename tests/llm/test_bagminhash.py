import collections

import numpy as np
import pytest

from sumac.llm import bagminhash as B


def shingles(text):
    words = (text or "").split()
    return collections.Counter(tuple(words[k : k + B.SHINGLE]) for k in range(max(1, len(words) - B.SHINGLE + 1))) if words else collections.Counter()


def jaccard(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low) if a or b else 0.0


def brute(rows):
    """class of each row by comparing all pairs that share a run."""
    bags = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = collections.defaultdict(list)
    for k, bag in enumerate(bags):
        for s in bag:
            where[s].append(k)
    pairs = {(a, b) for group in where.values() for a in group for b in group if a < b}
    for a, b in pairs:
        if find(a) != find(b) and jaccard(bags[a], bags[b]) >= B.SIMILAR:
            top[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


def test_registers_are_unbiased():
    rng = np.random.default_rng(0)
    for w1, w2 in (({"a": 1}, {"a": 3}), ({"a": 5, "b": 2, "c": 1}, {"a": 3, "b": 2, "d": 4}), ({k: 1 for k in range(40)}, {k: 1 + k % 3 for k in range(8, 48)})):
        expected = sum(min(w1.get(k, 0), w2.get(k, 0)) for k in {*w1, *w2}) / sum(max(w1.get(k, 0), w2.get(k, 0)) for k in {*w1, *w2})
        same = []
        for _ in range(60):
            code = {k: rng.integers(0, 2**63, dtype=np.uint64) for k in {*w1, *w2}}
            runs = np.array([code[k] for k in w1] + [code[k] for k in w2], np.uint64)
            row = np.array([0] * len(w1) + [1] * len(w2))
            got = B.signatures(row, runs, np.array([*w1.values(), *w2.values()]), 2)
            assert np.isfinite(got).all()
            same.append((got[0] == got[1]).mean())
        assert abs(np.mean(same) - expected) < 4 * 0.5 / (60 * B.REGISTERS) ** 0.5


def classes(frame):
    rows = frame.collect()
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r["class_id"]].add(r["doc_id"])
    assert all(sum(r["kept"] for r in rows if r["class_id"] == c) == 1 for c in groups)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = collections.defaultdict(set)
    for (i, _), c in zip(rows, brute(rows), strict=True):
        expected[c].add(i)
    assert classes(B.near_duplicates(docs, keep=["doc_id"])) == {frozenset(g) for g in expected.values()}


def test_chains_of_edits(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for _ in range(15):
            rows.append((n, " ".join(words)))
            n += 1
            words[rng.integers(0, len(words))] = f"e{n}"
            if rng.random() < 0.5:
                words[rng.integers(0, len(words))] = f"f{n}"
    expected = collections.defaultdict(set)
    for (i, _), c in zip(rows, brute(rows), strict=True):
        expected[c].add(i)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(B.near_duplicates(frame)) == {frozenset(g) for g in expected.values()}


def test_edges(spark):
    docs = spark.createDataFrame(
        [(3, "a b c", "x"), (1, " a  b c ", "x"), (1, " a  b c ", "x"), (None, None, None), (5, "", "x"), (6, " \n", "x"), (None, "a b c", "x"), (9, "z " * 9, "q")],
        "doc_id long, text string, kept string",
    )
    got = B.near_duplicates(docs, keep=["doc_id", "text"]).collect()
    assert len(got) == 8
    abc = [r for r in got if r["text"] and "a" in r["text"]]
    assert {r["class_id"] for r in abc} == {1} and {r["class_size"] for r in abc} == {4} and sum(r["kept"] for r in abc) == 1
    assert all(r["kept"] and r["class_size"] == 1 and r["class_id"] == r["doc_id"] for r in got if r not in abc)
    assert B.deduplicated(docs).columns == docs.columns and B.deduplicated(docs).count() == 5
    assert B.near_duplicates(docs.limit(0)).count() == 0


def test_pairs_among_many_look_alikes(spark):
    """Pages of one template share buckets by the hundred; the few linked pairs among them must all be found."""
    template, rows, expected = [f"t{k}" for k in range(400)], [], []
    for k in range(300):
        words = [*template, *[f"p{k}x{j}" for j in range(50)]]
        rows.append((2 * k, " ".join(words)))
        expected.append(frozenset([2 * k]))
        if k % 5 == 0:
            rows.append((2 * k + 1, " ".join([*words[:402], *[f"q{k}x{j}" for j in range(48)]])))
            expected[-1] = frozenset([2 * k, 2 * k + 1])
    bags = [shingles(rows[k][1]) for k in (0, 1, 2)]
    assert jaccard(bags[0], bags[1]) >= B.SIMILAR > jaccard(bags[0], bags[2]) > 0.79
    assert classes(B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == set(expected)


def test_texts_that_share_a_hash_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (1, 10, "a"), (1, 20, "b"), (2, 30, "c"), (None, None, "d")], "node long, other long, t string")
    shared = B.shared_nodes(rows)
    nodes = {t: {r["node"] for r in B.apart(rows, shared).where(f"t = '{t}'").collect()} for t in "abcd"}
    assert nodes["a"] == {1} and nodes["c"] == {2} and nodes["d"] == {None} and len(nodes["b"]) == 1 and nodes["b"] != {1}
    assert B.shared_nodes(rows.where("t <> 'b'")) is None and B.apart(rows, None).count() == 5


def test_words_that_cancel_out_in_polynomials(spark):
    out = "a"
    while len(out) < 1024:
        out += out.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(6))
    docs = [(1, out + " " + rest), (2, out.translate(str.maketrans("ab", "ba")) + " " + rest), (3, " ".join(out)), (4, " ".join(out.translate(str.maketrans("ab", "ba"))))]
    assert {frozenset(g) for g in classes(B.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))} == expected(docs)


def expected(rows):
    groups = collections.defaultdict(set)
    for (i, _), c in zip(rows, brute(rows), strict=True):
        groups[c].add(i)
    return {frozenset(g) for g in groups.values()}
