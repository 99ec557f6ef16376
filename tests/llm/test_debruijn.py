import hashlib
import re

import numpy as np
import pytest

from sumac.llm import debruijn as D

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    docs = [(D.LAST if i is None else i, SPLIT.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - D.WINDOW + 1):
            key = tuple(w[k : k + D.WINDOW])
            first[key] = min(first.get(key, D.LAST), i)
    out = []
    for (i, w), (own, _) in zip(docs, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - D.WINDOW + 1):
            if first[tuple(w[k : k + D.WINDOW])] < i:
                gone[k : k + D.WINDOW] = [True] * D.WINDOW
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((own, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in D.removed(frame).collect()), key=str)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute(rows)
    assert sum(r[2] for r in expected) > 0
    assert got(docs) == expected


@pytest.mark.parametrize("seed", range(3))
def test_spliced_passages(spark, seed):
    """Documents spliced from shared passages, loops and edits, with ties of ids, so that paths branch everywhere."""
    rng = np.random.default_rng(seed)
    word = lambda n, k: [f"w{x}" for x in rng.integers(0, k, n)]
    passages = [word(rng.integers(30, 160), 400) for _ in range(8)] + [["a", "b"] * 60, ["z"] * 130, word(90, 2)]
    rows = []
    for n in range(90):
        out = []
        for _ in range(rng.integers(0, 5)):
            kind = rng.integers(0, 4)
            part = list(passages[rng.integers(0, len(passages))])
            if kind == 0:
                part = word(rng.integers(1, 60), 10_000)
            elif kind == 1 and len(part) > 2:
                part[rng.integers(0, len(part))] = f"edit{n}"
            elif kind == 2:
                part = part[rng.integers(0, len(part)) :]
            out += part
        rows.append((int(rng.integers(0, 70)), " \n".join(out)))
    rows += [(None, rows[0][1]), (None, rows[0][1]), (None, None), (200, ""), (201, rows[3][1]), (201, rows[3][1]), (202, "  " + rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(frame) == brute(rows)


def test_extra_columns_and_empty(spark):
    frame = spark.createDataFrame([(1, "x " * 60, 1, 2), (2, "x " * 55 + "y", 3, 4)], "doc_id long, text string, c1 int, n_words int")
    assert got(frame) == brute([(1, "x " * 60), (2, "x " * 55 + "y")])
    assert D.removed(frame.limit(0)).count() == 0


def thue_morse(n, a="a", b="b"):
    """Words in an order that cancels out in polynomials modulo a power of two."""
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out[:n]


def test_words_that_cancel_out_in_polynomials(spark):
    one, other = "".join(thue_morse(1024)), "".join(thue_morse(1024, "b", "a"))
    rest = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join([*rest[:30], one, *rest[30:]])), (2, " ".join([*rest[:30], other, *rest[30:]]))]
    rows += [(3, " ".join(thue_morse(2048))), (4, " ".join(thue_morse(2048, "b", "a")))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame) == brute(rows)
    assert [r[2] for r in got(frame)[:2]] == [0, 0]


def test_paths_are_those_of_the_graph(spark):
    """A passage that three documents share whole, in part and at their ends: one path for each stretch of nodes that always occur together."""
    rng = np.random.default_rng(9)
    shared = [f"s{x}" for x in rng.integers(0, 10**6, 300)]
    filler = lambda k: [f"f{k}x{x}" for x in rng.integers(0, 10**6, 80)]
    rows = [(1, [*filler(1), *shared]), (2, [*filler(2), *shared]), (3, [*filler(3), *shared[150:]]), (4, shared[:120] + filler(4))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    met = D.graph(docs).collect()
    paths = {r["node"]: r for r in D.compacted(D.graph(docs)).collect()}
    assert set(paths) == {r["node"] for r in met} and len(met) > 10
    lengths = {r["end"] - r["start"] for r in paths.values()}
    assert len({(r["end"] - r["start"], r["least"]) for r in paths.values()}) < len(met) and max(lengths) >= D.WINDOW
    assert got(docs) == brute([(i, " ".join(w)) for i, w in rows])
