import itertools
import math
import re

import numpy as np

from sumac.llm import decontaminate as D


def test_masks_meet_every_pattern_of_substitutions():
    for w in range(D.LEAST, D.WINDOW + 1):
        least = D.needed(w)[1]
        assert least == math.ceil(D.SAME * w - 1e-9)
        placed = [{p + s for p in m} for m in D.MASKS for s in range(w - m[-1])]
        assert all(any(m.isdisjoint(gone) for m in placed) for gone in itertools.combinations(range(w), w - least))


def split(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    """doc: (best share, item, start) by every alignment of every item."""
    out = {}
    for d, text in docs:
        words = split(text)
        for i, item in items:
            own = split(item)
            w, least = D.needed(len(own))
            if not own:
                continue
            for shift in range(-len(own), len(words)):
                for k in range(len(own) - w + 1):
                    if 0 <= k + shift and k + shift + w <= len(words):
                        n = sum(a == b for a, b in zip(own[k : k + w], words[k + shift : k + shift + w], strict=True))
                        if n >= least:
                            out[d] = min(out.get(d, (0, 9**9, 0)), (-n / w, i, k + shift))
    return out


def test_against_all_alignments(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["the", "of", "Haus", "né", "x1", *[f"w{k}" for k in range(60)]]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(n)) for k, n in enumerate([2, 4, 5, 7, 9, 10, 12, 15, 19, 20, 33, 60])]
    docs = []
    for k in range(120):
        words = text(int(rng.integers(0, 60))).split()
        own = items[rng.integers(0, len(items))][1].split()
        for p in np.flatnonzero(rng.random(len(own)) < [0, 0.1, 0.2, 0.3][k % 4]):
            own[p] = "changed"
        at = rng.integers(0, len(words) + 1)
        part = own[int(rng.integers(0, 4)) * (k % 3) :]
        docs.append((k, ", ".join(words[:at] + part + words[at:]).upper() if k % 5 == 0 else " ".join(words[:at] + part + words[at:])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (-r["overlap"], r["item_id"], r["start"]) for r in D.matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect() if r["contaminated"]}
    expected = brute(docs, items)
    assert 40 < len(expected) <= 120 and got == expected


def test_whole_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r["doc_id"]: (-r["overlap"], r["item_id"], r["start"]) for r in D.matches(docs, items, keep=["doc_id"]).where("contaminated").collect()}
    texts, given = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]
    runs = {tuple(split(t)[k : k + 3]) for _, t in given for k in range(max(1, len(split(t)) - 2))}
    near = [(d, t) for d, t in texts if any(tuple(split(t)[k : k + 3]) in runs for k in range(len(split(t))))]  # any match has three equal words in a row
    assert got and set(got) <= {d for d, _ in near}
    short = [(d, t) for d, t in near if len(split(t)) < 400]
    assert {d: x for d, x in got.items() if d in dict(short)} == brute(short, given)


def test_edges(spark):
    long = " ".join(f"a{k}" for k in range(30))
    docs = spark.createDataFrame([(1, long, 7), (1, long, 7), (None, None, None), (3, "", 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(5, long), (4, long), (None, None), (8, ""), (None, "b c d e f"), (3, " .. ")], "item_id long, text string")
    got = D.matches(docs, items).collect()
    assert [(r["contaminated"], r["item_id"], r["overlap"]) for r in got] == [(True, 4, 1.0)] * 2 + [(False, None, 0.0)] * 2
    assert not any(r["contaminated"] for r in D.matches(docs, items.limit(0)).collect())
    assert D.matches(docs.limit(0), items).count() == 0


def test_short_items_with_a_word_changed(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, D.LEAST)]
    docs, expected = [], {}
    for n, item in items:
        for gone in itertools.chain([()], ((k,) for k in range(n)), itertools.combinations(range(n), 2)):
            words = ["x" if k in gone else w for k, w in enumerate(item.split())]
            expected[len(docs)] = (n, 1 - len(gone) / n) if len(gone) < (2 if n > 4 else 1) else None
            docs.append((len(docs), " ".join(["a", "b", *words, "c"] if len(docs) % 2 else words)))
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["item_id"], r["overlap"]) if r["contaminated"] else None for r in got} == {d: x and (x[0], round(x[1] * x[0]) / x[0]) for d, x in expected.items()}


def test_every_place_of_an_item_is_left_out_by_a_mask_of_its_length():
    for n in range(1, D.LEAST):
        made = D.masks(n)
        assert all(len(m) >= min(n, D.PART) for m in made) and D.needed(n) == (n, n if n < 5 else n - 1)
        assert n < 5 or all(any(p not in m for m in made) for p in range(n))
