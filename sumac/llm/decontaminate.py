"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, A to Z as a to z. A document holds an item if, at some alignment of the two, a
window of W = min(WINDOW, the item's words) consecutive words has at least SAME of them equal, place by place. Fixed masks
pick a few of the window's places; every window with that many equal words holds a place where a mask meets equal words
only (checked over all patterns of substitutions, see the tests), so that hashes under the masks find every such window.

The items' hashes and the documents' meet in a join. A filter of fixed size over the items' hashes drops most documents'
before it; what it lets pass in vain the join drops. Each alignment that a hash suggests is then verified word by word
about the places that the masks hit. Equal texts count once throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumac.llm.text import binaries, bit_filter, blocks, field, in_filter, lists, mix, stored, word_hashes, word_spans

#: Words of a window, and the share of it that must be equal.
WINDOW, SAME = 13, 0.8
#: The masks, as places that count. They serve items of LEAST words and more.
MASKS, LEAST = ((0, 1, 3, 5, 6), (0, 1, 2, 8, 9), (0, 3, 4, 5, 7)), 10
#: Shorter items are looked for whole, by masks of PART places; the SAME share leaves a word of 5 to 9 open, and none of fewer.
PART = 4
#: Candidates that a task takes in at a time.
PAIRS = 1_000
#: The columns of matches().
NEW = ("contaminated", "item_id", "overlap", "start", "length", "items")
_SPLIT = np.ones(256, bool)
_SPLIT[48:58] = _SPLIT[65:91] = _SPLIT[97:123] = _SPLIT[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each row's words begin and end in them)."""
    low = _LOWER[data]
    starts, ends, row = word_spans(low, at, _SPLIT)
    return word_hashes(low, starts, ends), np.searchsorted(row, np.arange(len(at)))


def seeds(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """The hash under a mask at each place where it fits, in one row after another (the caller drops what crosses rows)."""
    n = len(words) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(sum(3**p for p in places)))
    for k, p in enumerate(places):
        total += words[p : p + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) % 2**64 | 1)
    return mix(total)


def needed(n: int) -> tuple[int, int]:
    """(words of the window, equal ones) that an item of n words asks."""
    w = min(WINDOW, n)
    return w, -(-w * 8 // 10)


def masks(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks for items of n words. Those for short items leave out stretches that together are the whole item, so that one meets equal words only."""
    if n >= LEAST:
        return MASKS
    out = max(0, n - PART)
    return tuple(tuple(p for p in range(n) if not k <= p < k + out) for k in range(0, n, out)) if out else (tuple(range(n)),)


def _items(benchmark: DataFrame, text: str, item_id: str) -> DataFrame:
    """(item, item_id, n, own) of the items that have words, each word sequence once, under its least id; own: the words' hashes. Stored, so that the numbers stand."""
    given = benchmark.select(field(benchmark, item_id).cast("long").alias("item_id"), field(benchmark, text).cast("string").alias("text"))

    def run(batches):
        for rows, data, at in blocks(batches, "text"):
            words, edge = hashed_words(data, at)
            yield pa.RecordBatch.from_arrays([rows.column("item_id"), pa.array(np.diff(edge).astype(np.int32)), binaries(words, np.diff(edge))], ["item_id", "n", "own"])

    each = given.mapInArrow(run, "item_id long, n int, own binary").where("n > 0")
    return stored(each.groupBy("own", "n").agg(F.min("item_id").alias("item_id")).withColumn("item", F.monotonically_increasing_id()))


def _seeded(items: DataFrame) -> DataFrame:
    """(seed, twin, item, place) of the items under their masks; twin is a second hash for the filter."""

    def run(batches):
        for rows in batches:
            found = []
            for item, own in zip(rows.column("item").to_pylist(), rows.column("own"), strict=True):
                words = np.frombuffer(own.as_buffer(), np.uint64)
                for mask in masks(len(words)):
                    h = seeds(words, mask)
                    found.append((h, np.full(len(h), item), np.arange(len(h), dtype=np.int32)))
            if found:
                h, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [pa.array(h.view(np.int64)), pa.array(mix(h).view(np.int64)), pa.array(item), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["seed", "twin", "item", "place"])

    return items.select("item", "own").mapInArrow(run, "seed long, twin long, item long, place int")


def _hits(docs: DataFrame, used: tuple[tuple[int, ...], ...], wanted: np.ndarray) -> DataFrame:
    """(key, seeds, places, at, words) of the documents (key, text) with hashes that the filter lets pass: these and where they
    stand, and the places and hashes of the words that a window about one of them may hold."""

    def run(batches):
        for rows, data, at in blocks(batches, "text"):
            words, edge = hashed_words(data, at)
            found = []
            for mask in used:
                h = seeds(words, mask)
                hit = np.flatnonzero(in_filter(wanted, h) & in_filter(wanted, mix(h)))
                row = np.searchsorted(edge, hit, "right") - 1
                inside = hit + mask[-1] < edge[row + 1]
                found.append((hit[inside], row[inside], h[hit[inside]]))
            place, row, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(place, kind="stable")
            place, row, h = place[order], row[order], h[order]
            turn = np.zeros(len(words) + 1, np.int64)
            np.add.at(turn, np.maximum(edge[row], place - WINDOW + 1), 1)
            np.add.at(turn, np.minimum(edge[row + 1], place + WINDOW), -1)
            near = np.flatnonzero(np.cumsum(turn)[:-1] > 0)
            near_row = np.searchsorted(edge, near, "right") - 1
            held = np.unique(row)
            count = np.bincount(row, minlength=len(rows))[held]
            covered = np.bincount(near_row, minlength=len(rows))[held]
            key = rows.column("key").take(pa.array(held))
            columns = [key, lists(h.view(np.int64), count, pa.int64()), lists((place - edge[row]).astype(np.int32), count, pa.int32())]
            columns += [lists((near - edge[near_row]).astype(np.int32), covered, pa.int32()), binaries(words[near], covered)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "seeds", "places", "at", "words"])

    return docs.select("key", "text").mapInArrow(run, "key binary, seeds array<long>, places array<int>, at array<int>, words binary")


def _verified(candidates: DataFrame) -> DataFrame:
    """(key, item, item_id, share, start, length) of the candidates (key, item, item_id, shift, own, at, words) whose best window has enough equal words."""

    def run(batches):
        for rows in batches:
            kept, share, start, length = [], [], [], []
            for k, (shift, own, at, words) in enumerate(zip(rows.column("shift").to_pylist(), *(rows.column(c) for c in ("own", "at", "words")), strict=True)):
                item, text = (np.frombuffer(x.as_buffer(), np.uint64) for x in (own, words))
                place = at.values.to_numpy()
                w, least = needed(len(item))
                wanted = shift + np.arange(len(item))
                spot = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
                there = place[spot] == wanted
                runs = lambda flags: np.concatenate([[0], np.cumsum(flags)])
                equal, held = (c[w:] - c[:-w] for c in (runs(there & (text[spot] == item)), runs(there)))
                equal = np.where(held == w, equal, -1)  # a window lies in the document
                best = int(equal.argmax())
                if equal[best] >= least:
                    kept.append(k)
                    share.append(float(equal[best] / w))
                    start.append(int(wanted[best]))
                    length.append(w)
            columns = [*[rows.column(c).take(pa.array(kept, pa.int64())) for c in ("key", "item", "item_id")], pa.array(share, pa.float64()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "item", "item_id", "share", "start", "length"])

    return candidates.mapInArrow(run, "key binary, item long, item_id long, share double, start long, length long")


def _held(texts: DataFrame, benchmark: DataFrame, item_text: str, item_id: str) -> DataFrame:
    """(key, best, items) of the texts (key, text) that hold items; stored."""
    items = _items(benchmark, item_text, item_id)
    seeded = stored(_seeded(items))
    lengths = [r[0] for r in items.select(F.least("n", F.lit(LEAST))).distinct().collect()]  # LEAST rows at most
    used = tuple(dict.fromkeys(mask for n in sorted(lengths) for mask in masks(n))) or MASKS
    wanted = bit_filter(seeded.select(F.explode(F.array("seed", "twin")).alias("seed")), "seed")
    hits = _hits(texts, used, wanted)
    once = stored(hits.groupBy("key").agg(*[F.first(c).alias(c) for c in ("seeds", "places", "at", "words")]))
    each = once.select("key", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select("key", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("there"))
    met = stored(each.join(seeded, "seed").select("key", "item", (F.col("there") - F.col("place")).alias("shift")).distinct())
    candidates = met.join(items, "item").join(once.select("key", "at", "words"), "key").select("key", "item", "item_id", "shift", "own", "at", "words")
    found = stored(_verified(candidates), PAIRS)
    order = F.struct((-F.col("share")).alias("less"), F.col("item_id").isNull().alias("gone"), "item_id", "start", "length")
    best = found.groupBy("key", "item").agg(F.min(order).alias("best")).groupBy("key").agg(F.min("best").alias("best"), F.count("*").alias("items"))
    return stored(best)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """docs with contaminated (boolean) and, of the best match (highest share, then least item id, then first place), item_id
    (long), overlap (double, share of equal words of its window), start and length (long, in words), and items (long): how
    many of the items with different words it holds.

    An item under five words counts where all its words stand in a row, one of 5 to 9 words where all but one do. A null
    text counts as empty and holds nothing, as does any text if the benchmark is empty; then overlap and items are 0 and the
    rest is null. Repeated rows stay repeated; a column of docs that has the name of a new one is replaced. Jobs run while
    the result is made.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in NEW]
    whole = F.coalesce(field(docs, text).cast("string"), F.lit(""))
    found = _held(docs.select(F.unhex(F.md5(whole)).alias("key"), whole.alias("text")), benchmark, item_text, item_id)
    rows = docs.select(F.struct(*[field(docs, c) for c in keep]).alias("row"), F.unhex(F.md5(whole)).alias("key"))
    got, best = rows.join(found, "key", "left"), F.col("best")
    return got.select(
        *[F.col("row")[c].alias(c) for c in keep],
        best.isNotNull().alias("contaminated"), best["item_id"].alias("item_id"), F.coalesce(-best["less"], F.lit(0.0)).alias("overlap"), best["start"].alias("start"),
        best["length"].alias("length"), F.coalesce("items", F.lit(0)).cast("long").alias("items"),
    )
