"""Substring deduplication by De Bruijn compaction.

Nodes are runs of K words, edges lead from one node to the next of a document. Of all runs those are nodes that some window
of WINDOW words has as its anchor (the run whose hash is least, the first of equals), so that the graph is sparse: from a
node to the next it is K - 1 words at most, and both together spell out the edge. A document's ends are edges of their own.

Grouped over all documents, a node that several hold knows the least of them, and its edges in and out where they are the
same at each occurrence. Nodes joined by an edge that is the only one out of the first and into the second compact into
paths, by joins that double the way to a path's head each time. All nodes of a path occur in the same documents. Each
occurrence of a node gives, by its place in the path, the place of the whole path in the document: these coordinates, once
for each path, verify every window inside by the path's least document. Windows that have a repeated anchor but leave its
path are verified one by one: their 128-bit hashes meet in a join with the least document of each. Windows whose anchor
occurs in one document only are not repeated. So every window is judged exactly.

Only digests, anchors and hashes of windows at branches are shuffled, and the texts of contents that hold repeated anchors,
once for each content. Equal contents are judged once: but for the least document they are repeated as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumac.llm.text import binaries, bit_filter, blocks, by_block, field, in_filter, lists, row_hashes, run_hashes, span_hashes, stored, word_hashes, word_spans

#: Words of a window and of a node (more than half a window, so that neighbouring nodes of a document overlap).
WINDOW, K = 50, 26
#: What stands for a null doc_id: larger than any other.
LAST = 2**63 - 1


class Words:
    """The words of a block, as hashes, with where each row's begin."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.n = data, len(at) - 1
        self.starts, self.ends, self.row = word_spans(data, at)
        self.hash = word_hashes(data, self.starts, self.ends)
        self.edge = np.searchsorted(self.row, np.arange(self.n + 1))
        self.size = np.diff(self.edge)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each row's word sequence."""
        other = word_hashes(self.data, self.starts, self.ends, seed=1)
        return row_hashes(self.hash, self.edge, 2).view(np.int64), row_hashes(other, self.edge, 3).view(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, anchor's first word) of every window."""
        p = np.arange(max(0, len(self.hash) - WINDOW + 1))
        p = p[p + WINDOW <= self.edge[self.row[p] + 1]]
        if not len(p):
            return p, p
        least = np.lib.stride_tricks.sliding_window_view(self.runs(), WINDOW - K + 1).argmin(1)
        return p, p + least[p]

    def runs(self) -> np.ndarray:
        return run_hashes(self.hash, K, 5)

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the distinct anchors."""
        first = np.unique(self.windows()[1])
        return first, self.runs()[first] if len(first) else np.zeros(0, np.uint64)

    def edges(self) -> tuple[np.ndarray, ...]:
        """(first word, node, node before, words back to it, node after, words ahead to it) of the distinct anchors.

        At a row's ends the hash of the words before (after) stands for the node, and -1 less their number for the way.
        """
        first, node = self.nodes()
        row = self.row[first]
        head, tail = np.ones(len(first), bool), np.ones(len(first), bool)
        head[1:] = tail[:-1] = row[1:] != row[:-1]
        before, after = np.roll(node, 1), np.roll(node, -1)
        back, ahead = first - np.roll(first, 1), np.roll(first, -1) - first
        begin, end = self.edge[row[head]], self.edge[row[tail] + 1]
        before[head], back[head] = span_hashes(self.hash, begin, first[head], 6), begin - first[head] - 1
        after[tail], ahead[tail] = span_hashes(self.hash, first[tail] + K, end, 6), first[tail] + K - end - 1
        return first, node, before, back, after, ahead

    def window_hashes(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = word_hashes(self.data, self.starts, self.ends, seed=1)
        return tuple(run_hashes(x, WINDOW, seed)[p].view(np.int64) if len(p) else np.zeros(0, np.int64) for x, seed in ((self.hash, 7), (other, 8)))

    def kept(self, row: int, gone: np.ndarray) -> bytes:
        """The row's words but those gone, joined by one space."""
        stay = np.flatnonzero(~gone) + self.edge[row]
        return _joined(self.data, self.starts[stay], self.ends[stay])


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    if not len(starts):
        return b""
    size = ends - starts + 1
    before = np.cumsum(size) - size
    out = data[np.minimum(np.repeat(starts - before, size) + np.arange(int(size.sum())), len(data) - 1)]
    out[before[1:] - 1] = 32
    return out[:-1].tobytes()


def _contents(docs: DataFrame) -> DataFrame:
    """(doc_id, c1, c2, n_words, whole): each row's content and the digest of all its words; stored."""

    def make(rows, data, at):
        words = Words(data, at)
        c1, c2 = words.keys()
        none = np.zeros(0, bool)
        whole = [hashlib.sha256(words.kept(k, np.zeros(n, bool) if n else none)).hexdigest() for k, n in enumerate(words.size.tolist())]
        return [pa.array(c1), pa.array(c2), pa.array(words.size.astype(np.int64)), pa.array(whole, pa.string())]

    new = [("c1", T.LongType()), ("c2", T.LongType()), ("n_words", T.LongType()), ("whole", T.StringType())]
    return stored(by_block(docs, make, new, "text", ["doc_id", "__at"] if "__at" in docs.columns else ["doc_id"]))


_WAYS = ("before", "back", "after", "ahead")


def graph(docs: DataFrame) -> DataFrame:
    """(node, least, one_in, before, back, one_out, after, ahead) of the nodes that occur in two documents or more: their least
    doc_id, whether they have one edge in and one out, and those edges (see Words.edges). docs: doc_id (not null) and text."""

    def run(batches):
        for rows, data, at in blocks(batches, "text"):
            words = Words(data, at)
            first, *edges = words.edges()
            doc = rows.column("doc_id").to_numpy(zero_copy_only=False)[words.row[first]]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (doc, *edges)], ["doc_id", "node", *_WAYS])

    each = docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, node long, {', '.join(f'{c} long' for c in _WAYS)}")
    both = [f(c).alias(f"{n}_{c}") for c in ("doc_id", *_WAYS) for n, f in (("min", F.min), ("max", F.max))]
    met = each.groupBy("node").agg(*both).where("min_doc_id < max_doc_id")
    one = {n: (F.col(f"min_{a}") == F.col(f"max_{a}")) & (F.col(f"min_{b}") == F.col(f"max_{b}")) for n, a, b in (("one_in", "before", "back"), ("one_out", "after", "ahead"))}
    return met.select("node", F.col("min_doc_id").alias("least"), *[c.alias(n) for n, c in one.items()], *[F.col(f"min_{c}").alias(c) for c in _WAYS])


def compacted(met: DataFrame) -> DataFrame:
    """(node, start, end, least) of the nodes of graph(): where the path of each begins and ends, in words from the node's first, and the path's least document.

    A node first points at the node before it, if the edge between them is the only one out of that and into this; then each
    round joins the pointers to their own until all of them reach a path's head. At most one node of a path points at another.
    """
    before = met.where("one_out").select(F.col("node").alias("before"), F.lit(True).alias("leads"))
    linked = met.join(before, "before", "left")
    links = F.col("one_in") & (F.col("back") > 0) & F.col("leads").isNotNull()
    own = [F.when(links, F.col("before")).otherwise(F.col("node")).alias("up"), F.when(links, F.col("back")).otherwise(F.lit(0)).alias("way"), (~links).alias("done")]
    ends = [F.when(F.col(one) & (F.col(way) < 0), -1 - F.col(way)).otherwise(F.lit(0)).alias(n) for n, one, way in (("lead", "one_in", "back"), ("trail", "one_out", "ahead"))]
    state = stored(linked.select("node", "least", *ends, *own))
    while not state.where("not done").isEmpty():
        there = state.select(F.col("node").alias("up"), F.col("up").alias("head"), F.col("way").alias("further"), F.col("done").alias("arrived"))
        moved = state.where("not done").join(there, "up").select("node", "least", "lead", "trail", F.col("head").alias("up"), (F.col("way") + F.col("further")).alias("way"), F.col("arrived").alias("done"))
        state = stored(state.where("done").unionByName(moved))
    paths = state.groupBy("up").agg(F.max("lead").alias("lead"), F.max(F.col("way") + K + F.col("trail")).alias("length"), F.min("least").alias("least"))
    met_again = state.select("node", "up", "way").join(paths, "up")
    return met_again.select("node", (-F.col("way") - F.col("lead")).cast("int").alias("start"), (F.col("length") - F.col("way")).cast("int").alias("end"), "least")


def _texts(docs: DataFrame, wanted: np.ndarray, by_node: bool) -> DataFrame:
    """(c1, c2, text) of the contents that the filter lets pass, once in a task: by their nodes, or by c1."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for rows, data, at in blocks(batches, "text"):
            words = Words(data, at)
            c1, c2 = words.keys()
            if by_node:
                first, node = words.nodes()
                hit = np.unique(words.row[first[in_filter(wanted, node)]])
            else:
                hit = np.flatnonzero(in_filter(wanted, c1.view(np.uint64)))
            new = []
            for k in hit.tolist():
                key = (int(c1[k]), int(c2[k]))
                if key not in seen:
                    seen.add(key)
                    new.append(k)
            text = rows.column("text").take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c1[new]), pa.array(c2[new]), text], ["c1", "c2", "text"])

    return docs.select("text").where("text is not null").mapInArrow(run, "c1 long, c2 long, text string")


def _occurrences(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(node, c1, c2, place) of the anchors that the filter lets pass, of each content once in a task."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for rows, data, at in blocks(batches, "text"):
            words = Words(data, at)
            c1, c2 = words.keys()
            new = np.zeros(words.n, bool)
            for k, key in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    new[k] = True
            first, node = words.nodes()
            hit = in_filter(wanted, node) & new[words.row[first]]
            first, node, row = first[hit], node[hit], words.row[first[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(c1[row]), pa.array(c2[row]), pa.array((first - words.edge[row]).astype(np.int32))], ["node", "c1", "c2", "place"])

    return docs.select("text").where("text is not null").mapInArrow(run, "node long, c1 long, c2 long, place int")


_SPAN = "struct<start:int,end:int,least:bigint>"


def _judged(met: DataFrame) -> DataFrame:
    """(c1, c2, doc, known, place, h1, h2) from (c1, c2, doc, text, spans): the word ranges that windows inside paths remove, as
    pairs of 32-bit numbers, and the windows that have a repeated anchor but leave its path, with their hashes.

    spans are the paths' places in the text, by start: a path that begins later ends later, so that only the last one that
    begins by a place can reach beyond it.
    """

    def run(batches):
        for rows, data, at in blocks(batches, "text"):
            words = Words(data, at)
            spans = rows.column("spans")
            of = np.repeat(np.arange(len(rows)), np.array(spans.value_lengths()))
            values = spans.flatten()
            start, end = (values.field(n).to_numpy(zero_copy_only=False) + words.edge[of] for n in ("start", "end"))
            least = values.field("least").to_numpy(zero_copy_only=False)
            reach = lambda p, size: (k := np.searchsorted(start, p, "right") - 1, (k >= 0) & (start[k] >= words.edge[words.row[p]]) & (end[k] >= p + size))  # noqa: B023, E731
            p, anchor = words.windows()
            p, anchor = (p, anchor) if len(start) else (p[:0], p[:0])
            path, inside = reach(p, WINDOW)
            doc = rows.column("doc").to_numpy(zero_copy_only=False)
            gone = p[inside & (least[path] < doc[words.row[p]])]
            apart = (gone[1:] > gone[:-1] + WINDOW) | (words.row[gone[1:]] != words.row[gone[:-1]])
            begins, closes = (gone[np.r_[True, apart]], gone[np.r_[apart, True]] + WINDOW) if len(gone) else (gone, gone)
            owner = words.row[begins]
            pairs = np.stack([begins - words.edge[owner], closes - words.edge[owner]], 1).astype(np.int32).ravel()
            known = binaries(pairs, 2 * np.bincount(owner, minlength=words.n))
            open_ = p[~inside & reach(anchor, K)[1]]
            h1, h2 = words.window_hashes(open_)
            count = np.bincount(words.row[open_], minlength=words.n)
            place = (open_ - words.edge[words.row[open_]]).astype(np.int32)
            arrays = [lists(place, count, pa.int32()), lists(h1, count, pa.int64()), lists(h2, count, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("c1", "c2", "doc")], known, *arrays], ["c1", "c2", "doc", "known", "place", "h1", "h2"])

    return met.mapInArrow(run, "c1 long, c2 long, doc long, known binary, place array<int>, h1 array<long>, h2 array<long>")


def _gone(n: int, known: bytes | None, places: np.ndarray) -> np.ndarray:
    """Which of n words known ranges or windows at these places cover."""
    turn = np.zeros(n + 1, np.int64)
    ranges = np.frombuffer(known or b"", np.int32)
    np.add.at(turn, ranges[::2], 1)
    np.add.at(turn, ranges[1::2], -1)
    np.add.at(turn, places, 1)
    np.add.at(turn, places + WINDOW, -1)
    return np.cumsum(turn)[:n] > 0


def _results(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contents of all rows, (c1, c2, least, known, places, text) of contents that lose part of their words)."""
    contents = _contents(docs)
    firsts = contents.where(F.col("n_words") >= WINDOW).groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"))
    met = stored(graph(docs))
    wanted = bit_filter(met, "node")
    path = stored(compacted(met))
    span = F.struct((F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("end")).alias("end"), "least").alias("span")
    placed = _occurrences(docs, wanted).join(path, "node").select("c1", "c2", span)
    placed = placed.groupBy("c1", "c2").agg(F.sort_array(F.collect_set("span")).cast(f"array<{_SPAN}>").alias("spans"))
    texts = _texts(docs, wanted, by_node=True)
    both = texts.join(placed, ["c1", "c2"]).join(firsts, ["c1", "c2"]).groupBy("c1", "c2").agg(F.first("doc").alias("doc"), F.first("text").alias("text"), F.first("spans").alias("spans"))
    judged = stored(_judged(both.select("c1", "c2", "doc", "text", "spans")))
    opened = judged.select("c1", "c2", "doc", F.explode(F.arrays_zip("place", "h1", "h2")).alias("w")).select("c1", "c2", "doc", "w.*")
    # written first, so that the join shuffles both sides and Spark can split a window that very many documents share
    earlier = stored(opened.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"))
    late = opened.join(earlier, ["h1", "h2"]).where("doc > least").groupBy("c1", "c2").agg(F.collect_list("place").alias("places"))
    lost = judged.select("c1", "c2", "known").join(late, ["c1", "c2"], "left").where("length(known) > 0 or places is not null")
    return contents, stored(lost)


def _prepared(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.coalesce(field(docs, doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(field(docs, text).cast("string"), F.lit("")).alias("text"))


def removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of docs: its words (runs of anything but space and the bytes 9 to
    13), how many of them lie in a window of WINDOW words that also starts in a document with a smaller doc_id, and the
    SHA-256 of the others, joined by one space.

    A null text has no words. A null doc_id is larger than any other and stays null; documents with equal ids (repeated rows
    too) take nothing from each other. Extra columns are not looked at.
    """
    source = _prepared(docs, text, doc_id)
    contents, lost = _results(source)
    texts = _texts(source, bit_filter(lost, "c1"), by_node=False)
    parts = lost.join(texts, ["c1", "c2"]).groupBy("c1", "c2").agg(F.first("known").alias("known"), F.first("places").alias("places"), F.first("text").alias("text"))

    def run(batches):
        for rows, data, at in blocks(batches, "text"):
            words = Words(data, at)
            count, digest = [], []
            for k, (known, places) in enumerate(zip(rows.column("known").to_pylist(), rows.column("places"), strict=True)):
                gone = _gone(int(words.size[k]), known, np.array(places.values if places.is_valid else [], np.int64))
                count.append(int(gone.sum()))
                digest.append(hashlib.sha256(words.kept(k, gone)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("c1"), rows.column("c2"), pa.array(count, pa.int64()), pa.array(digest, pa.string())], ["c1", "c2", "gone", "rest"])

    part = parts.select("c1", "c2", "known", "places", "text").mapInArrow(run, "c1 long, c2 long, gone long, rest string")
    firsts = contents.where(F.col("n_words") >= WINDOW).groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"))
    known = stored(firsts.join(part, ["c1", "c2"], "left").where("copies > 1 or gone is not null"))  # so that a hot content is split below
    out = contents.join(known, ["c1", "c2"], "left")
    whole = F.col("doc_id") > F.col("doc")
    return out.select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
    )


#: The DuckDB SQL of removed() over ``documents``.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), p AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW}),
y AS (SELECT r, k, p, sha256(array_to_string(list_slice(w, p, p + {WINDOW - 1}), ' ')) AS h FROM p JOIN d USING (r)),
z AS (SELECT r, k, p, min(k) OVER (PARTITION BY h) AS least FROM y),
g AS (SELECT DISTINCT r, unnest(range(p, p + {WINDOW})) AS i FROM z WHERE least < k),
n AS (SELECT r, count(*) AS gone FROM g GROUP BY r),
v AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM v ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
