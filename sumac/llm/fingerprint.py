"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over the last WINDOW bytes; a byte whose hash ends in at least L zero bits ends a piece at block size 2^L.
L is the least level with at most LONGEST pieces. Each piece's hash gives one of 64 letters; the fingerprint holds the
letters at L and at L + 1, ``L:letters:letters``. Two fingerprints are compared by edit distance at a block size that
both have: likeness 1 - distance / longer length, or 0 where no size is shared or no run of letters is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumac.llm.text import BLOCK, by_block, byte_codes, field, stored, word_hashes

WINDOW, LONGEST = 7, 64
#: Letters in a row that two different signatures must share (half of a shorter one) to be alike at all.
SHARED = 4
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_TURNS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1) for k in range(WINDOW)]


def fingerprint(text: bytes) -> str:
    """The fingerprint of one text in UTF-8; the empty text's is ``0::``."""
    n = len(text)
    if not n:
        return "0::"
    data = np.frombuffer(text, np.uint8)
    zeros = np.concatenate([_zeros(data[max(0, k - WINDOW + 1) : k + BLOCK])[min(k, WINDOW - 1) :] for k in range(0, n, BLOCK)])
    reach = np.bincount(zeros, minlength=66)[::-1].cumsum()[::-1]
    level = int(np.argmax(reach < LONGEST))
    ends = np.flatnonzero(zeros >= level) + 1
    signs = []
    for at in (ends, ends[zeros[ends - 1] > level]):
        if not len(at) or at[-1] != n:
            at = np.append(at, n)
        begins = np.concatenate([[0], at[:-1]])
        signs.append(_LETTERS[(word_hashes(data, begins, at) >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return f"{level}:{signs[0]}:{signs[1]}"


def _zeros(data: np.ndarray) -> np.ndarray:
    """How many zero bits the hash of each byte and its predecessors ends in (64: all)."""
    codes = byte_codes(data)
    rolled = codes * _TURNS[0]
    for k in range(1, min(WINDOW, len(data))):
        rolled[k:] += codes[:-k] * _TURNS[k]
    rolled ^= rolled >> np.uint64(32)
    return np.bitwise_count((rolled & (~rolled + np.uint64(1))) - np.uint64(1))


def distance(a: str, b: str) -> int:
    """Levenshtein distance, by bit vectors over ``a``."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, at = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        same = eq | down
        turn = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(turn | up) & full, up & turn
        at += bool(rise & top) - bool(fall & top)
        rise = rise << 1 | 1
        fall = fall << 1
        up, down = (fall | ~(same | rise)) & full, rise & same & full
    return at


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = max(1, min(SHARED, min(len(a), len(b)) // 2))
    if {a[k : k + run] for k in range(len(a) - run + 1)}.isdisjoint(b[k : k + run] for k in range(len(b) - run + 1)):
        return 0.0
    return 1 - distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; equal fingerprints give 1."""
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    i, j = int(n), int(m)
    if i == j:
        return _alike(a1, b1)
    return _alike(a2, b1) if j == i + 1 else _alike(a1, b2) if i == j + 1 else 0.0


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with fingerprint (string) of each whole text. A null text counts as empty; a column fingerprint is replaced."""

    def make(rows, data, at):
        raw = data.tobytes()
        return [pa.array([fingerprint(raw[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.string())]

    return by_block(docs, make, [("fingerprint", T.StringType())], text, keep)


def likenesses(pairs: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """pairs with the likeness (double) of the fingerprints in columns a and b; null where either is null."""
    source = pairs.select(*[field(pairs, c) for c in pairs.columns if c.lower() != out.lower()])
    schema = T.StructType([*source.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            both = zip(rows.column(a).to_pylist(), rows.column(b).to_pylist(), strict=True)
            got = pa.array([None if x is None or y is None else likeness(x, y) for x, y in both], pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns, got], schema.names)

    return source.mapInArrow(run, schema)


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(doc_id: object, text: str, own: str, following: str, next_own: str) -> dict:
    half = len(text) // 2
    new = (text[: len(text) - half] + following[:half]).encode()
    print_ = own if new == text.encode() else fingerprint(new)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new).hexdigest(), "fingerprint": own,
        "edited_fingerprint": print_, "near_edited": likeness(own, print_), "near_next": likeness(own, next_own),
    }


def edited_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document beside its edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document, in descending doc_id, the first following the last.

    One range shuffle puts the documents in order; each task pairs neighbours as they pass and leaves over only its first
    and its last document, which a join by partition number pairs. A null text is empty; null ids come last; among equal
    ids the text's hash decides; a sole document follows itself.
    """
    source = docs.select(field(docs, doc_id).cast("long").alias("doc_id"), F.coalesce(field(docs, text).cast("string"), F.lit("")).alias("text"))
    keys = [F.desc_nulls_last("doc_id"), F.desc("tie")]
    ranged = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = T._parse_datatype_string(f"kind string, part int, {_EDITED}, text string")
    arrow = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        part = 0
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                row_id, words, part = (batch.column(c)[k].as_py() for c in range(3))
                own = fingerprint(words.encode())
                if last is None:
                    out.append({"kind": "head", "part": part, "text": words, "fingerprint": own})
                else:
                    out.append({"kind": "done", "part": part} | _edited(*last, words, own))
                last = (row_id, words, own)
                size += 1
            if size:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"kind": "tail", "part": part, "doc_id": last[0], "text": last[1], "fingerprint": last[2]}], arrow)

    passed = stored(ranged.mapInArrow(run, schema))
    heads = passed.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"), F.col("fingerprint").alias("next_own"))
    order = Window.orderBy("next_part")  # over one small row for each partition
    numbers = heads.select("next_part").select(F.col("next_part").alias("part"), F.lead("next_part").over(order).alias("after"), F.min("next_part").over(order).alias("least"))
    tails = passed.where("kind = 'tail'").select("part", "doc_id", "text", "fingerprint")
    tails = tails.join(numbers.select("part", F.coalesce("after", "least").alias("next_part")), "part").join(heads, "next_part")
    names = _EDITED.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    short = T._parse_datatype_string(_EDITED)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            got = [_edited(r["doc_id"], r["text"], r["fingerprint"], r["following"], r["next_own"]) for r in rows.to_pylist()]
            yield pa.RecordBatch.from_pylist(got, pa.schema([arrow.field(n) for n in names]))

    closed = tails.select("doc_id", "text", "fingerprint", "following", "next_own").mapInArrow(close, short)
    return passed.where("kind = 'done'").select(*names).unionByName(closed)
