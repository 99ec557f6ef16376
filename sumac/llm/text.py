"""Shared plumbing: Arrow blocks of text, vectorised word and k-gram hashes, tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task works on at once; one longer text is a block of its own.
BLOCK = 1 << 18
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def field(frame: DataFrame, name: str) -> Column:
    """The column called exactly that, dots and all."""
    return frame["`" + name.replace("`", "``") + "`"]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from; a null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may lack it; it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_dir()
    return base.rstrip("/")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="sumac-")


#: The tables that stored() has written and discard() has not deleted yet.
_written: list[str] = []


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """The frame written as Parquet into the shared folder and read again: its lineage is cut, and lost executors cost nothing.

    This runs a job at once. The table stays until discard(). ``rows``: the most that Python tasks of the job take in at a
    time, for rows that are large.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/sumac-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    if rows is not None:
        spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    _written.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def written() -> int:
    """How many tables stored() has written by now and discard() has not deleted."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables that stored() has written since written() was so many; frames over them can't be read any more. ``keep``: files of tables that stay."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs  # the one file system API that reaches any shared folder
    for path in [p for p in _written[since:] if not any(p in k for k in keep)]:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def free(name: str, taken: Iterable[str]) -> str:
    """The name, with as many _ behind it as it takes to differ from all those taken, in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def sheltered(docs: DataFrame, new: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns that have one of the new names (in any case) under other names, and what brings a later frame back to the columns of docs."""
    low = {n.lower() for n in new}
    moved = {c: free(f"own_{c}", [*docs.columns, *new]) for c in docs.columns if c.lower() in low}
    frame = docs.select(*[field(docs, c).alias(moved.get(c, c)) for c in docs.columns])
    return frame, lambda later: later.select(*[field(later, moved.get(c, c)).alias(c) for c in docs.columns])


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their UTF-8 bytes, len(rows) + 1 offsets) of about ``limit`` bytes each; a null text is empty."""
    for batch in batches:
        column = batch.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(column):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = pc.fill_null(column.slice(first, last - first), "").cast(pa.large_string())
            at = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            whole = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None else np.zeros(0, np.uint8)
            yield batch.slice(first, last - first), whole[at[0] : at[-1]], at - at[0]
            first = last
    _give_back()


def _give_back() -> None:
    """Returns what the task has freed to the system: a worker outlives its tasks, and an executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves or not at all
        ctypes.CDLL(None).malloc_trim(0)


def by_block(
    docs: DataFrame,
    make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[pa.Array]],
    new: list[tuple[str, T.DataType]],
    text: str,
    keep: list[str] | None = None,
    limit: int = BLOCK,
) -> DataFrame:
    """docs with the columns ``new`` that ``make`` computes for each block (of about ``limit`` bytes); only ``keep`` (default: all) goes along.

    A column of docs that has the name of a new one gives way to it.
    """
    names = {n.lower() for n, _ in new}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    # plain names on the way, as any column may have any name
    source = docs.select(*[field(docs, c).alias(f"c{k}") for k, c in enumerate(keep)], field(docs, text).cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(f"n{k}", t) for k, (_, t) in enumerate(new)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text", limit):
            made = make(pa.RecordBatch.from_arrays(rows.columns[:-1], keep) if keep else rows, data, at)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *made], schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *[n for n, _ in new])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = 0x9E3779B97F4A7C15


def _seeded(seed: int) -> np.uint64:
    return _U((seed + 1) * 0xD6E8FEB86659FD93 % 2**64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(_STEP) + b)


def run_hashes(values: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``length`` values in a row, one for each place where they fit; values: uint64.

    Runs of 1, 2, 4 ... values are joined pairwise and scrambled at each step, so that no arrangement of values cancels out.
    Hashes under several seeds are independent if their values are (word_hashes under several seeds).
    """
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, span, out, done = values + _seeded(seed), 1, None, 0
    while True:
        if length & span:
            here = part[done : done + n]
            out = here if out is None else _joined(out, here)
            done += span
        if 2 * span > length:
            return mix(out + _U(length))
        part = _joined(part[:-span], part[span:])
        span *= 2


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span: the sum of each value's scramble with its place in the span, scrambled again."""
    size = ends - starts
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    total = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(mix(values[np.repeat(starts, size) + place] + place.astype(np.uint64) * _U(_STEP) + _seeded(seed)), out=total[1:])
    edge = np.concatenate([[0], np.cumsum(size)])
    return mix(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64) + _seeded(seed))


def row_hashes(values: np.ndarray, edge: np.ndarray, seed: int = 0) -> np.ndarray:
    """span_hashes() of the rows between the edges."""
    return span_hashes(values, edge[:-1], edge[1:], seed)


@functools.lru_cache(maxsize=8)
def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93) + _U(seed))


def byte_codes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed random 64-bit code for each byte."""
    return _byte_codes(seed)[data]


def word_spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of each maximal run of bytes that are not white space (space and 9 to 13); no run crosses rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    blank = space[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[at[:-1][at[:-1] < n]] = True
    after[at[1:][at[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


#: Which of eight bytes count where so many are left.
_LEFT = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, in rising order: the sum of its eight-byte pieces, each scrambled with its number, scrambled again.

    Works on stretches of about BLOCK bytes: a very long text takes no more memory.
    """
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        begin, size = starts[first], ends[first:last] - starts[first:last]
        padded = np.zeros(ends[last - 1] - begin + 16, np.uint8)
        padded[:-16] = data[begin : ends[last - 1]]
        pieces = np.maximum(1, (size + 7) >> 3)
        edge = np.cumsum(pieces) - pieces
        number = np.arange(int(pieces.sum())) - np.repeat(edge, pieces)
        at = np.repeat(starts[first:last] - begin, pieces) + 8 * number
        eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))[at]
        eight &= _LEFT[np.minimum(8, np.repeat(size, pieces) - 8 * number)]
        scrambled = mix(eight + number.astype(np.uint64) * _U(_STEP) + _seeded(seed))
        out[first:last] = mix((np.add.reduceat(scrambled, edge) if len(edge) else scrambled) + size.astype(np.uint64) * _U(_STEP) + _seeded(seed))
        first = last
    return out


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list for each count, of as many of the values."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def rows_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column of lists, as arrays that share its memory."""
    whole = column.combine_chunks()
    parts = whole.chunks if isinstance(whole, pa.ChunkedArray) else [whole]
    return [part.values.to_numpy(zero_copy_only=False)[i:j] for part in parts for i, j in zip(part.offsets[:-1].to_pylist(), part.offsets[1:].to_pylist(), strict=True)]


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """As lists(), but the values' bytes as one binary."""
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((at * raw.itemsize).astype(np.int32)), pa.py_buffer(raw.tobytes())])


def bit_filter(frame: DataFrame, column: str, bits: int = 1 << 26) -> np.ndarray:
    """Packed flags of which remainders of a 64-bit column's values occur. Its size is fixed, however many values there are:
    it spares work where they are few, and lets others pass where they are many; whoever asks it joins exactly afterwards."""
    word = F.shiftright(F.col(column).bitwiseAND(F.lit(bits - 1)), 5)
    there = frame.where(F.col(column).isNotNull()).groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 31 as int))")).alias("bits"))
    got = there.toArrow()  # at most bits / 32 rows
    flags = np.zeros(bits // 32, "<u4")
    flags[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint64)
    return flags


def in_filter(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.uint64(32 * len(flags) - 1)
    return (flags[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
