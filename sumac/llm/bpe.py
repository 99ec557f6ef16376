"""Byte-level BPE by content-defined chunk reuse.

A rolling hash over the last bytes cuts every text into chunks, so that passages which documents share fall into the same
chunks wherever they stand. Where a cut falls, the seam is widened on both sides until each end is a place at which the
pre-tokeniser splits whatever stands around it; between its seams a chunk's inner part is a piece of its own, and the
encodings of pieces and seams agree exactly with that of the whole text, one after another. (A stretch without such places,
a single pre-token, can't be cut and is one seam.)

Pieces that occur more than once in the corpus are found by counting their hashes, encoded once, and joined back to the
documents that they make up the larger part of; seams and other pieces are encoded where they are read, as one where they
adjoin, and so are all other documents.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumac.llm.text import BLOCK, bit_filter, blocks, field, free, in_filter, mix, stored, word_hashes

#: Bytes that the rolling hash sees, the mean length of a chunk (a power of two), and the least length of a piece that is looked up.
WINDOW, MEAN, LEAST = 16, 256, 64
#: The share of a text that pieces which occur more than once must make up for it to be put together from them.
SHARE = 0.5
#: Documents with their parts that a task takes in at a time.
DOCS = 500
#: Fixed value: the pattern by which byte-level BPE files of this kind split text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Of byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """One vocabulary: encode(bytes of a text) and decode(ids), both exactly as the file's own library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are read")
        byte = _byte_of()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]) or any(c.isspace() for x in added for c in x):
            raise ValueError("added tokens must be plain strings without white space")
        ranks = {bytes(byte[c] for c in s): k for s, k in model["vocab"].items() if s not in added}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if model["vocab"][a + b] != 256 + k:
                raise ValueError("ids must follow the order of the merges")
        self.added = {s.encode(): k for s, k in added.items()}
        self._bpe = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        tokens = ranks | self.added
        top = max(tokens.values()) + 1
        piece = [b""] * top
        for s, k in tokens.items():
            piece[k] = s
        #: How ids are written in tables.
        self.kind = "<u2" if top <= 1 << 16 else "<u4"
        self.length = np.array([len(s) for s in piece], np.int64)
        self._start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self._flat = np.frombuffer(b"".join(piece), np.uint8)

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of one text; added tokens' strings in it become those tokens."""
        for mark, k in self.added.items():
            if mark in text:
                parts = [self.encode(x) for x in text.split(mark)]
                gap = np.array([k], np.uint32)
                return np.concatenate([y for x in parts for y in (gap, x)][1:])
        return self._bpe.encode_to_numpy(text.decode("utf-8"))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these tokens, one after another."""
        n = self.length[ids]
        before = np.cumsum(n) - n
        return self._flat[np.repeat(self._start[ids] - before, n) + np.arange(int(n.sum()))]


@functools.cache
def _kinds() -> np.ndarray:
    """The class of each code point: 1 letters, 2 numbers, 3 white space, 4 others, 5 the apostrophe; 0 where versions of Unicode differ."""
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    kind = {"L": 1, "N": 2, "Z": 3}
    made = np.zeros(0x110000, np.uint8)
    for c in map(chr, range(0x110000)):
        if (a := old(c)) == now(c) and a not in ("Cn", "Cs", "Co"):
            made[ord(c)] = kind.get(a[0], 4)
    made[[9, 10, 11, 12, 13]] = 3
    made[[0x85, 0x1C, 0x1D, 0x1E, 0x1F, 0x180E, 0x200B]] = 0  # white space to some and not to others
    made[39] = 5
    return made


def sure_splits(data: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser splits UTF-8 text whatever stands around: where one class of characters ends and another begins.

    Not so before white space's follower, which may take a space along, nor after an apostrophe, which may take letters along.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _kinds()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    before, after = kind[:-1], kind[1:]
    return leads[1:][(before != after) & np.isin(before, (1, 2, 4)) & (after > 0) & ~((before == 4) & (after == 5))]


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges of what is encoded on its own, whether each stretch between them is a chunk's inner part): rows' edges, and about each cut the last sure split before and the first after."""
    n = len(data)
    ends = np.unique(np.concatenate([at, [0, n]]))
    cut = np.concatenate([_cuts(data[k : k + BLOCK + WINDOW]) + k for k in range(0, n - WINDOW, BLOCK)]) if n > WINDOW else np.zeros(0, np.int64)
    sure = np.union1d(sure_splits(data), ends)
    if not len(cut):
        return ends, np.ones(len(ends) - 1, bool)
    left, right = sure[np.searchsorted(sure, cut, "right") - 1], sure[np.searchsorted(sure, cut, "left")]
    edges = np.unique(np.concatenate([ends, left, right]))
    seam = np.zeros(len(edges), bool)
    seam[np.searchsorted(edges, left[left < right])] = True
    return edges, ~seam[:-1]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where the hash of the WINDOW bytes before says so."""
    n = len(data) - WINDOW
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
    total = mix(mix(eight[:n].copy()) + eight[8 : 8 + n])
    return np.flatnonzero(total % np.uint64(MEAN) == 0) + WINDOW


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The worker's copy."""
    return Codec(path)


class Pieces:
    """The pieces of a block, with the hashes of those long enough to be looked up."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.edges, inner = pieces(data, at)
        size = np.diff(self.edges)
        self.row = np.searchsorted(at, self.edges[:-1], "right") - 1
        self.known = np.flatnonzero(inner & (size >= LEAST))
        spans = self.edges[self.known], self.edges[self.known + 1]
        self.h1, self.h2 = word_hashes(data, *spans, seed=11), word_hashes(data, *spans, seed=12)
        self.size = size[self.known]


def counted(texts: DataFrame) -> DataFrame:
    """(h1, h2, size, n) of the pieces of all texts (text): how often each occurs."""

    def run(batches):
        for _, data, at in blocks(batches, "text"):
            p = Pieces(data, at)
            yield pa.RecordBatch.from_arrays([pa.array(p.h1.view(np.int64)), pa.array(p.h2.view(np.int64)), pa.array(p.size)], ["h1", "h2", "size"])

    return texts.select("text").mapInArrow(run, "h1 long, h2 long, size long").groupBy("h1", "h2").agg(F.first("size").alias("size"), F.count("*").alias("n"))


def reuse(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: bytes of all texts, bytes that lie in pieces which occur more than once, and bytes of these pieces when each is encoded once."""
    met = counted(docs.select(field(docs, text).cast("string").alias("text"))).where("n > 1")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(field(docs, text).cast("string"))), F.lit(0)).alias("total"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return total.join(F.broadcast(met.agg(zero(F.col("n") * F.col("size")).alias("shared"), zero("size").alias("encoded"))))  # one row each


def _book(texts: DataFrame, path: str, wanted: np.ndarray) -> DataFrame:
    """(h1, h2, ids) of the pieces that the filter lets pass, each encoded once."""

    def given(batches):
        seen: set[tuple[int, int]] = set()
        for _, data, at in blocks(batches, "text"):
            p, raw, new = Pieces(data, at), data.tobytes(), {}
            for k in np.flatnonzero(in_filter(wanted, p.h1)).tolist():
                key = (int(p.h1[k].view(np.int64)), int(p.h2[k].view(np.int64)))
                if key not in seen:
                    seen.add(key)
                    new[key] = raw[p.edges[p.known[k]] : p.edges[p.known[k] + 1]]
            a, b = ([key[i] for key in new] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(new.values()), pa.binary())], ["h1", "h2", "piece"])

    def encoded(batches):
        for rows in batches:
            ids = [codec(path).encode(x.as_py()) for x in rows.column("piece")]
            yield pa.RecordBatch.from_arrays([rows.column("h1"), rows.column("h2"), pa.array([x.astype(codec(path).kind).tobytes() for x in ids], pa.binary())], ["h1", "h2", "ids"])

    once = texts.select("text").mapInArrow(given, "h1 long, h2 long, piece binary").groupBy("h1", "h2").agg(F.first("piece").alias("piece"))
    return stored(once.mapInArrow(encoded, "h1 long, h2 long, ids binary"))


def _parted(texts: DataFrame, path: str, wanted: np.ndarray, finish, new: list[tuple[str, T.DataType]]) -> DataFrame:
    """(key, refs, local, counts, and the columns ``new``) of the texts (key, text), once in a task. A text without pieces to look up has
    the new columns at once; of others local holds the ids of all other stretches, one after another, and counts says how many
    each stretch has (-1: the next of refs)."""

    def run(batches):
        seen: set[bytes] = set()
        for rows, data, at in blocks(batches, "text"):
            p, raw, own = Pieces(data, at), data.tobytes(), codec(path)
            hit = np.flatnonzero(in_filter(wanted, p.h1))
            shared = np.bincount(p.row[p.known[hit]], p.size[hit], len(rows)) >= SHARE * np.diff(at)
            hit = hit[shared[p.row[p.known[hit]]]]
            first = np.searchsorted(p.row[p.known[hit]], np.arange(len(rows) + 1))
            keys, refs, local, counts, done = [], [], [], [], []
            for r, key in enumerate(rows.column("key").to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                place, found, many = int(at[r]), [], []
                for k in hit[first[r] : first[r + 1]].tolist():
                    i, j = int(p.edges[p.known[k]]), int(p.edges[p.known[k] + 1])
                    if i > place:
                        found.append(own.encode(raw[place:i]))
                        many.append(len(found[-1]))
                    many.append(-1)
                    place = j
                if place < at[r + 1]:
                    found.append(own.encode(raw[place : at[r + 1]]))
                    many.append(len(found[-1]))
                ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
                mine = hit[first[r] : first[r + 1]]
                keys.append(key)
                refs.append([{"nth": n, "h1": int(p.h1[k].view(np.int64)), "h2": int(p.h2[k].view(np.int64))} for n, k in enumerate(mine)] or None)
                local.append(ids.astype(own.kind).tobytes() if len(mine) else None)
                counts.append(many if len(mine) else None)
                done.append(None if len(mine) else ids)
            kinds = pa.list_(pa.struct([("nth", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
            columns = [pa.array(keys, pa.binary()), pa.array(refs, kinds), pa.array(local, pa.binary()), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, *finish(codec(path), done)], ["key", "refs", "local", "counts", *[n for n, _ in new]])

    made = T._parse_datatype_string("key binary, refs array<struct<nth:int,h1:bigint,h2:bigint>>, local binary, counts array<int>")
    return texts.select("key", "text").mapInArrow(run, T.StructType([*made.fields, *[T.StructField(n, t) for n, t in new]]))


def _assembled(parts: DataFrame, path: str, finish, new: list[tuple[str, T.DataType]]) -> DataFrame:
    """(key and the columns ``new``) of (key, local, counts, pieces: the ids of the refs in their order)."""

    def run(batches):
        for rows in batches:
            whole = []
            for local, counts, got in zip(*(rows.column(c) for c in ("local", "counts", "pieces")), strict=True):
                kind = codec(path).kind
                own, place, out, following = np.frombuffer(local.as_buffer(), kind), 0, [], iter(got.values)
                for n in counts.values.to_pylist():
                    if n < 0:
                        out.append(np.frombuffer(next(following).as_buffer(), kind))
                    else:
                        out.append(own[place : place + n])
                        place += n
                whole.append(np.concatenate(out).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([rows.column("key"), *finish(codec(path), whole)], ["key", *[n for n, _ in new]])

    schema = T.StructType([T.StructField("key", T.BinaryType()), *[T.StructField(n, t) for n, t in new]])
    return parts.select("key", "local", "counts", "pieces").mapInArrow(run, schema)


def _coded(docs: DataFrame, path: str, text: str, keep: list[str] | None, finish, new: list[tuple[str, T.DataType]]) -> DataFrame:
    """docs with the columns ``new`` that ``finish`` makes of the ids of each text (None: null columns)."""
    names = [n for n, _ in new]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    whole = F.coalesce(field(docs, text).cast("string"), F.lit(""))
    key = F.unhex(F.md5(whole))
    texts = docs.select(key.alias("key"), whole.alias("text"))
    wanted = bit_filter(counted(texts).where("n > 1"), "h1")
    book = _book(texts, path, wanted)
    found = stored(_parted(texts, path, wanted, finish, new).withColumn("number", F.monotonically_increasing_id()))  # numbered once, in the table
    refs = found.where("refs is not null").select("number", F.explode("refs").alias("r")).select("number", "r.*")
    met = refs.join(book, ["h1", "h2"]).groupBy("number").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "ids"))), lambda x: x["ids"]).alias("pieces"))
    assembled = stored(_assembled(met.join(found.select("number", "key", "local", "counts"), "number"), path, finish, new), DOCS)
    results = found.where("refs is null").select("key", *names).unionByName(assembled).dropDuplicates(["key"])
    rows = docs.select(F.struct(*[field(docs, c) for c in keep]).alias("row"), key.alias("key"))
    return rows.join(results, "key").select(*[F.col("row")[c].alias(c) for c in keep], *names)


def _ids(own: Codec, found: list[np.ndarray | None]) -> list[pa.Array]:
    return [pa.array([None if x is None else x.astype(own.kind).tobytes() for x in found], pa.binary()), pa.array([None if x is None else len(x) for x in found], pa.int64())]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with ids (array of int) and n_tokens (long): the whole text's tokens under the vocabulary file ``path``.

    A null or empty text has no tokens. Repeated rows stay repeated; a column of docs named ids or n_tokens is replaced. Jobs
    run while the result is made.
    """
    new = [("ids", T.BinaryType()), ("n_tokens", T.LongType())]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("ids", "n_tokens")]
    row = F.struct(*[field(docs, c) for c in keep], F.lit(None).cast("int").alias(free("none", keep)))
    coded = _coded(docs.select(row.alias("row"), field(docs, text).cast("string").alias("text")), path, "text", ["row"], _ids, new)
    schema = T.StructType([coded.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        kind = codec(path).kind
        for rows in batches:
            ids = [np.frombuffer(x.as_buffer(), kind).astype(np.int32) for x in rows.column("ids")]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.ListArray.from_arrays(pa.array(ends), flat), rows.column("n_tokens")], schema.names)

    return coded.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in keep], "ids", "n_tokens")


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """coded with decoded (string): the text of its ids, with U+FFFD for bytes that aren't UTF-8; null ids give ''."""
    names = [c for c in coded.columns if c.lower() != "decoded"]
    source = coded.select(*[field(coded, c) for c in names])
    schema = T.StructType([*source.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        for rows in batches:
            got = [codec(path).decode(np.array(x or [], np.int64)).tobytes().decode("utf-8", "replace") for x in rows.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got, pa.string())], schema.names)

    return source.mapInArrow(run, schema)


def _digests(own: Codec, found: list[np.ndarray | None]) -> list[pa.Array]:
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    said = lambda x: own.decode(x.astype(np.int64)).tobytes().decode("utf-8", "replace").encode()
    each = [(None, None, None) if x is None else (len(x), sha(x.astype("<u4").tobytes()), sha(said(x))) for x in found]
    return [pa.array([r[k] for r in each], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the ids as little-endian unsigned 32 bits) and decoded_sha256 (of the text that
    the ids decode to), without moving whole texts' ids between tasks. Nulls, repeated rows and names: as encode()."""
    return _coded(docs, path, text, keep, _digests, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])
