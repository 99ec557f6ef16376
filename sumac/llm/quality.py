"""Quality classifier: a factorisation machine.

Features of a whole text: its words hashed into bins (logarithms of their counts, scaled to length 1), structure
statistics and numeric metadata columns. The score is the logistic function of w0 + sum w_i x_i + sum over pairs
<v_i, v_j> x_i x_j; the pairs take linear time, as half of (sum v_i x_i)^2 - sum (v_i x_i)^2 in each factor.

The machine is trained with numpy on the driver from a bounded sample of labelled documents, weighted back to the
labels' shares; features are computed in the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumac.llm import labels as labelled
from sumac.llm.text import by_block, field, free, lists, rows_of, word_hashes, word_spans

#: Bins of words, factors, and the most documents of each label that are learned from.
BINS, FACTORS, PER_LABEL = 2048, 4, 3_000
#: Structure statistics, in their order.
STATS = ["upper", "lower", "digit", "mark", "symbol", "high", "lines", "word_length", "shouted", "symbol_words", "bars", "repeats",
         "shouted_count", "symbol_count", "bar_count", "repeat_count", "words", "distinct"]
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:'\"!?()-"]] = 4
_CLASS[[ord(c) for c in "#$%&*@|<>{}[]\\^~_=+/`"]] = 5
_CLASS[10] = 7


@dataclass(frozen=True)
class Model:
    """w0, w, v (bins, then statistics, then metadata), and what statistics and metadata are centred and scaled by."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    metadata: tuple[str, ...]


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, value) of the words' bins, and the rows' statistics."""
    n = len(at) - 1
    starts, ends, row = word_spans(data, at)
    hashes = word_hashes(data, starts, ends)
    key, count = np.unique(row * BINS + (hashes >> np.uint64(40)).astype(np.int64) % BINS, return_counts=True)
    r, b, x = key // BINS, key % BINS, np.log1p(count)
    x /= np.sqrt(np.bincount(r, x * x, n))[r] if len(r) else 1

    kind = _CLASS[data]
    per_row, in_word = [], []
    for k in range(8):  # one running count at a time
        s = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        per_row.append(s[at[1:]] - s[at[:-1]])
        in_word.append(s[ends] - s[starts])
    size = np.maximum(1, np.diff(at))
    words = np.bincount(row, minlength=n)
    w = np.maximum(1, words)
    shouted = (in_word[1] >= 2) & (in_word[2] == 0)
    symbols = in_word[5] + (in_word[4] >= 2) >= 2
    bars = (ends - starts == 1) & (data[starts] == 124) if len(starts) else np.zeros(0, bool)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    total = lambda flags: np.bincount(row, flags, n)
    shares = [per_row[k] / size for k in (1, 2, 3, 4, 5, 6, 7)]
    counted = [total(f.astype(float)) for f in (shouted, symbols, bars, again)]
    stats = [*shares, total((ends - starts).astype(float)) / w, *[c / w for c in counted], *[np.log1p(c) for c in counted], np.log1p(words), np.bincount(r, minlength=n) / np.minimum(w, BINS)]
    return r, b, x, np.stack(stats, 1)


def _columns(rows: pa.RecordBatch, metas: list[str]) -> np.ndarray:
    """log1p of the metadata, and which of it is missing."""
    out = []
    for name in metas:
        x = np.array(rows.column(name).to_pylist(), float)
        gone = ~np.isfinite(x)
        out += [np.log1p(np.maximum(0, np.where(gone, 0, x))), gone.astype(float)]
    return np.stack(out, 1) if out else np.zeros((len(rows), 0))


def _with_metadata(docs: DataFrame, metadata: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """docs with the metadata as further columns, and their names."""
    there = {c.lower(): c for c in docs.columns}
    names = [free(f"metadata{k}", docs.columns) for k in range(len(metadata))]
    return docs.withColumns({n: field(docs, there[m.lower()]).cast("double") if m.lower() in there else F.lit(None).cast("double") for n, m in zip(names, metadata, strict=True)}), names


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", metadata: tuple[str, ...] = (), rounds: int = 12, seed: int = 0, most: int = PER_LABEL) -> Model:
    """The machine learned from at most about ``most`` documents of each label, held-out ones left out (labels.counts).

    Without labelled documents it scores every text 0.5; with one label only, close to that label.
    """
    rows, there = labelled.counts(labels, label)
    chosen = labelled.lowest(rows, "doc_id", dict.fromkeys((0, 1), most), there)
    source, metas = _with_metadata(docs, metadata)
    picked = labelled.texts(source, chosen, text, extra=metas)

    def make(rows, data, at):
        r, b, x, stats = features(data, at)
        n = np.bincount(r, minlength=len(rows))
        both = np.concatenate([stats, _columns(rows, metas)], 1)
        return [lists(b.astype(np.int32), n, pa.int32()), lists(x.astype(np.float32), n, pa.float32()), lists(both.ravel(), np.full(len(rows), both.shape[1]), pa.float64())]

    new = [("bins", T.ArrayType(T.IntegerType())), ("values", T.ArrayType(T.FloatType())), ("stats", T.ArrayType(T.DoubleType()))]
    table = by_block(picked, make, new, "text", keep=["doc_id", "label", *metas]).toArrow().sort_by("doc_id")
    width = len(STATS) + 2 * len(metadata)
    if not len(table):
        return Model(0.0, np.zeros(BINS + width), np.zeros((BINS + width, FACTORS)), np.zeros(width), np.ones(width), tuple(metadata))
    bins, values, stats = (rows_of(table[c]) for c in ("bins", "values", "stats"))
    stats = np.array(stats)
    mean, scale = stats.mean(0), stats.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    y = table["label"].to_numpy().astype(float)
    share = there[1] / max(1, there[0] + there[1])
    weight = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))
    rng = np.random.default_rng(seed)
    d = BINS + width
    w0, w, v = np.zeros(1), np.zeros(d), rng.normal(0, 0.01, (d, FACTORS))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w0, w, v)]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 128):
            part = order[k : k + 128]
            x = np.zeros((len(part), d))
            for i, n in enumerate(part):
                x[i, bins[n]] = values[n]
            x[:, BINS:] = _scaled(stats[part], mean, scale)
            inner = x @ v
            z = w0 + x @ w + 0.5 * (inner**2 - (x * x) @ (v * v)).sum(1)
            error = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            slopes = [np.array([error.sum()]), x.T @ error + 1e-4 * w, x.T @ (error[:, None] * inner) - v * ((x * x).T @ error)[:, None] + 1e-3 * v]
            step += 1
            for p, (a, b), g in zip((w0, w, v), moments, slopes, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(float(w0[0]), w, v, mean, scale, tuple(metadata))


def _scaled(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((stats - mean) / scale, -4, 4) / 2


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score (double, 0 to 1: label 1 likelier) and predicted (int, whether the score reaches the threshold).

    A null text counts as empty; empty texts are scored by their statistics. Missing or null metadata counts as missing.
    Repeated rows stay repeated; a column of docs that has the name of a new one is replaced.
    """
    names = docs.columns if keep is None else keep
    source, metas = _with_metadata(docs, model.metadata)

    def make(rows, data, at):
        r, b, x, stats = features(data, at)
        rest = _scaled(np.concatenate([stats, _columns(rows, metas)], 1), model.mean, model.scale)
        n = len(rows)
        z = model.w0 + np.bincount(r, model.w[b] * x, n) + rest @ model.w[BINS:]
        for f in range(FACTORS):
            v = model.v[:, f]
            each = v[b] * x
            inner = np.bincount(r, each, n) + rest @ v[BINS:]
            z += 0.5 * (inner**2 - np.bincount(r, each * each, n) - (rest * rest) @ (v[BINS:] ** 2))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    new = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
    return by_block(source, make, new, text, keep=[*names, *metas]).drop(*metas)
