"""Toxicity by non-negative positive-unlabelled learning.

Learned from confirmed toxic documents and from unlabelled text, a share ``prior`` of which is toxic too. With the loss
l and a linear scorer over which words occur, the risk is prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]):
the unlabelled text stands for the clean one once the toxic share is taken out, and that part is held at 0 or more; where
it falls under, the step goes the other way. Labels of clean documents serve for nothing but the prior.

Features are hashed words and their first 4, 5 and 6 bytes, so that inflected forms of a stem count together. They are
screened first: only bins that confirmed examples hold clearly oftener than unlabelled text get a weight.
Training runs in numpy on the driver over bounded samples; texts are read and scored in the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumac.llm import labels as labelled
from sumac.llm.text import by_block, field, held_out, lists, rows_of, word_hashes, word_spans

#: Bins of features, and the bounds of confirmed and of unlabelled documents.
BINS, CONFIRMED, UNLABELLED = 1 << 20, 2_000, 6_000
#: Lengths of words' beginnings that are features; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6)
#: What screening asks: deviance over the unlabelled rate, and times that rate.
DEVIANCE, TIMES = 16.0, 3.0
_SPLIT = np.ones(256, bool)
_SPLIT[65:91] = _SPLIT[97:123] = _SPLIT[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    """The bins that have weights (ascending), their weights, and the bias."""

    bins: np.ndarray
    weights: np.ndarray
    bias: float


def occurring(data: np.ndarray, at: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of the features of each row, once each, of runs of letters with A to Z as a to z; ``only``: a flag for each bin."""
    low = _LOWER[data]
    starts, ends, row = word_spans(low, at, _SPLIT)
    keys = []
    for k in BEGINNINGS:
        long = ends - starts >= k
        first = starts[long]
        bins = (word_hashes(low, first, np.minimum(first + k, ends[long]) if k else ends[long], seed=k) >> np.uint64(40)).astype(np.int64) % BINS
        own = row[long]
        if only is not None:
            own, bins = own[only[bins]], bins[only[bins]]
        keys.append(own * BINS + bins)
    key = np.unique(np.concatenate(keys))
    return key // BINS, key % BINS


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", confirmed: int = CONFIRMED, others: int = UNLABELLED) -> Model:
    """The model learned from at most about so many confirmed toxic and other documents, held-out ones left out.

    Without confirmed examples nothing gets a weight and every text scores under 0.5.
    """
    rows, there = labelled.counts(labels, label)
    toxic = labelled.lowest(rows.where("label = 1"), "doc_id", {1: confirmed}, there)
    own = docs.select(field(docs, doc_id).cast("long").alias("doc_id"), field(docs, text).cast("string").alias("text"))
    open_ids = own.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("label", F.lit(0))
    # of the ids that hash low enough; none of their labels is looked at
    bound = {0: open_ids.count()}
    unlabelled = own.where("doc_id is not null and text is not null").where(~held_out(F.col("doc_id"))).withColumn("label", F.lit(0))
    unlabelled = labelled.lowest(unlabelled, "doc_id", {0: others}, bound).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    both = labelled.texts(docs, toxic, text, doc_id).unionByName(unlabelled.select("doc_id", "label", "text"))

    def make(rows, data, at):
        r, b = occurring(data, at)
        return [lists(b.astype(np.int32), np.bincount(r, minlength=len(rows)), pa.int32())]

    got = by_block(both, make, [("bins", T.ArrayType(T.IntegerType()))], "text", keep=["doc_id", "label"]).toArrow().sort_by([("label", "ascending"), ("doc_id", "ascending")])
    label, bins = got["label"].to_numpy(), rows_of(got["bins"])
    positive, unlabelled = ([bins[i] for i in np.flatnonzero(label == k)] for k in (1, 0))
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), -2.0)
    prior = min(0.9, max(0.001, there[1] / max(1, there[0] + there[1])))
    return fit(positive, unlabelled, prior)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 800, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Screening and the non-negative risk's descent, on the bins of each document."""
    p, u = (np.bincount(np.concatenate(x), minlength=BINS) for x in (positive, unlabelled))
    n, m = len(positive), len(unlabelled)
    expected = n * (u + 1) / (m + 1)
    deviance = np.where(p > expected, 2 * (p * np.log(np.maximum(p, 1) / expected) - (p - expected)), 0)
    bins = np.flatnonzero((deviance >= DEVIANCE) & (p >= TIMES * expected))
    sides = [held(side, bins) for side in (positive, unlabelled)]
    theta = np.zeros(len(bins) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        clean, whole, part = risks(theta, *sides, prior)
        slope = (whole if clean >= 0 else -part) + decay * np.append(theta[:-1], 0)
        first += 0.1 * (slope - first)
        second += 0.01 * (slope * slope - second)
        theta -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Model(bins, theta[:-1], float(theta[-1]))


Side = tuple[np.ndarray, np.ndarray, int]


def held(docs: list[np.ndarray], bins: np.ndarray) -> Side:
    """(document, number of the bin, documents) of the given bins that each document has."""
    own, every = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs)
    place = np.minimum(np.searchsorted(bins, every), max(0, len(bins) - 1))
    there = bins[place] == every if len(bins) else np.zeros(len(every), bool)
    return own[there], place[there], len(docs)


def risks(theta: np.ndarray, positive: Side, unlabelled: Side, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(the clean part E_U[l(-)] - prior * E_P[l(-)], the slope of prior * E_P[l(+)] and it, the slope of it alone), with l(+) = log(1 + exp(-s)) and l(-) = log(1 + exp(s))."""
    scores = [theta[-1] + np.bincount(d, theta[b], n) for d, b, n in (positive, unlabelled)]
    a, b = (1 / (1 + np.exp(-np.clip(s, -30, 30))) for s in scores)
    mean = lambda side, each: np.append(np.bincount(side[1], each[side[0]], len(theta) - 1), each.sum()) / side[2]
    clean = float(np.logaddexp(0, scores[1]).mean() - prior * np.logaddexp(0, scores[0]).mean())
    part = mean(unlabelled, b) - prior * mean(positive, a)
    return clean, prior * mean(positive, a - 1) + part, part


def score(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score (double, 0 to 1: toxic likelier) and predicted (int, whether the score reaches the threshold).

    A null text counts as empty and gets the bias's score, as any text without weighed words. Repeated rows stay
    repeated; a column of docs that has the name of a new one is replaced.
    """

    def make(rows, data, at):
        weight = np.zeros(BINS)
        weight[model.bins] = model.weights
        r, b = occurring(data, at, weight != 0)
        z = model.bias + np.bincount(r, weight[b], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return by_block(docs, make, [("score", T.DoubleType()), ("predicted", T.IntegerType())], text, keep)
