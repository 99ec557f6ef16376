"""A corpus pipeline of five of the training-data operators: from ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of ``documents``, extra ones too, and leave every value as it was but the text and n_chars that redaction changes. Repeated
rows are rows of their own but for near duplicates, and an empty table gives an empty one. run() writes each stage's rows as
Parquet and reads them again for the next; what a stage itself has stored is then deleted.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sumac.llm import bagminhash, bpe, decontaminate, quality, secret_scan
from sumac.llm.text import discard, sheltered, stored, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the factorisation machine, learned from docs and the labels, doesn't reject (score 0.3 or more).

    A null text counts as empty; rows whose doc_id is null or repeated are each judged by their own text.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=("n_chars",))
    frame, back = sheltered(docs, ["score", "predicted"])
    return back(quality.score(frame, model).where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least doc_id; texts that are null or have no words all stay."""
    return bagminhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark; those with a null text hold none."""
    frame, back = sheltered(docs, decontaminate.NEW)
    return back(decontaminate.matches(frame, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows, and a null text stays null."""
    return secret_scan.redacted(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of all documents; a null text has no tokens."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("bpe encoding", bpe_encoding),
]

#: SQL can express neither the classifier nor the signatures; tests/llm hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = written()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
            discard(spark, before, tuple(docs.inputFiles()))
    return docs
