"""The queries opN_<name> over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumac.llm import bagminhash, bpe, debruijn, decontaminate, fingerprint, language_id, quality, secret_scan, toxicity, url_filter
from sumac.llm.text import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the labelled four fifths."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~held_out(F.col("doc_id")))
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the labelled four fifths."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    found = quality.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates."""
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the confirmed examples of the labelled four fifths and unlabelled text."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, or else by the model."""
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(), keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def op6_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words less those of windows that a document with a smaller id has too."""
    return debruijn.removed(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold an item of the benchmark, each with its best match."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.where("contaminated").drop("contaminated")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, strong ones and linked weak ones."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("found")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's BPE tokens, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside that of its edited text."""
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_bagminhash": op3_bagminhash,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_debruijn": op6_debruijn,
    "op7_decontaminate": op7_decontaminate,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe": op9_bpe,
    "op10_fingerprint": op10_fingerprint,
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": url_filter.sql(url_filter.train()),
    "op6_debruijn": debruijn.SQL,
    "op8_secret_scan": secret_scan.SQL,
}
