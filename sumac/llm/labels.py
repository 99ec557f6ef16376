"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumac.llm.text import field, held_out


def counts(labels: DataFrame, label: str, doc_id: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of the documents to learn from, once each, and how many have label 0 and 1.

    Held-out documents, null ids, labels other than 0 and 1, and documents that are labelled both ways are left out.
    """
    rows = labels.select(field(labels, doc_id).cast("long").alias("doc_id"), field(labels, label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    return rows, {0: 0, 1: 0} | {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}


def lowest(rows: DataFrame, key: str, wanted: dict[int, int], there: dict[int, int]) -> DataFrame:
    """Of each label about as many rows as wanted: those whose key hashes under a bound (all, if there are no more)."""
    bound = [x for k, n in wanted.items() for x in (F.lit(k), F.lit(int(-(2**63) + min(1.0, n / max(1, there[k])) * (2**64 - 1025))))]
    return rows.where(F.xxhash64(key) <= F.create_map(*bound)[F.col("label")])


def texts(docs: DataFrame, chosen: DataFrame, text: str, doc_id: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """(doc_id, label, text and the extra columns) of the chosen documents, one row for each id; a null text is left out.

    ``chosen`` has at most some thousand rows by its making, and so is broadcast: no other text is moved.
    """
    own = docs.select(field(docs, doc_id).cast("long").alias("doc_id"), field(docs, text).cast("string").alias("text"), *[field(docs, c).alias(c) for c in extra or []])
    met = own.where("text is not null").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min(F.struct("text", *(extra or []))).alias("m")).select("doc_id", "label", "m.*")
