"""Joins of groups on their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys of which a null equals a null; b's keys are dropped. Without keys b is one row."""
    if not keys:
        return a.join(F.broadcast(b))
    right = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = a.join(right, reduce(lambda x, y: x & y, [a[k].eqNullSafe(right[f"__{k}"]) for k in keys]), how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"__{k}" for k in keys])
