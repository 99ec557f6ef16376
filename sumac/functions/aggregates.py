"""Reductions of Cells, kept symbolic until a grouping needs them, so that formulas over them can be pooled again.

A Part is one reduction. Its cell over a group is null, with the first input error in text order as its error, if any input
failed. SUM, COUNT, MIN, MAX and AVG parts can be merged from the parts of smaller groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumac.errors import QueryError
from sumac.functions.scalar import Cell, _of, cell, ranged


@dataclass(frozen=True)
class Part:
    """op: count, count_distinct, sum, avg, min, max, median or percentile (at p); input: None counts rows."""

    op: str
    input: Cell | None = None
    p: float | None = None

    def __post_init__(self) -> None:
        if self.op == "percentile" and not (self.p is not None and 0 <= self.p <= 1):
            raise QueryError("invalid_probability", str(self.p))

    def columns(self, name: str) -> list[Column]:
        """What an aggregation computes of it: ``name`` and, of inputs that can fail, ``name__error``; of an average its sum and count."""
        if self.input is None:
            return [F.count("*").cast("double").alias(name)]
        x = self.input.value
        made = {
            "count": lambda: [F.count(x).cast("double").alias(name)],
            "count_distinct": lambda: [F.count_distinct(x).cast("double").alias(name)],
            "sum": lambda: [F.sum(x).alias(name)],
            "avg": lambda: [F.sum(x).alias(f"{name}__sum"), F.count(x).cast("double").alias(f"{name}__count")],
            "min": lambda: [F.min(x).alias(name)],
            "max": lambda: [F.max(x).alias(name)],
            "median": lambda: [F.percentile(x, F.lit(self.probability)).alias(name)],
            "percentile": lambda: [F.percentile(x, F.lit(self.probability)).alias(name)],
        }[self.op]()
        return made if self.input.error is None else [*made, F.min(self.input.error).alias(f"{name}__error")]

    @property
    def probability(self) -> float:
        return 0.5 if self.op == "median" else float(self.p or 0)

    @property
    def names(self) -> tuple[str, ...]:
        return ("__sum", "__count") if self.op == "avg" and self.input is not None else ("",)

    @property
    def additive(self) -> bool:
        return self.op in ("sum", "count")

    def merged(self, name: str, over: Callable[[Column], Column] = lambda c: c) -> list[Column]:
        """The same columns from those of smaller groups; ``over`` may make them window expressions."""
        if self.op not in ("sum", "count", "avg", "min", "max"):
            raise QueryError("not_mergeable", f"{self.op} cannot be combined across groups")
        f = {"min": F.min, "max": F.max}.get(self.op, F.sum)
        made = [over(f(f"{name}{n}")).alias(f"{name}{n}") for n in self.names]
        if self.op == "count":
            made = [F.coalesce(over(F.sum(name)), F.lit(0.0)).alias(name)]
        return made if self.input is None or self.input.error is None else [*made, over(F.min(f"{name}__error")).alias(f"{name}__error")]

    def cell(self, name: str) -> Cell:
        """Of a frame that has the columns."""
        error = None if self.input is None or self.input.error is None else F.col(f"{name}__error")
        value = F.col(name) if self.names == ("",) else F.try_divide(F.col(f"{name}__sum"), F.col(f"{name}__count"))
        return ranged(value, error) if self.op in ("sum", "avg") else _of(value, error)


def count(x=None) -> Part:
    return Part("count", None if x is None else cell(x))


def count_distinct(x) -> Part:
    return Part("count_distinct", cell(x))


def sum_(x) -> Part:
    return Part("sum", cell(x))


def avg(x) -> Part:
    return Part("avg", cell(x))


def min_(x) -> Part:
    return Part("min", cell(x))


def max_(x) -> Part:
    return Part("max", cell(x))


def median(x) -> Part:
    return Part("median", cell(x))


def percentile(x, p: float) -> Part:
    """Exact, interpolated linearly between ranks."""
    return Part("percentile", cell(x), p)
