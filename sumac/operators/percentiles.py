"""Exact percentiles of groups of any size.

Spark's exact percentile keeps a group's distinct values in one aggregation buffer. Here a sketch of fixed size first bounds
each percentile from below and above. One more aggregation then counts what lies outside these bounds, and each value
between them, a small share of the group; ranks are looked up in the running counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumac.operators.joins import same

#: The sketch's accuracy (its ranks are off by rows / ACCURACY at most), and rows up to which all values of a group are counted.
ACCURACY, SMALL = 10_000, 10_000


def exact_percentiles(rows: DataFrame, names: list[str], x: Column, probabilities: list[float], more: dict[str, Column] | None = None) -> DataFrame:
    """(names, more, q) of each group: further aggregations of its rows, and the percentiles of x, interpolated between ranks (null where x always is)."""
    more, wanted = more or {}, sorted(set(probabilities))
    reach = 4 / ACCURACY
    ends = [F.lit(float(p)) for q in wanted for p in (max(0.0, q - reach), min(1.0, q + reach))]
    value = x.cast("double")
    sketch = rows.groupBy(*names).agg(*[c.alias(n) for n, c in more.items()], F.count(value).alias("__n"), F.percentile_approx(value, F.array(*ends), F.lit(ACCURACY)).alias("__ends"))
    met = same(rows.select(*names, value.alias("__x")), sketch, names, "inner")
    v, lows, highs = F.col("__x"), [F.col("__ends")[2 * k] for k in range(len(wanted))], [F.col("__ends")[2 * k + 1] for k in range(len(wanted))]
    # bounds at or under x, and bounds that x is beyond: both rise with x, so that their sum orders the stretches between bounds
    stretch = reduce(lambda a, b: a + b, [c.cast("int") for low, high in zip(lows, highs, strict=True) for c in (v >= low, v > high)])
    between = reduce(lambda a, b: a | b, [v.between(low, high) for low, high in zip(lows, highs, strict=True)])
    small, carried = F.col("__n") <= SMALL, ["__n", *more]
    parts = met.select(*names, *carried, v, F.when(small, 0).otherwise(stretch).alias("__stretch"), F.when(small | between, v).alias("__at"))
    counted = parts.groupBy(*names, "__stretch", "__at").agg(F.count("__x").alias("__c"), *[F.first(c).alias(c) for c in carried])
    upto = F.sum("__c").over(Window.partitionBy(*(names or [F.lit(0)])).orderBy("__stretch", "__at"))
    placed = counted.withColumn("__upto", upto)
    ranks = {p: (F.col("__n") - 1) * float(p) for p in wanted}
    holds = lambda rank: F.max(F.when((rank >= F.col("__upto") - F.col("__c")) & (rank < F.col("__upto")), F.col("__at")))
    found = {f"__{end}{k}": holds(f(ranks[p])) for k, p in enumerate(wanted) for end, f in (("a", F.floor), ("b", F.ceil))}
    got = placed.groupBy(*names).agg(*[F.first(c).alias(c) for c in carried], *[c.alias(n) for n, c in found.items()])
    share = {p: ranks[p] - F.floor(ranks[p]) for p in wanted}
    each = {p: (1 - share[p]) * F.col(f"__a{k}") + share[p] * F.col(f"__b{k}") for k, p in enumerate(wanted)}
    got = got.select(*names, *more, F.when(F.col("__n") > 0, F.array(*[each[p] for p in probabilities])).alias("q"))
    if names:
        return got
    none = rows.limit(0).agg(*[c.alias(f"__{n}") for n, c in more.items()], F.lit(1))  # what the others are of no rows
    return got.join(F.broadcast(none)).select(*[F.coalesce(n, f"__{n}").alias(n) for n in more], "q")
