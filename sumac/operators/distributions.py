"""Distributions by group: box plots, histograms over shared edges, and quantile curves. All are exact."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumac.errors import QueryError
from sumac.functions.scalar import Cell
from sumac.functions.stats import edge, edges
from sumac.operators.grouping import Key, key_column
from sumac.operators.joins import same
from sumac.operators.metrics import population
from sumac.operators.percentiles import exact_percentiles
from sumac.schema import Dataset, FieldSchema

#: Fixed value: how many outliers of each end are listed once there are more than twice as many.
LISTED = 10


@dataclass(frozen=True)
class Box:
    """whiskers: minmax, tukey (the outermost values within 1.5 times the quartiles' distance) or percentile."""

    whiskers: str = "minmax"
    probabilities: tuple[float, float] = (0.1, 0.9)

    def __post_init__(self) -> None:
        low, high = self.probabilities
        if self.whiskers not in ("minmax", "tukey", "percentile") or not (0 <= low < 0.25 and 0.75 < high <= 1):
            raise QueryError("invalid_whiskers", f"{self.whiskers} {self.probabilities}")


def _sampled(frame: DataFrame | Dataset, schema: FieldSchema, keys: tuple[Key, ...], where: tuple[dict, ...], x: Cell, now: datetime | None) -> tuple[DataFrame, list[str]]:
    """(keys, x, failed): the input of each row, null where it fails."""
    rows = population(frame, schema, where, now or datetime.now(UTC))
    names = [f"group{k}" for k in range(len(keys))]
    failed = F.lit(False) if x.error is None else x.error.isNotNull()
    return rows.select(*[key_column(schema, k).alias(n) for k, n in zip(keys, names, strict=True)], x.value.alias("x"), failed.alias("failed")), names


def _counts() -> dict[str, Column]:
    return {"count": F.count("*"), "n": F.count("x"), "null_count": F.count_if(F.col("x").isNull() & ~F.col("failed")), "input_error_count": F.count_if("failed")}


def box(frame: DataFrame | Dataset, schema: FieldSchema, x: Cell, keys: tuple[Key, ...] = (), spec: Box = Box(), where: tuple[dict, ...] = (), now: datetime | None = None) -> DataFrame:
    """(keys, count, n, null_count, input_error_count, min, q1, median, q3, max, mean, low, high, outlier_count, outliers).

    The outliers are listed whole up to 2 * LISTED of them, beyond that LISTED of each end.
    """
    return box_of(*_sampled(frame, schema, keys, where, x, now), spec)


def box_of(rows: DataFrame, names: list[str], spec: Box) -> DataFrame:
    """box() of rows (names, x, failed) that are there already."""
    p = [0.25, 0.5, 0.75, *(spec.probabilities if spec.whiskers == "percentile" else [])]
    base = exact_percentiles(rows, names, F.col("x"), p, _counts() | {"min": F.min("x"), "max": F.max("x"), "mean": F.avg("x")})
    quartiles = [F.col("q")[k].alias(c) for k, c in enumerate(("q1", "median", "q3", "p_low", "p_high")[: len(p)])]
    base = base.select(*names, "count", "n", "null_count", "input_error_count", "min", "max", F.least("max", F.greatest("min", "mean")).alias("mean"), *quartiles)
    stats = ["count", "n", "null_count", "input_error_count", "min", "q1", "median", "q3", "max", "mean"]
    none = F.when(F.col("n") > 0, F.array().cast("array<double>"))
    if spec.whiskers == "minmax":
        return base.select(*names, *stats, F.col("min").alias("low"), F.col("max").alias("high"), F.lit(0).cast("long").alias("outlier_count"), none.alias("outliers"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fence = (F.col("q1") - reach, F.col("q3") + reach) if spec.whiskers == "tukey" else (F.col("p_low"), F.col("p_high"))
    carried = [*stats, *(["p_low", "p_high"] if spec.whiskers == "percentile" else [])]
    held = same(rows.select(*names, "x"), base.select(*names, *carried, fence[0].alias("from"), fence[1].alias("to")), names, "inner")
    beyond = F.when(~F.col("x").between(F.col("from"), F.col("to")), F.col("x"))
    # the values inside as one row, each one outside with how often it occurs: counts, ends and lists all come from these
    first = [F.first(c).alias(c) for c in carried]
    values = held.withColumn("beyond", beyond).groupBy(*names, "beyond").agg(F.count("x").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"), *first)
    outside, aggs = F.col("beyond").isNotNull(), []
    if spec.whiskers == "tukey":
        by = lambda o: F.row_number().over(Window.partitionBy(*(names or [F.lit(0)])).orderBy(o))
        values = values.withColumns({"up": by(F.asc_nulls_last("beyond")), "down": by(F.desc_nulls_last("beyond"))})
        again = lambda r, n: F.collect_list(F.when(outside & (F.col(r) <= n), F.array_repeat("beyond", F.least(F.col("c"), F.lit(n)).cast("int"))))
        aggs = [F.sort_array(F.flatten(again("up", 2 * LISTED))).alias("lowest"), F.sort_array(F.flatten(again("down", LISTED))).alias("highest")]
    inside = [F.min(F.when(~outside, F.col("least"))).alias("in_low"), F.max(F.when(~outside, F.col("most"))).alias("in_high")]
    out = values.groupBy(*names).agg(*first, *inside, F.coalesce(F.sum(F.when(outside, F.col("c"))), F.lit(0)).alias("outlier_count"), *aggs)
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in _counts()})  # without keys and rows there is one group of none
    if spec.whiskers == "percentile":
        return out.select(*names, *stats, F.col("p_low").alias("low"), F.col("p_high").alias("high"), "outlier_count", none.alias("outliers"))
    listed = F.when(F.col("outlier_count") <= 2 * LISTED, F.col("lowest")).otherwise(F.concat(F.slice("lowest", 1, LISTED), F.slice("highest", -LISTED, LISTED)))
    return out.select(*names, *stats, F.col("in_low").alias("low"), F.col("in_high").alias("high"), "outlier_count", F.when(F.col("n") > 0, listed).alias("outliers"))


def histogram(frame: DataFrame | Dataset, schema: FieldSchema, x: Cell, keys: tuple[Key, ...] = (), bins: int = 10, where: tuple[dict, ...] = (), now: datetime | None = None) -> DataFrame:
    """(keys, count, n, null_count, input_error_count, edges, counts): the edges span all rows; a bin holds its lower edge, the
    last one both. Edges and counts are null where the range is finer than the numbers' precision."""
    if len(keys) > 1:
        raise QueryError("too_many_keys", "a histogram takes one")
    rows, names = _sampled(frame, schema, keys, where, x, now)
    extent = rows.agg(F.min("x").alias("from"), F.max("x").alias("to"))  # one row
    low, high, v = F.col("from"), F.col("to"), F.col("x")
    # where x lies by its share of the range, set right by the edges themselves
    about = F.when(high > low, F.least(F.lit(bins - 1.0), F.floor((v - low) / (high - low) * bins).cast("double"))).otherwise(0.0)
    right = about + ((about < bins - 1) & (v >= edge(low, high, bins, about + 1))).cast("int") - (v < edge(low, high, bins, about)).cast("int")
    bin_ = F.when(v.isNotNull(), F.when(high > low, right).otherwise(0).cast("int"))
    got = rows.join(F.broadcast(extent)).withColumn("bin", bin_).groupBy(*names).agg(*[c.alias(n) for n, c in _counts().items()], F.max("from").alias("from"), F.max("to").alias("to"), *[F.count_if(F.col("bin") == k).alias(f"c{k}") for k in range(bins)])
    counts, cuts = F.array(*[F.col(f"c{k}") for k in range(bins)]), edges(low, high, bins)
    return got.withColumn("edges", cuts).select(*names, "count", "n", "null_count", "input_error_count", "edges", F.slice(counts, F.lit(1), F.greatest(F.lit(0), F.size("edges") - 1)).alias("counts"))


def quantiles(frame: DataFrame | Dataset, schema: FieldSchema, x: Cell, probabilities: list[float], keys: tuple[Key, ...] = (), where: tuple[dict, ...] = (), now: datetime | None = None) -> DataFrame:
    """(keys, count, n, null_count, input_error_count, values, median): the exact percentiles, interpolated between ranks."""
    if not 1 <= len(probabilities) <= 101 or any(b <= a for a, b in zip(probabilities, probabilities[1:])) or not 0 <= probabilities[0] <= probabilities[-1] <= 1:
        raise QueryError("invalid_probability", "1 to 101 rising probabilities")
    rows, names = _sampled(frame, schema, keys, where, x, now)
    got = exact_percentiles(rows, names, F.col("x"), [*probabilities, 0.5], _counts())
    return got.select(*names, "count", "n", "null_count", "input_error_count", F.slice("q", 1, len(probabilities)).alias("values"), F.element_at("q", -1).alias("median"))
