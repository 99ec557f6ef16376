"""Metrics: formulas over reductions, by groups, with filters, minimums, calendar buckets, top groups and their remainder.

A metric is one aggregation over its rows; everything after works on the groups. A group's columns are group0, group1 ...,
value, error, count, and by what is asked y, lower, upper, interval_error, intervals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumac.errors import QueryError
from sumac.functions import calendar
from sumac.functions.aggregates import Part
from sumac.functions.operands import at_millis, millis
from sumac.functions.scalar import Cell, cell
from sumac.functions.stats import garwood, wilson
from sumac.operators.filters import condition, of_dataset
from sumac.operators.grouping import Calendar, Key, key_column
from sumac.operators.joins import same
from sumac.operators.percentiles import exact_percentiles
from sumac.schema import Dataset, FieldSchema

Formula = Callable[[dict[str, Cell]], Cell]


@dataclass(frozen=True)
class Fill:
    """Buckets for intervals without rows: over the observed range, or from start up to end (not included)."""

    start: datetime | None = None
    end: datetime | None = None


@dataclass(frozen=True)
class Interval:
    """A confidence interval of scale * numerator / denominator, which are names of parts: a ``proportion`` or a ``rate``."""

    kind: str
    numerator: str
    denominator: str
    level: float = 0.95
    scale: float = 1.0


@dataclass(frozen=True)
class Trailing:
    """Values over the last ``periods`` buckets (None: over all so far): ``total`` merges the parts, ``mean`` averages the
    buckets' values with empty ones as 0. Without ``partial``, windows that reach before the first bucket are null."""

    periods: int | None
    reduce: str = "total"
    partial: bool = False


@dataclass(frozen=True)
class Sort:
    """key: value, y, count or groupN."""

    key: str
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class Metric:
    parts: dict[str, Part]
    value: Formula | None = None
    y: Formula | None = None
    group_by: tuple[Key, ...] = ()
    where: tuple[dict, ...] = ()
    #: Groups of fewer rows, distinct values or a smaller sum than this are hidden: n, ("distinct", field, n) or ("sum", field, n).
    min_count: int | tuple[str, str, float] | None = None
    sort: tuple[Sort, ...] = ()
    group_limit: int | None = None
    other: bool = False
    fill: Fill | None = None
    interval: Interval | None = None
    trailing: Trailing | None = None
    share: str | None = None
    extra: tuple[Column, ...] = field(default=())

    @property
    def sole(self) -> Part | None:
        return next(iter(self.parts.values())) if self.value is None and len(self.parts) == 1 else None

    def formula(self) -> Formula:
        if self.value is not None:
            return self.value
        if self.sole is None:
            raise QueryError("missing_formula", "several parts need a formula")
        return lambda p: next(iter(p.values()))

    def keys(self) -> list[str]:
        return [f"group{k}" for k in range(len(self.group_by))]


@dataclass(frozen=True)
class Result:
    """buckets: the groups in order, after the limit; facts: one row of group_count (groups before the limit, hidden ones not
    counted), hidden_groups and processed_rows; other: the remainder beyond the limit, in the buckets' columns, or None."""

    buckets: DataFrame
    facts: DataFrame
    other: DataFrame | None = None
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Frees the groups that were kept because more than one of the frames reads them."""
        for frame in self.held:
            frame.unpersist()


def population(rows: DataFrame | Dataset, schema: FieldSchema, terms: tuple[dict, ...] | list[dict], now: datetime) -> DataFrame:
    """The rows that the terms admit; a dataset's relation is asked first, so that its scan can skip by them."""
    if isinstance(rows, Dataset):
        return of_dataset(rows, list(terms), now)
    return rows.where(condition(schema, list(terms), now)) if terms else rows


def _minimum(schema: FieldSchema, metric: Metric) -> tuple[Column, float]:
    if not metric.group_by:
        raise QueryError("invalid_min_count", "a minimum needs a grouping")
    if isinstance(metric.min_count, int):
        return F.count("*"), metric.min_count
    kind, name, least = metric.min_count
    f = schema.field(name)
    c = F.col(f"`{f.name}`")
    if kind == "distinct":
        return F.count_distinct(c), least
    if kind != "sum" or f.kind != "number":
        raise QueryError("invalid_min_count", f"{kind} of {f.name}")
    return F.coalesce(F.sum(c), F.lit(0.0)), least


def grouped(frame: DataFrame | Dataset, schema: FieldSchema, metric: Metric, now: datetime) -> DataFrame:
    """The groups with their parts: one aggregation, and for medians and percentiles two more of each input that they have."""
    ranked = {n: p for n, p in metric.parts.items() if p.op in ("median", "percentile")}
    aggs = [F.count("*").alias("count"), *metric.extra]
    for name, part in metric.parts.items():
        aggs += part.columns(f"p_{name}")[name in ranked :]
    if metric.min_count is not None:
        aggs.append(_minimum(schema, metric)[0].alias("measure"))
    rows, keys = population(frame, schema, metric.where, now), metric.keys()
    if keys:
        rows = rows.select("*", *[key_column(schema, k).alias(n) for k, n in zip(metric.group_by, keys, strict=True)])
    inputs: dict[str, list[str]] = {}
    for name, part in ranked.items():
        inputs.setdefault(str(part.input.value), []).append(name)
    got = rows.groupBy(*keys).agg(*aggs)
    others = got.columns[len(keys) :]
    for k, names in enumerate(inputs.values()):
        # the first input's readings carry the other parts along, unless they are text
        more = dict(zip(others, aggs, strict=True)) if k == 0 and "string" not in dict(got.dtypes[len(keys) :]).values() else {}
        q = exact_percentiles(rows, keys, ranked[names[0]].input.value, [ranked[n].probability for n in names], more)
        found = q.select(*keys, *more, *[F.col("q")[i].alias(f"p_{n}") for i, n in enumerate(names)])
        got = found if more else same(got, found, keys, "left")
    return got


def completed(groups: DataFrame, metric: Metric) -> DataFrame:
    """The groups and, for each tuple of the other keys that occurs, a bucket for each interval (or slot) of the range; such
    a bucket has 0 rows, and 0 as each COUNT, COUNT_DISTINCT or SUM."""
    first = metric.group_by[0]
    if not isinstance(first, Calendar):
        raise QueryError("invalid_fill", "the first key must be a calendar one")
    spark, keys = groups.sparkSession, metric.keys()
    if first.interval in calendar.CYCLES:
        slots = spark.createDataFrame([(float(k),) for k in calendar.CYCLES[first.interval]], "group0 double")
    else:
        low, high = _bounds(groups, metric.fill)
        found = [] if low is None else calendar.starts(low, high, first.interval, first.zone, first.every)
        slots = spark.createDataFrame([(t,) for t in found], "ms long").select(F.timestamp_millis("ms").alias("group0"))
    tails = groups.select(*keys[1:]).distinct() if keys[1:] else None
    dense = slots if tails is None else tails.crossJoin(F.broadcast(slots))  # at most 10,000 slots, by calendar.starts
    missing = same(dense, groups.select(*keys), keys, "left_anti").withColumn("count", F.lit(0).cast("long"))
    zero = {f"p_{n}": F.lit(0.0) for n, p in metric.parts.items() if p.op in ("count", "count_distinct", "sum")}
    return groups.withColumn("filled", F.lit(False)).unionByName(missing.withColumns({**zero, "filled": F.lit(True)}), allowMissingColumns=True)


def _bounds(groups: DataFrame, fill: Fill | None) -> tuple[int | None, int]:
    ms = lambda d: int((d - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1000)
    if fill and fill.start and fill.end:
        return ms(fill.start), ms(fill.end) - 1
    seen = groups.agg(F.min(F.unix_millis("group0")), F.max(F.unix_millis("group0"))).collect()[0]
    return seen[0], seen[1] or 0


def _evaluated(groups: DataFrame, metric: Metric) -> DataFrame:
    cells = {n: p.cell(f"p_{n}") for n, p in metric.parts.items()}
    got = cell(metric.formula()(cells))
    none = F.lit(None).cast("string")
    new = {"value": got.value, "error": none if got.error is None else got.error}
    if metric.y is not None:
        y = metric.y(cells)
        new |= {"y": y.value, "error": F.coalesce(new["error"], none if y.error is None else y.error)}
    if metric.interval is not None:
        new |= _interval(metric.interval, cells[metric.interval.numerator].value, cells[metric.interval.denominator].value)
    filled = "filled" in groups.columns
    out = groups.withColumns(new)
    if filled and metric.sole is None:  # only a direct count or sum of nothing is 0
        out = out.withColumn("value", F.when(~F.col("filled"), F.col("value")))
    return out


def _interval(i: Interval, events: Column, units: Column) -> dict[str, Column]:
    whole = events == F.floor(events)
    if i.kind == "proportion":
        fits = whole & (events >= 0) & (units == F.floor(units)) & (events <= units)
        low, high = wilson(F.when(fits, events), F.when(fits, units), i.level)
    elif i.kind == "rate":
        fits = whole & (events >= 0) & (units > 0)
        low, high = garwood(F.when(fits, events), i.level)
        low, high = F.try_divide(low, units), F.try_divide(high, units)
    else:
        raise QueryError("invalid_interval", i.kind)
    there = events.isNotNull() & units.isNotNull() & (units != 0)
    return {"lower": F.when(there & fits, low * i.scale), "upper": F.when(there & fits, high * i.scale), "interval_error": F.when(there & ~fits, F.lit("interval_domain"))}


def _trailed(groups: DataFrame, metric: Metric) -> DataFrame:
    t = metric.trailing
    keys = metric.keys()
    if metric.fill is None or not isinstance(metric.group_by[0], Calendar) or metric.group_by[0].interval in calendar.CYCLES:
        raise QueryError("invalid_window", "a window needs filled calendar buckets")
    if t.periods is not None and not 2 <= t.periods <= 1000:
        raise QueryError("invalid_window", str(t.periods))
    window = Window.partitionBy(*keys[1:]).orderBy("group0").rowsBetween(Window.unboundedPreceding if t.periods is None else 1 - t.periods, 0)
    over = lambda c: c.over(window)
    dated = groups.where(F.col("group0").isNotNull())
    if t.reduce == "mean":
        if metric.sole is None or metric.sole.op not in ("sum", "count", "count_distinct"):
            raise QueryError("invalid_window", "a mean needs one SUM, COUNT or COUNT_DISTINCT")
        merged = dated.select(*keys, "filled", over(F.sum("count")).alias("count"), over(F.count("*")).alias("intervals"), *[over(F.avg(F.coalesce(F.col(f"p_{n}"), F.lit(0.0)))).alias(f"p_{n}") for n in metric.parts])
        merged = merged.withColumns({f"p_{n}__error": F.lit(None).cast("string") for n, p in metric.parts.items() if p.input is not None and p.input.error is not None})
    else:
        columns = [c for n, p in metric.parts.items() for c in p.merged(f"p_{n}", over)]
        merged = dated.select(*keys, F.lit(False).alias("filled"), over(F.sum("count")).alias("count"), over(F.count("*")).alias("intervals"), *columns)
    out = _evaluated(merged, metric)
    if t.periods is not None and not t.partial:
        out = out.withColumn("value", F.when(F.col("intervals") == t.periods, F.col("value")))
    return out


def _shared(groups: DataFrame, metric: Metric) -> DataFrame:
    """Each value over the total of all groups, or of those with the same first key."""
    if metric.sole is None or not metric.sole.additive:
        raise QueryError("invalid_share", "a share needs one SUM or COUNT")
    by = {"total": [], "group0": ["group0"]}[metric.share]
    if len(metric.group_by) < 1 + len(by):
        raise QueryError("invalid_share", "too few groupings")
    whole = (groups.groupBy(*by) if by else groups.groupBy()).agg(F.sum("value").alias("whole"), F.min("error").alias("whole_error"))
    joined = same(groups, whole, by, "left") if by else groups.crossJoin(F.broadcast(whole))  # one row
    error = F.coalesce("error", "whole_error")
    return joined.withColumns({"error": error, "value": F.when(error.isNull(), F.try_divide("value", "whole"))}).drop("whole", "whole_error")


def ordering(metric: Metric) -> list[Column]:
    """Groups with errors last; then the metric's order (calendar groups by start, others by value, greatest first); then the keys."""
    first = metric.group_by[0] if metric.group_by else None
    terms = metric.sort or ((Sort("group0"),) if isinstance(first, Calendar) else (Sort("value", descending=True),))
    out = [F.col("error").isNotNull().asc()]
    for t in terms:
        c = F.col(t.key)
        out.append((c.desc_nulls_first() if t.nulls_first else c.desc_nulls_last()) if t.descending else (c.asc_nulls_first() if t.nulls_first else c.asc_nulls_last()))
    return out + [F.col(k).asc_nulls_last() for k in metric.keys()]


def evaluate(frame: DataFrame | Dataset, schema: FieldSchema, metric: Metric, now: datetime | None = None) -> Result:
    """The metric over the rows of ``frame`` (a dataset, a page of its rows, or groups with a schema of their own)."""
    now = now or datetime.now(UTC)
    groups = grouped(frame, schema, metric, now)
    return _finished(groups, schema, metric)


def _finished(groups: DataFrame, schema: FieldSchema, metric: Metric) -> Result:
    held: tuple[DataFrame, ...] = ()
    if metric.fill is not None or metric.other:  # read more than once: the rows aren't
        groups = groups.persist()
        held = (groups,)
    if metric.fill is not None:
        groups = completed(groups, metric)
    made = _trailed(groups, metric) if metric.trailing else _evaluated(groups, metric)
    if metric.share:
        made = _shared(made, metric)
    rows = F.coalesce(F.sum("count"), F.lit(0))
    hidden = F.lit(0)
    if metric.min_count is not None:
        least = _minimum(schema, metric)[1]
        small = F.coalesce(F.col("measure") < least, F.lit(False)) if metric.fill is None else ~F.col("filled") & (F.col("measure") < least)
        if not isinstance(metric.min_count, int):  # a group whose measure is unknown stays
            small = F.coalesce(small, F.lit(False))
        hidden = F.count_if(small)
        kept = made.where(~small)
        facts = made.agg(F.count_if(~small).alias("group_count"), hidden.alias("hidden_groups"), rows.alias("processed_rows"))
    else:
        kept = made
        facts = made.agg(F.count("*").alias("group_count"), hidden.cast("long").alias("hidden_groups"), rows.alias("processed_rows"))
    columns = [*metric.keys(), "value", "error", "count", *[c for c in ("y", "lower", "upper", "interval_error", "intervals") if c in kept.columns], *[c for c in kept.columns if c.startswith("d_")]]
    order = ordering(metric)
    if metric.group_limit is None:
        return Result(kept.orderBy(*order).select(*columns), facts, held=held)
    top = kept.orderBy(*order).limit(metric.group_limit)
    return Result(top.select(*columns), facts, remainder(kept, top, metric) if metric.other else None, held)


def remainder(groups: DataFrame, top: DataFrame, metric: Metric) -> DataFrame:
    """(value, error, count) of the groups beyond the limit, pooled: every part must be a SUM or COUNT. No row if there are none
    or one of their parts failed."""
    if not all(p.additive for p in metric.parts.values()) or metric.y is not None or metric.trailing or metric.share:
        raise QueryError("no_remainder", "only SUM and COUNT parts pool")
    rest = same(groups, top.select(*metric.keys()), metric.keys(), "left_anti")
    failed = [F.count(f"p_{n}__error") for n, p in metric.parts.items() if p.input is not None and p.input.error is not None]
    pooled = rest.agg(F.count("*").alias("n"), F.sum("count").alias("count"), reduce(lambda a, b: a + b, failed, F.lit(0)).alias("failed"), *[c for n, p in metric.parts.items() for c in p.merged(f"p_{n}")])
    if metric.sole is not None and metric.sole.op == "sum":
        pooled = pooled.withColumns({f"p_{n}": F.coalesce(f"p_{n}", F.lit(0.0)) for n in metric.parts})
    made = _evaluated(pooled.where("n > 0 and failed = 0"), replace(metric, fill=None))
    return made.select("value", "error", "count", *[c for c in ("lower", "upper", "interval_error") if c in made.columns])


def dashboard(frame: DataFrame | Dataset, schema: FieldSchema, metrics: dict[str, Metric], now: datetime | None = None) -> dict[str, Result]:
    """Several metrics over the same rows. Those with the same filter, keys and minimum share one aggregation; for the others
    the fields that any of them reads are what Spark scans."""
    now = now or datetime.now(UTC)
    out: dict[str, Result] = {}
    plans: dict[str, list[str]] = {}
    for name, m in metrics.items():
        plans.setdefault(repr((m.where, m.group_by, m.min_count, [str(c) for c in m.extra])), []).append(name)
    for names in plans.values():
        first = metrics[names[0]]
        parts = {f"{n}__{k}": p for n in names for k, p in metrics[n].parts.items()}
        shared = grouped(frame, schema, replace(first, parts=parts, value=lambda p: next(iter(p.values()))), now)
        if len(names) > 1:
            shared = shared.persist()  # else each result would aggregate anew what it needs of it
        for n in names:
            m = metrics[n]
            renamed = {f"p_{n}__{k}{s}": f"p_{k}{s}" for k in m.parts for s in ("", "__sum", "__count", "__error") if f"p_{n}__{k}{s}" in shared.columns}
            fixed = [*m.keys(), "count", *(["measure"] if m.min_count is not None else [])]
            got = _finished(shared.select(*fixed, *renamed).withColumnsRenamed(renamed), schema, m)
            out[n] = replace(got, held=(*got.held, shared)) if len(names) > 1 else got
    return out


def bucket_rows(frame: DataFrame | Dataset, schema: FieldSchema, metric: Metric, keys: list, now: datetime, within: tuple[str, float, float, bool] | None = None) -> DataFrame:
    """Drill-down: the rows that make up the group with these keys; of a trailing metric those of all the buckets that its value merges.

    A calendar bucket becomes a range of its field, which a dataset's scan can skip by. ``within``: of a histogram's bin
    also (numeric field, lower edge, upper edge, whether the upper edge belongs to it).
    """
    terms, other = list(metric.where), []
    for k, value in zip(metric.group_by, keys, strict=True):
        if isinstance(k, Calendar) and k.interval not in calendar.CYCLES and value is not None:
            start = calendar.start_of(millis(value), k.interval, k.zone, k.every)
            after = calendar.next_of(start, k.interval, k.zone, k.every)
            for _ in range((metric.trailing.periods or 1) - 1 if metric.trailing else 0):
                start = calendar.start_of(start - 1, k.interval, k.zone, k.every)
            if metric.trailing is None or metric.trailing.periods is not None:
                terms.append({"field": k.field, "op": ">=", "value": at_millis(start).isoformat()})
            terms.append({"field": k.field, "op": "<", "value": at_millis(after).isoformat()})
            continue
        if isinstance(k, str) and isinstance(value, str) and value != "" and "=" in schema.field(k).allowed:
            terms.append({"field": k, "op": "=", "value": value})
        other.append(key_column(schema, k).eqNullSafe(F.lit(value)))
    if within is not None:
        name, low, high, closed = within
        terms += [{"field": name, "op": ">=", "value": repr(float(low))}, {"field": name, "op": "<=" if closed else "<", "value": repr(float(high))}]
    return reduce(DataFrame.where, other, population(frame, schema, terms, now))
