"""Series over calendar buckets: whole intervals only, and statistics of a cycle's slots over their occurrences."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumac.errors import QueryError
from sumac.functions import calendar
from sumac.functions.operands import at_millis, millis
from sumac.operators.distributions import Box, box_of
from sumac.operators.grouping import Calendar
from sumac.operators.joins import same
from sumac.operators.metrics import Fill, Metric, Result, evaluate
from sumac.operators.percentiles import exact_percentiles
from sumac.schema import FieldSchema


def whole_intervals(key: Calendar, start: datetime, end: datetime, now: datetime) -> tuple[datetime, datetime] | None:
    """From the first bucket that starts at ``start`` or later to the end of the last that ends by ``end`` and by now."""
    at = calendar.start_of(millis(start), key.interval, key.zone, key.every)
    if at < millis(start):
        at = calendar.next_of(at, key.interval, key.zone, key.every)
    last, bound = at, min(millis(end), millis(now))
    while (after := calendar.next_of(last, key.interval, key.zone, key.every)) <= bound:
        last = after
    return None if last == at else (at_millis(at), at_millis(last))


def bounded(metric: Metric, start: datetime, end: datetime, now: datetime) -> Metric:
    """The metric over the whole intervals between start and end only, all of them filled in."""
    key = metric.group_by[0]
    span = whole_intervals(key, start, end, now)
    if span is None:
        raise QueryError("empty_range", "no whole interval")
    bounds = ({"field": key.field, "op": ">=", "value": span[0].isoformat()}, {"field": key.field, "op": "<", "value": span[1].isoformat()})
    return replace(metric, where=(*metric.where, *bounds), fill=Fill(*span))


def unit_of(slot: Calendar) -> Calendar:
    """The hour (of hourOfDay) or day (of dayOfWeek) that is one occurrence of a slot."""
    if not isinstance(slot, Calendar) or slot.interval not in calendar.CYCLES:
        raise QueryError("invalid_occurrence", "the first key must be a cycle")
    return replace(slot, interval="hour" if slot.interval == "hourOfDay" else "day")


def _each(frame: DataFrame, schema: FieldSchema, metric: Metric, now: datetime | None) -> DataFrame:
    """The metric of every hour (of hourOfDay) or day (of dayOfWeek) with a date, under its slot."""
    slot = metric.group_by[0]
    each: Result = evaluate(frame, schema, replace(metric, group_by=(unit_of(slot), *metric.group_by[1:]), sort=()), now)
    return each.buckets.where("group0 is not null").withColumn("group0", calendar.bucket(F.col("group0"), slot.interval, slot.zone))


def occurrence_box(frame: DataFrame, schema: FieldSchema, metric: Metric, spec: Box = Box(), now: datetime | None = None) -> DataFrame:
    """The columns of distributions.box() for each slot, over its occurrences' values; rows without a date count for nothing."""
    failed = F.col("error").isNotNull()
    rows = _each(frame, schema, metric, now).select(*metric.keys(), F.when(~failed, F.col("value").cast("double")).alias("x"), failed.alias("failed"))
    return box_of(rows, metric.keys(), spec)


def occurrences(frame: DataFrame, schema: FieldSchema, metric: Metric, probabilities: list[float] | None = None, now: datetime | None = None) -> DataFrame:
    """The metric of every hour (of hourOfDay) or day (of dayOfWeek), then for each slot: (group0 ..., occurrences, count, value: the
    mean of their values, and with probabilities their percentiles as ``values``). Rows without a date count for nothing."""
    keys, dated = metric.keys(), _each(frame, schema, metric, now)
    got = dated.groupBy(*keys).agg(F.count("value").alias("occurrences"), F.sum("count").alias("count"), F.min("error").alias("error"), F.avg("value").alias("value"))
    if probabilities:
        q = exact_percentiles(dated, keys, F.col("value"), probabilities)
        got = same(got, q.select(*keys, F.col("q").alias("values")), keys, "left")
    return got.withColumn("value", F.when(F.col("error").isNull(), F.col("value")))
