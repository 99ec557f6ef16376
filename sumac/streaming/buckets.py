"""Calendar metrics over a stream: an extra, since the schemas describe tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumac.functions.aggregates import Part
from sumac.operators.grouping import Calendar, key_column
from sumac.schema import FieldSchema

#: Seconds that an interval lasts at most, clock changes included.
_LONGEST = {"hour": 3_600, "day": 25 * 3_600, "week": 169 * 3_600, "month": 745 * 3_600, "year": 8_785 * 3_600}


def running(stream: DataFrame, schema: FieldSchema, key: Calendar, parts: dict[str, Part], late: int = 3_600, by: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, by, count, parts) of a stream in any output mode. The watermark runs on the bucket's start: a bucket takes rows
    until one comes from a bucket that starts more than its own length and ``late`` seconds after it; then it leaves the state."""
    names = [schema.field(b).name for b in by]
    delay = late + _LONGEST[key.interval] * key.every
    timed = stream.withColumn("bucket", key_column(schema, key)).withWatermark("bucket", f"{delay} seconds")
    aggs = [F.count("*").alias("count"), *[c for n, p in parts.items() for c in p.columns(n)]]
    return timed.groupBy("bucket", *names).agg(*aggs)
