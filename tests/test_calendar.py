from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sumac.errors import QueryError
from sumac.functions import calendar as C
from sumac.functions.relative import offset_ms

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
ms = lambda s: int((datetime.fromisoformat(s) - EPOCH) / timedelta(milliseconds=1))

#: Fixed values: (zone, interval, every, instant, start of its bucket, start of the next) about clock changes.
KNOWN = [
    ("America/New_York", "hour", 3, "2026-03-08T06:30:00Z", "2026-03-08T05:00:00Z", "2026-03-08T07:00:00Z"),
    ("America/New_York", "hour", 2, "2026-03-08T07:30:00Z", "2026-03-08T07:00:00Z", "2026-03-08T08:00:00Z"),
    ("America/New_York", "hour", 3, "2026-11-01T06:30:00Z", "2026-11-01T04:00:00Z", "2026-11-01T08:00:00Z"),
    ("America/New_York", "hour", 1, "2026-11-01T06:30:00Z", "2026-11-01T06:00:00Z", "2026-11-01T07:00:00Z"),
    ("Asia/Kolkata", "hour", 6, "2026-03-02T03:15:00Z", "2026-03-02T00:30:00Z", "2026-03-02T06:30:00Z"),
    ("Australia/Lord_Howe", "hour", 3, "2026-10-03T15:35:00Z", "2026-10-03T13:30:00Z", "2026-10-03T16:00:00Z"),
    ("Antarctica/Troll", "hour", 2, "2025-10-26T01:30:00Z", "2025-10-26T00:00:00Z", "2025-10-26T04:00:00Z"),
    ("Antarctica/Troll", "hour", 2, "2026-03-29T01:30:00Z", "2026-03-29T01:00:00Z", "2026-03-29T02:00:00Z"),
    ("UTC", "day", 2, "1969-12-31T12:00:00Z", "1969-12-30T00:00:00Z", "1970-01-01T00:00:00Z"),
    ("Europe/Berlin", "week", 2, "2026-01-11T23:30:00Z", "2026-01-11T23:00:00Z", "2026-01-25T23:00:00Z"),
    ("America/New_York", "month", 3, "2027-01-01T03:00:00Z", "2026-10-01T04:00:00Z", "2027-01-01T05:00:00Z"),
    ("Asia/Kathmandu", "year", 2, "2026-12-31T18:30:00Z", "2025-12-31T18:15:00Z", "2027-12-31T18:15:00Z"),
]


@pytest.mark.parametrize("case", KNOWN, ids=str)
def test_known_buckets(spark, case):
    zone, interval, every, at, start, after = case
    assert C.start_of(ms(at), interval, zone, every) == ms(start)
    assert C.next_of(ms(start), interval, zone, every) == ms(after)
    t = F.timestamp_millis(F.col("at"))
    b = C.bucket(t, interval, zone, every)
    got = spark.createDataFrame([(ms(at),)], "at long").select(F.unix_millis(b), F.unix_millis(C.following(b, interval, zone, every))).collect()[0]
    assert tuple(got) == (ms(start), ms(after))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Lord_Howe", "Antarctica/Troll", "America/Sao_Paulo", "Asia/Kolkata"])
def test_columns_agree_with_python(spark, zone):
    around = [t + d for t in C.transitions(zone)[-160::9] for d in (-3_600_001, -1, 0, 1_799_999, 3_600_000, 7_300_000)] or [0, 10**12, 1_700_000_000_123]
    frame = spark.createDataFrame([(t,) for t in around], "at long").cache()
    for interval, every in [("hour", 1), ("hour", 2), ("hour", 8), ("day", 1), ("day", 5), ("week", 1), ("week", 3), ("month", 1), ("month", 7), ("year", 1), ("year", 4)]:
        b = C.bucket(F.timestamp_millis("at"), interval, zone, every)
        for r in frame.select("at", F.unix_millis(b).alias("b"), F.unix_millis(C.following(b, interval, zone, every)).alias("n")).collect():
            start = C.start_of(r["at"], interval, zone, every)
            assert r["b"] == start <= r["at"], (interval, every, r)
            assert r["n"] == C.next_of(start, interval, zone, every) > r["at"], (interval, every, r)


def test_buckets_partition_the_timeline():
    for zone, interval, every in [("America/New_York", "hour", 1), ("Antarctica/Troll", "hour", 2), ("Australia/Lord_Howe", "hour", 3), ("America/Sao_Paulo", "day", 1)]:
        first = ms("2018-10-20T00:00:00Z")
        found = list(C.starts(first, first + 40 * 86_400_000, interval, zone, every))
        assert found == sorted(set(found))
        assert all(C.start_of((a + b) // 2, interval, zone, every) == a for a, b in zip(found[:-1], found[1:], strict=True))


def test_cycles_and_refusals(spark):
    t = spark.createDataFrame([(ms("2026-03-01T02:30:00Z"),), (None,)], "at long").select(F.timestamp_millis("at").alias("t"))
    got = t.select(C.bucket(F.col("t"), "hourOfDay", "America/New_York"), C.bucket(F.col("t"), "dayOfWeek", "America/New_York"), C.bucket(F.col("t"), "day", "Asia/Kolkata")).collect()
    assert tuple(got[0])[:2] == (21.0, 6.0) and tuple(got[1]) == (None, None, None)
    for interval, every in [("hour", 5), ("hour", 48), ("day", 1001), ("month", -1), ("hourOfDay", 2), ("decade", 1)]:
        with pytest.raises(QueryError):
            C.check(interval, every)
    with pytest.raises(QueryError):
        list(C.starts(0, 10**12, "hour", most=100))


def test_durations():
    # Fixed values.
    assert [offset_ms(x) for x in ("-1h", "+8d2h10m", "+0s", "-7d", "+1w2d", "+1h1h", "+01h")] == [-3_600_000, 699_000_000, 0, -604_800_000, 777_600_000, 7_200_000, 3_600_000]
    assert all(offset_ms(x) is None for x in ("", "1h", "now", "+", "-", "+1", "+1x", "1h ago", "+8640000000000001ms", "+1.5h"))
